"""Shop sessions: action strings, page state, observation history, codes and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_action(action: Column) -> Column:
    """struct(name, arg) of 'name[arg]', both as long as can be; without that form the whole text and null."""
    pattern = r"^(.+)\[(.+)\]"
    return F.struct(F.when(action.rlike(pattern), F.regexp_extract(action, pattern, 1)).otherwise(action).alias("name"), F.when(action.rlike(pattern), F.regexp_extract(action, pattern, 2)).alias("arg"))


_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_ITEM = rf"""{_QUOTED}|[^\s,'"\[\]]+"""


def parse_keywords(text: Column) -> Column:
    """A list literal as its items, anything else as one item; null for a list that is none.

    Items are texts in either quotation marks, which may hold the other kind and escaped marks, or bare numbers and names.
    """
    backslash = F.lit("\u0001")  # stands for an escaped one while the others are read

    def bare(item: Column) -> Column:
        inner = F.replace(F.substr(item, F.lit(2), F.length(item) - 2), F.lit("\\\\"), backslash)
        for written, meant in (("\\'", "'"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t")):
            inner = F.replace(inner, F.lit(written), F.lit(meant))
        return F.when(item.rlike("^['\"]"), F.replace(inner, backslash, F.lit("\\"))).otherwise(item)

    whole = text.rlike(rf"(?s)^\[\s*(?:(?:{_ITEM})\s*(?:,\s*(?:{_ITEM})\s*)*,?\s*)?\]\s*$")
    items = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s){_ITEM}"), F.lit(0)), bare)
    return F.when(~text.startswith("["), F.array(text)).when(whole, items)


def parse_page(text: Column) -> Column:
    return text.cast("int")


def page_name(url: Column) -> Column:
    """Which page an address is of, by its first known name in order; '' is the start page."""
    out = F.when(url.isNull(), None)
    for name in ("search_results", "item_page", "item_sub_page", "done"):
        out = out.when(F.contains(url, F.lit(name)), name)
    return out.otherwise("")


def page_states(steps: DataFrame) -> DataFrame:
    """Per step of a session: its page type, result page number, whether it is over, and clicks so far.

    ``steps`` has session, step and action. A search opens page 1; next and prev move within results;
    back to search resets; buy now ends. What comes after the end is not part of the session. Every
    rule is a running aggregate since the last reset, so one window per session does without a loop.
    """
    action = parse_action(F.col("action"))
    rows = steps.withColumn("name", F.lower(action["name"])).withColumn("arg", F.lower(action["arg"]))
    w = Window.partitionBy("session").orderBy("step")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    clicked = F.col("name") == "click"
    rows = rows.withColumn("over", F.max((clicked & (F.col("arg") == "buy now")).cast("int")).over(upto) == 1)
    rows = rows.withColumn("past", F.coalesce(F.lag("over").over(w), F.lit(False))).where(~F.col("past"))
    kind = F.when(F.col("name") == "search", "search").when(clicked & (F.col("arg") == "back to search"), "reset").when(clicked & F.col("arg").isin("next >", "< prev"), "turn").when(clicked & F.col("arg").isin("description", "features", "reviews"), "sub").when(clicked & (F.col("arg") == "buy now"), "end").when(clicked, "item").otherwise("none")
    rows = rows.withColumn("kind", kind).withColumn("epoch", F.sum(F.col("kind").isin("search", "reset").cast("int")).over(upto))
    within = Window.partitionBy("session", "epoch").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum(F.when(F.col("kind") == "turn", F.when(F.col("arg") == "next >", 1).otherwise(-1)).otherwise(0)).over(within)
    searched = F.first(F.col("kind")).over(within) == "search"
    page = F.when(F.col("kind") == "end", "done").when(F.col("kind") == "reset", "index").when(F.col("kind").isin("search", "turn") & searched, "search_results").when(F.col("kind") == "sub", "item_sub_page").when(F.col("kind") == "item", "item_page").otherwise("index")
    return rows.select("session", "step", "kind", page.alias("page"), F.when(searched, F.greatest(1 + turns, F.lit(1))).alias("page_number"), (F.col("kind") == "end").alias("done"), F.count_if(clicked).over(upto).alias("clicks"))


def observation_history(steps: DataFrame, last: int = 2) -> DataFrame:
    """Per step: the last observations and actions, oldest first, then the present observation, joined."""
    w = Window.partitionBy("session").orderBy("step")
    pieces = []
    for i in range(last, 0, -1):
        pieces += [F.lag("observation", i).over(w), F.lag("action", i - 1).over(w) if i > 1 else F.col("action")]
    return steps.select("session", "step", F.concat_ws(" [SEP] ", *pieces, "observation").alias("state"))


def session_code(text: Column) -> Column:
    """The first ten hexadecimal digits of the SHA-1, in upper case."""
    return F.upper(F.substring(F.sha1(text), 1, 10))


def log_line(page: Column, url: Column, goal: Column, content: Column) -> Column:
    """One log entry as JSON."""
    return F.to_json(F.struct(page.alias("page"), url.alias("url"), goal.alias("goal"), content.alias("content")))


def write_logs(entries: DataFrame, path: str) -> None:
    """JSON lines in a folder per session."""
    entries.write.mode("append").partitionBy("session").json(path)


def random_policy(actions: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One valid action per state: the first in hash order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return actions.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def parse_call(line: Column) -> Column:
    """struct(variables, name, args) of 'R1, R2 = Name(args)', up to the parenthesis that closes the first one."""
    left = F.substring_index(line, " = ", 1)
    right = F.substr(line, F.length(left) + 4)
    name = F.substring_index(right, "(", 1)
    rest = F.substr(right, F.length(name) + 1)
    chars = F.split(rest, "", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("shut"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.when(s["shut"], s).otherwise(F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), ((depth == 0) & (c != "")).alias("shut")))

    end = F.aggregate(chars, start, step)["at"]
    return F.struct(F.split(left, ", ", -1).alias("variables"), name.alias("name"), F.substr(rest, F.lit(2), F.greatest(end - 2, F.lit(0))).alias("args"))


def variables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(R[0-9]+)"), F.lit(1))


def subgoals(plan: Column) -> Column:
    """Array of structs (subgoal, actions): blocks split by blank lines, from the first subgoal on."""
    at = F.instr(plan, "Subgoal 1")
    body = F.when(at > 0, F.substr(plan, at)).otherwise(plan)
    return F.transform(F.split(body, "\n\n", -1), lambda b: F.struct(F.split(b, "\n", -1)[0].alias("subgoal"), F.slice(F.split(b, "\n", -1), F.lit(2), F.size(F.split(b, "\n", -1))).alias("actions")))
