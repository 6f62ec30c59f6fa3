"""Conversations: rendering, role maps, checks, trimming, prompts, action parsing, masks.

The long form has one row a turn (conv_id, turn, role, text); the array form one row a conversation
with ``messages``, an array of (role, content) in turn order. A conversation is bounded by its
model's context, so gathering one into an array is safe however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100


def to_messages(turns: DataFrame) -> DataFrame:
    """Array form of the long form."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def to_turns(conversations: DataFrame) -> DataFrame:
    """Long form of the array form."""
    return conversations.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


# ---- rendering

_LLAMA3 = "<|start_header_id|>{}<|end_header_id|>\n\n"


def pieces_llama2(messages: Column) -> Column:
    """Each message's part of a prompt in the second-generation chat form.

    The system text is wrapped into the first user turn: whatever turn is at index 0, a user turn at
    index 1 gets no opening of its own if that turn has content. Null system turns are left out.
    """

    def one(m: Column, i: Column) -> Column:
        first_full = F.element_at(messages, 1)["content"].isNotNull()
        last_stub = (m["role"] == "assistant") & m["content"].isNull() & (i == F.size(messages) - 1)
        text = F.coalesce(m["content"], F.lit("None"))
        return (
            F.when((m["role"] == "system") & m["content"].isNull(), "")
            .when((m["role"] == "system") & (i == 0), F.concat(F.lit("[INST] <<SYS>>\n"), text, F.lit("\n<</SYS>>\n\n")))
            .when(m["role"] == "system", F.concat(F.lit("<<SYS>>\n"), text, F.lit("\n<</SYS>>\n\n")))
            .when((m["role"] == "user") & (i == 1) & first_full, F.concat(text, F.lit(" [/INST]")))
            .when(m["role"] == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(last_stub, "")
            .when(m["role"] == "assistant", F.concat(text, F.lit(" </s><s>")))
            .otherwise(text)
        )

    return F.transform(messages, one)


def pieces_llama3(messages: Column) -> Column:
    """Each message's part of a prompt in the third-generation chat form; a last assistant turn without content ends the prompt open."""

    def one(m: Column, i: Column) -> Column:
        known = m["role"].isin("system", "user", "assistant")
        head = F.when(known, F.concat(F.lit("<|start_header_id|>"), m["role"], F.lit("<|end_header_id|>\n\n"))).otherwise("")
        last_stub = (m["role"] == "assistant") & m["content"].isNull() & (i == F.size(messages) - 1)
        tail = F.when(known, "<|eot_id|>").otherwise("")
        return F.when((m["role"] == "system") & m["content"].isNull(), "").when(last_stub, head).otherwise(F.concat(head, F.coalesce(m["content"], F.lit("None")), tail))

    return F.transform(messages, one)


PIECES = {"llama2": pieces_llama2, "llama3": pieces_llama3}


def pieces(messages: Column, template: str) -> Column:
    """Array of texts, one a message, that joined are the prompt."""
    if template not in PIECES:
        raise ValueError(f"unknown chat template {template}")
    return PIECES[template](messages)


def render(messages: Column, template: str) -> Column:
    return F.array_join(pieces(messages, template), "")


def reply_start(role: Column, template: str) -> Column:
    """How many letters of an assistant's piece come before its reply; null for other roles."""
    head = len(_LLAMA3.format("assistant")) if template == "llama3" else 0
    return F.when(role == "assistant", head)


# ---- roles


def role_map_strict(messages: Column) -> Column:
    """human/gpt turns, trimmed, and whether even places are the user's: struct(conversations, valid)."""
    mapped = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"), F.trim(m["content"]).alias("value")))
    marked = F.transform(messages, lambda m, i: (i % 2 == 1) | (m["role"] == "user"))
    return F.struct(mapped.alias("conversations"), F.forall(marked, lambda ok: ok).alias("valid"))


def role_map_lenient(turns: DataFrame) -> DataFrame:
    """Long form with system turns dropped and neighbours of one role merged: (conv_id, turn, from, value, valid).

    ``valid`` is false for a conversation that doesn't start with the user or has an unknown role.
    """
    conv = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.where("role <> 'system'").withColumn("text", F.trim("text"))
    rows = rows.withColumn("fresh", F.coalesce((F.lag("role").over(conv) != F.col("role")).cast("int"), F.lit(1))).withColumn("island", F.sum("fresh").over(conv))
    merged = rows.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("value"))
    bad = F.max(((F.col("island") == 1) & (F.col("role") != "user")) | ~F.col("role").isin("user", "assistant")).over(Window.partitionBy("conv_id"))
    return merged.select("conv_id", (F.col("island") - 1).alias("turn"), F.when(F.col("role") == "user", "human").otherwise("gpt").alias("from"), "value", (~bad).alias("valid"))


def drop_leading(messages: Column, role: str = "user") -> Column:
    """Without a first turn of another role."""
    return F.when((F.size(messages) > 0) & (F.element_at(messages, 1)["role"] != role), F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def alternates(messages: Column) -> Column:
    """Whether user and assistant take turns, the user first."""
    expected = F.transform(messages, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return F.forall(expected, lambda ok: ok)


def inverse_role(role: Column) -> Column:
    return F.when(role == "user", "human").otherwise("gpt")


def verified(messages: Column) -> Column:
    """Not empty, the user first, in turns, the assistant last: the check as it was meant."""
    return (F.size(messages) > 0) & alternates(messages) & (F.size(messages) % 2 == 0)


def system_split(content: Column, separator: str = "\n---\n") -> Column:
    """struct(system, examples, task) if a first user turn splits in exactly three, else null."""
    parts = F.split(content, separator, -1)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("system"), parts[1].alias("examples"), parts[2].alias("task")))


# ---- trimming


def _numbered(turns: DataFrame, size: Column, keep: int) -> DataFrame:
    conv = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("size", size).withColumn("at", F.row_number().over(conv)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    after = Window.partitionBy("conv_id").orderBy(F.col("at").desc())
    head = F.sum(F.when(F.col("at") <= keep, F.col("size")).otherwise(0)).over(Window.partitionBy("conv_id"))
    return rows.withColumn("head", head).withColumn("suffix", F.sum("size").over(after)).withColumn("tail", F.greatest(F.col("n") - keep, F.lit(0)))


def trim_pairs(turns: DataFrame, size: Column, budget: int, keep: int = 3, least_tail: int = 4) -> DataFrame:
    """Turns that stay when the oldest pairs after the first ``keep`` are dropped until ``budget`` holds.

    As many pairs go as the budget asks, but none once the tail is down to ``least_tail``. Sizes must add up.
    """
    rows = _numbered(turns, size, keep)
    place = F.col("at") - keep  # 1 for the tail's first turn
    starts = (place >= 1) & ((place - 1) % 2 == 0) & (F.col("head") + F.col("suffix") <= budget)
    conv = Window.partitionBy("conv_id")
    fits = F.min(F.when(starts, ((place - 1) / 2).cast("bigint"))).over(conv)  # pairs dropped so that the rest fits
    all_gone = F.ceil(F.col("tail") / 2)
    cap = F.when(F.col("tail") > least_tail, F.ceil((F.col("tail") - least_tail) / 2)).otherwise(0)
    rows = rows.withColumn("dropped", 2 * F.least(F.coalesce(fits, all_gone), cap))
    return rows.where((F.col("at") <= keep) | (F.col("at") - keep > F.col("dropped")))


def trim_singles(turns: DataFrame, size: Column, budget: int, keep: int = 3) -> DataFrame:
    """Turns that stay when the oldest after the first ``keep`` are dropped one at a time; the tail may empty."""
    rows = _numbered(turns, size, keep)
    return rows.where((F.col("at") <= keep) | (F.col("head") + F.col("suffix") <= budget))


def trim_statistics(turns: DataFrame, kept: DataFrame, size: Column) -> DataFrame:
    """One row: conversations, how many were trimmed, tokens before and after, turns removed."""
    before = turns.groupBy("conv_id").agg(F.sum(size).alias("before"), F.count(F.lit(1)).alias("turns"))
    after = kept.groupBy("conv_id").agg(F.sum("size").alias("after"), F.count(F.lit(1)).alias("left"))
    cut = F.col("left") < F.col("turns")
    return before.join(after, "conv_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(cut).alias("trimmed"), F.sum(F.when(cut, F.col("before")).otherwise(0)).alias("tokens_before"),
        F.sum(F.when(cut, F.col("after")).otherwise(0)).alias("tokens_after"), F.sum(F.col("turns") - F.col("left")).alias("removed"),
    )


# ---- prompts


def prompt_plain(instruction: Column, task: Column) -> Column:
    """struct(prompt, messages) without examples."""
    prompt = F.concat(instruction, F.lit("\nNow, here is the task.\n"), task)
    return F.struct(prompt.alias("prompt"), F.array(_message("user", instruction), _message("assistant", F.lit("OK")), _message("user", task)).alias("messages"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_with_examples(instruction: Column, examples: list[list[str]], task: Column, wanted: int = 1) -> Column:
    """struct(prompt, messages) with up to ``wanted`` examples, each a list of turns, the user's first.

    Several examples are numbered; an example's user turns but the first are followed by a blank line.
    """
    used = examples[: max(0, wanted)]
    text, messages = "", [_message("user", instruction)]
    for i, example in enumerate(used):
        for j, content in enumerate(example):
            if j == 0:
                if i == 0:
                    messages.append(_message("assistant", F.lit("OK")))
                text += ("" if i == 0 else "\n") + (f"Example task {i + 1}:\n" if wanted > 1 else "") + content + "\n"
            else:
                text += content + ("\n\n" if j % 2 == 0 else "\n")
            messages.append(_message("user" if j % 2 == 0 else "assistant", F.lit(content)))
    lead = f"Here are {wanted} examples." if wanted > 1 else "Here is an example."
    prompt = F.concat(instruction, F.lit(f"\n---\n{lead}\n\n{text}\n---\nNow, it's your turn and here is the task.\n"), task)
    return F.struct(prompt.alias("prompt"), F.array(*messages, _message("user", task)).alias("messages"))


def explore_prompt(task: Column, tried: Column) -> Column:
    """A task with the answers already tried, numbered from 1; unchanged if there are none."""
    lines = F.transform(tried, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a))
    return F.when(F.size(tried) > 0, F.concat(task, F.lit("\nGive an answer different from:\n"), F.array_join(lines, "\n"))).otherwise(task)


def splice_paraphrase(observation: Column, paraphrase: Column, separator: str = " [SEP] ") -> Column:
    """The observation with its instruction, the part after the first separator, replaced."""
    parts = F.split(observation, r" \[SEP\] ", -1)
    return F.when(F.size(parts) > 1, F.array_join(F.transform(parts, lambda p, i: F.when(i == 1, paraphrase).otherwise(p)), separator)).otherwise(observation)


# ---- actions


def parse_action(text: Column, optional_space: bool = True) -> Column:
    """What follows the first ``Action:``, to the end of the text or, without ``optional_space``, of the line; null: none."""
    pattern = r"(?s)Action:\s?(.*)" if optional_space else r"Action: (.*)"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def clean_observation(text: Column) -> Column:
    """Without the sentence that tells of an arrival."""
    return F.when(text.startswith("You arrive at loc ") & (F.instr(text, ". ") > 0), F.substr(text, F.instr(text, ". ") + 2)).otherwise(text)


def cut_task(text: Column) -> Column:
    """Without the first paragraph."""
    parts = F.split(text, "\n\n", -1)
    return F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "\n")


def assistant_actions(messages: Column) -> Column:
    """Contents of assistant turns that name an action or are a number."""
    picked = F.filter(messages, lambda m: (m["role"] == "assistant") & (F.contains(m["content"], F.lit("Action:")) | m["content"].rlike("^[0-9]+$")))
    return F.transform(picked, lambda m: m["content"])


def skip_repeated_actions(turns: DataFrame, action: Column) -> DataFrame:
    """Turns whose action differs from the one just before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("action", action).withColumn("before", F.lag("action").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("action"))).drop("before")


def graft_prefixes(conversations: DataFrame) -> DataFrame:
    """For each assistant turn 2i+1 of an expert conversation: the state before it and its action."""
    at = F.sequence(F.lit(0), F.greatest((F.size("messages") / 2).cast("int") - 1, F.lit(0)))
    rows = conversations.where(F.size("messages") >= 2).select("conv_id", "messages", F.explode(at).alias("step"))
    return rows.select("conv_id", "step", F.slice("messages", F.lit(1), 2 * F.col("step") + 1).alias("state"), F.element_at("messages", 2 * F.col("step") + 2).alias("action"))


def terminate(steps: DataFrame, max_steps: int, rule: str) -> DataFrame:
    """Per step: finished, success and the reward so far, under a benchmark's rule.

    ``household`` keeps the reward at the step limit, ``shop`` zeroes it, ``science`` carries the greatest
    so far. A done step ends an episode with success whatever the limit says.
    """
    w = Window.partitionBy("episode").orderBy("step")
    limit = F.col("step") >= max_steps
    reward = {"household": F.col("reward"), "shop": F.when(limit & ~F.col("done"), 0.0).otherwise(F.col("reward")), "science": F.greatest(F.max("reward").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))}[rule]
    return steps.select("episode", "step", (limit | F.col("done")).alias("finished"), F.col("done").alias("success"), reward.alias("reward"))


#: Household actions as calls, in the order in which their beginnings are tried.
EXECUTE_RULES = (
    (r"^go to (.*)$", 'goto("{1}")'),
    (r"^put (.*?) in/on (.*)$", 'put("{1}","{2}")'),
    (r"^take (.*?) from (.*)$", 'take_from("{1}","{2}")'),
    (r"^open (.*)$", 'open("{1}")'),
    (r"^close (.*)$", 'close("{1}")'),
    (r"^toggle (.*)$", 'toggle("{1}")'),
    (r"^heat (.*?) with (.*)$", 'heat("{1}","{2}")'),
    (r"^cool (.*?) with (.*)$", 'cool("{1}","{2}")'),
    (r"^clean (.*?) with (.*)$", 'clean("{1}","{2}")'),
    (r"^look.*$", "look()"),
    (r"^use (.*)$", 'use("{1}")'),
)


def execute_line(line: Column) -> Column:
    """A prompt line with its action as a call, its thought in a tag; other lines pass; an unknown action is null."""
    action = F.trim(F.substr(line, F.lit(8)))
    call = None
    for pattern, form in EXECUTE_RULES:
        parts: list[Column] = []
        for piece in form.replace("{1}", "\0\1\0").replace("{2}", "\0\2\0").split("\0"):
            parts.append(F.trim(F.regexp_extract(action, pattern, ord(piece))) if piece in ("\1", "\2") else F.lit(piece))
        made = F.concat(F.lit("<execute> "), *parts, F.lit(" </execute>"))
        call = F.when(action.rlike(pattern), made) if call is None else call.when(action.rlike(pattern), made)
    thought = F.concat(F.lit("<thought> "), F.trim(F.substr(line, F.lit(7))), F.lit(" </thought>"))
    return F.when(line.startswith("Action"), call).when(line.startswith("Think:"), thought).otherwise(line)


# ---- token masks


def loss_mask(turns: DataFrame, tokens: Column) -> DataFrame:
    """Per token of a conversation: its label, the token itself in assistant turns, else the ignored mark."""
    rows = turns.withColumn("tokens", tokens).select("conv_id", "turn", "role", F.posexplode("tokens").alias("at", "token"))
    return rows.withColumn("label", F.when(F.col("role") == "assistant", F.col("token")))


def length_profile(lengths: DataFrame, size: str, limit: int = 4096) -> DataFrame:
    """One row: count, mean, median, the value at 95 % of the order, maximum, how many exceed ``limit``.

    The 95 % value is the one at place floor(0.95 n), from 0, of the sorted lengths. It is found on the
    lengths' histogram, one row for each different length, so no sort of all rows is needed.
    """
    counts = lengths.groupBy(size).agg(F.count(F.lit(1)).alias("many"))
    upto = F.sum("many").over(Window.orderBy(size))
    total = F.sum("many").over(Window.partitionBy())
    marked = counts.withColumn("upto", upto).withColumn("total", total)
    return marked.agg(
        F.max("total").alias("count"), (F.sum(F.col(size) * F.col("many")) / F.max("total")).alias("mean"),
        ((F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) / 2), F.col(size))) + F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(size)))) / 2).alias("median"),
        F.min(F.when(F.col("upto") > F.floor(F.col("total") * 0.95), F.col(size))).alias("p95"), F.max(size).alias("max"),
        F.sum(F.when(F.col(size) > limit, F.col("many")).otherwise(0)).alias("over"),
    ).withColumn("over_share", F.col("over") / F.col("count"))


def longest(lengths: DataFrame, size: str, key: str, k: int = 20) -> DataFrame:
    """The k longest rows, smaller keys first among equals."""
    return lengths.orderBy(F.col(size).desc(), key).limit(k)


# ---- result records

RESULT_SCHEMA = "meta struct<steps:int,reward:double,finished:boolean,success:boolean,terminate_reason:string,error:string>, conversations array<struct<from:string,value:string>>"


def to_result_json(meta: Column, conversations: Column) -> Column:
    return F.to_json(F.struct(meta.alias("meta"), conversations.alias("conversations")))


def from_result_json(text: Column) -> Column:
    return F.from_json(text, RESULT_SCHEMA)
