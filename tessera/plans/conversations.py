"""Queries over conversations and prompts (C) and the trajectory steps that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversations as cv
from ..operators import token_turns as tt
from ..sources import views as v
from .reference import REGISTRY

query = REGISTRY.query


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.to_messages(v.turns(spark, sf_dir))


v.SQL["messages"] = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM turns GROUP BY conv_id"
v.SQL["numbered"] = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM turns"


def _each(expression: str, name: str, order: str = "i") -> str:
    return v.with_views("turns numbered", f"SELECT conv_id, string_agg({expression}, '' ORDER BY {order}) AS {name} FROM numbered GROUP BY conv_id")


@query(
    "c01_render_llama2",
    _each(
        """CASE WHEN role = 'system' AND i = 0 THEN '[INST] <<SYS>>' || chr(10) || text || chr(10) || '<</SYS>>' || chr(10) || chr(10)
        WHEN role = 'system' THEN '<<SYS>>' || chr(10) || text || chr(10) || '<</SYS>>' || chr(10) || chr(10)
        WHEN role = 'user' AND i = 1 THEN text || ' [/INST]' WHEN role = 'user' THEN '[INST] ' || text || ' [/INST]' ELSE text || ' </s><s>' END""",
        "prompt",
    ),
)
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", cv.render(F.col("messages"), "llama2").alias("prompt"))


@query("c02_render_llama3", _each("'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || CASE WHEN i = n - 1 AND role = 'assistant' THEN '' ELSE text || '<|eot_id|>' END", "prompt"))
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a last assistant turn is left open, as for generation
    opened = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when((i == F.size("messages") - 1) & (m["role"] == "assistant"), None).otherwise(m["content"]).alias("content")))
    return _messages(spark, sf_dir).withColumn("messages", opened).select("conv_id", cv.render(F.col("messages"), "llama3").alias("prompt"))


@query("c03_role_map_strict", v.with_views("turns numbered", "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'human' ELSE 'gpt' END || ':' || trim(text), '|' ORDER BY i) AS mapped, bool_and(i % 2 = 1 OR role = 'user') AS valid FROM numbered GROUP BY conv_id"))
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("r", cv.role_map_strict(F.col("messages")))
    return rows.select("conv_id", F.array_join(F.transform("r.conversations", lambda c: F.concat_ws(":", c["from"], c["value"])), "|").alias("mapped"), F.col("r.valid").alias("valid"))


@query(
    "c04_role_map_lenient",
    v.with_views(
        "relabelled_turns",
        """WITH a AS (SELECT conv_id, turn, role, trim(text) AS text, coalesce(lag(role) OVER w <> role, true)::INT AS fresh FROM relabelled_turns WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM a),
        c AS (SELECT conv_id, island, any_value(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS value FROM b GROUP BY 1, 2)
        SELECT conv_id, (island - 1)::BIGINT AS turn, CASE WHEN role = 'user' THEN 'human' ELSE 'gpt' END AS "from", value, NOT max(island = 1 AND role <> 'user') OVER (PARTITION BY conv_id) AS valid FROM c""",
    ),
)
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.role_map_lenient(v.relabelled_turns(spark, sf_dir))


@query(
    "c05_leading_and_alternation",
    v.with_views("turns numbered", """
WITH d AS (SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY i) <> 'user' AS bad_first FROM numbered),
e AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS j FROM d WHERE NOT (bad_first AND i = 0))
SELECT n.conv_id, count(e.j)::INT AS kept, coalesce(bool_and(e.role = CASE WHEN e.j % 2 = 0 THEN 'user' ELSE 'assistant' END), true) AS alternates
FROM (SELECT DISTINCT conv_id FROM numbered) n LEFT JOIN e USING (conv_id) GROUP BY n.conv_id"""),  # fmt: skip
)
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).withColumn("messages", cv.drop_leading(F.col("messages")))
    return rows.select("conv_id", F.size("messages").alias("kept"), cv.alternates(F.col("messages")).alias("alternates"))


@query("c06_inverse_role_map", v.with_views("turns", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'human' ELSE 'gpt' END AS \"from\" FROM turns"))
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.turns(spark, sf_dir).select("conv_id", "turn", cv.inverse_role(F.col("role")).alias("from"))


@query("c07_verified", v.with_views("turns numbered", "SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AND max(n) % 2 = 0 AS verified FROM numbered GROUP BY conv_id"))
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", cv.verified(F.col("messages")).alias("verified"))


def _words(text: Column) -> Column:
    """A token proxy: pieces between single spaces."""
    return F.size(F.split(text, " ", -1))


_SIZED = "z AS (SELECT *, len(string_split(text, ' ')) AS size, i + 1 AS pos FROM numbered), y AS (SELECT *, sum(CASE WHEN pos <= 3 THEN size ELSE 0 END) OVER (PARTITION BY conv_id) AS head, sum(size) OVER (PARTITION BY conv_id ORDER BY pos DESC) AS suffix, greatest(n - 3, 0) AS tail FROM z)"


@query(
    "c08_trim_pairs",
    v.with_views("turns numbered", f"""
WITH {_SIZED}, f AS (SELECT *, min(CASE WHEN pos > 3 AND (pos - 4) % 2 = 0 AND head + suffix <= 90 THEN (pos - 4) // 2 END) OVER (PARTITION BY conv_id) AS fits FROM y),
d AS (SELECT *, 2 * least(coalesce(fits, ceil(tail / 2)), CASE WHEN tail > 4 THEN ceil((tail - 4) / 2) ELSE 0 END) AS dropped FROM f)
SELECT conv_id, turn, size::INT AS size FROM d WHERE pos <= 3 OR pos - 3 > dropped"""),  # fmt: skip
)
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.trim_pairs(v.turns(spark, sf_dir), _words(F.col("text")), 90).select("conv_id", "turn", "size")


@query("c09_trim_singles", v.with_views("turns numbered", f"WITH {_SIZED} SELECT conv_id, turn, size::INT AS size FROM y WHERE pos <= 3 OR head + suffix <= 90"))
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.trim_singles(v.turns(spark, sf_dir), _words(F.col("text")), 90).select("conv_id", "turn", "size")


def _tokenizer() -> str:
    """A public tokenizer's file; the operators take any."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("c08_trim_tokens")
def c08_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prompts counted by a tokenizer, pairs dropped until they fit; no SQL has the tokenizer, a loop stands for it in the tests."""
    kept = tt.trim_pairs(_messages(spark, sf_dir), "llama2", 300, _tokenizer())
    return kept.select("conv_id", F.size("messages").alias("n_messages"), "plan.dropped", "plan.before", "plan.after")


@query("c09_trim_tokens")
def c09_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As c08_trim_tokens in the third-generation form, one message at a time."""
    kept = tt.trim_singles(_messages(spark, sf_dir), "llama3", 300, _tokenizer())
    return kept.select("conv_id", F.size("messages").alias("n_messages"), "plan.dropped", "plan.before", "plan.after")


@query(
    "c09_trim_statistics",
    v.with_views("turns numbered", f"""
WITH {_SIZED}, b AS (SELECT conv_id, sum(size) AS before, count(*) AS turns, sum(CASE WHEN pos <= 3 OR head + suffix <= 90 THEN size END) AS after, count(CASE WHEN pos <= 3 OR head + suffix <= 90 THEN 1 END) AS kept FROM y GROUP BY conv_id)
SELECT count(*) AS calls, count(*) FILTER (kept < turns) AS trimmed, sum(CASE WHEN kept < turns THEN before ELSE 0 END)::BIGINT AS tokens_before, sum(CASE WHEN kept < turns THEN after ELSE 0 END)::BIGINT AS tokens_after, sum(turns - kept)::BIGINT AS removed FROM b"""),  # fmt: skip
)
def c09_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = v.turns(spark, sf_dir)
    return cv.trim_statistics(turns, cv.trim_singles(turns, _words(F.col("text")), 90), _words(F.col("text")))


_RULES = "Follow the rules."


@query("c10_prompt_plain", v.with_views("turns", f"SELECT conv_id, '{_RULES}' || chr(10) || 'Now, here is the task.' || chr(10) || text AS prompt, 'user:{_RULES}|assistant:OK|user:' || text AS messages FROM turns WHERE turn = 0"))
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.turns(spark, sf_dir).where("turn = 0").withColumn("p", cv.prompt_plain(F.lit(_RULES), F.col("text")))
    return rows.select("conv_id", F.col("p.prompt").alias("prompt"), F.array_join(F.transform("p.messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("messages"))


_EXAMPLES = [["Find a mug.", "go to shelf", "You see a mug.", "take mug"], ["Heat an egg.", "go to fridge"]]
_EXAMPLE_TEXT = "Example task 1:\nFind a mug.\ngo to shelf\nYou see a mug.\n\ntake mug\n\nExample task 2:\nHeat an egg.\ngo to fridge\n"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    "c11_prompt_with_examples",
    v.with_views("turns", f"""SELECT conv_id, {_sql_text(_RULES + chr(10) + '---' + chr(10) + 'Here are 2 examples.' + chr(10) * 2 + _EXAMPLE_TEXT + chr(10) + '---' + chr(10) + "Now, it's your turn and here is the task." + chr(10))} || text AS prompt, 9 AS n
FROM turns WHERE turn = 0"""),  # fmt: skip
)
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.turns(spark, sf_dir).where("turn = 0").withColumn("p", cv.prompt_with_examples(F.lit(_RULES), _EXAMPLES, F.col("text"), wanted=2))
    return rows.select("conv_id", F.col("p.prompt").alias("prompt"), F.size("p.messages").alias("n"))


def _acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose assistant texts, but every fifth, hold a thought and an action."""
    text = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 5 != 0), F.concat(F.lit("Thought: go on\nAction: "), "text")).otherwise(F.col("text"))
    return v.turns(spark, sf_dir).withColumn("text", text)


v.SQL["acted"] = "SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND conv_id % 5 <> 0 THEN 'Thought: go on' || chr(10) || 'Action: ' || text ELSE text END AS text FROM turns"


@query(
    "c12_action_parse",
    v.with_views("turns acted", r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?s)Action:\s?(.*)') THEN regexp_extract(text, '(?s)Action:\s?(.*)', 1) END AS action,
CASE WHEN regexp_matches(text, 'Action: (.*)') THEN regexp_extract(text, 'Action: (.*)', 1) END AS line_action, NOT contains(text, 'Action:') AS format_error FROM acted WHERE role = 'assistant'"""),  # fmt: skip
)
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = cv.parse_action(F.col("text"))
    return _acted(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", action.alias("action"), cv.parse_action(F.col("text"), False).alias("line_action"), action.isNull().alias("format_error"))


@query("c13_observation_clean", v.with_views("turns", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'On it, you see ' || text ELSE text END AS cleaned FROM turns"))
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("You arrive at loc 7. On it, you see "), "text")).otherwise(F.col("text"))
    return v.turns(spark, sf_dir).select("conv_id", "turn", cv.clean_observation(told).alias("cleaned"))


@query("c14_task_cut", v.with_views("turns", "SELECT conv_id, turn, text || chr(10) || 'Your task is to: ' || role AS task FROM turns"))
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat(F.lit("-= Welcome =-\n\n"), F.regexp_replace("text", "\n\n", " "), F.lit("\n\nYour task is to: "), "role")
    return v.turns(spark, sf_dir).where("text not like '%\n\n%'").select("conv_id", "turn", cv.cut_task(told).alias("task"))


@query("c15_assistant_actions", v.with_views("turns acted", "SELECT conv_id, count(*) FILTER (role = 'assistant' AND (contains(text, 'Action:') OR regexp_full_match(text, '[0-9]+')))::INT AS n, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role = 'assistant' AND (contains(text, 'Action:') OR regexp_full_match(text, '[0-9]+'))), '') AS actions FROM acted GROUP BY conv_id"))
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cv.to_messages(_acted(spark, sf_dir)).withColumn("a", cv.assistant_actions(F.col("messages")))
    return rows.select("conv_id", F.size("a").alias("n"), F.array_join("a", "|").alias("actions"))


def _step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.steps(spark, sf_dir).select(F.col("user_id").alias("episode"), F.col("k").alias("step"), F.least(F.col("value") / 100, F.lit(1.0)).alias("reward"), (F.col("event_type") == "purchase").alias("done"))


@query(
    "c16_terminate",
    v.with_views("steps", """
WITH s AS (SELECT user_id AS episode, k::INT AS step, least(value / 100, 1.0) AS reward, event_type = 'purchase' AS done, k >= 10 AS over FROM steps)
SELECT 'household' AS rule, episode, step, over OR done AS finished, done AS success, reward FROM s
UNION ALL SELECT 'shop', episode, step, over OR done, done, CASE WHEN over AND NOT done THEN 0.0 ELSE reward END FROM s
UNION ALL SELECT 'science', episode, step, over OR done, done, greatest(max(reward) OVER (PARTITION BY episode ORDER BY step), 0.0) FROM s"""),  # fmt: skip
)
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _step_log(spark, sf_dir)
    a, b, c = (cv.terminate(log, 10, rule).withColumn("rule", F.lit(rule)) for rule in ("household", "shop", "science"))
    return a.unionByName(b).unionByName(c).select("rule", "episode", "step", "finished", "success", "reward")


@query("c17_explore_prompt", v.with_views("turns numbered", """
WITH t AS (SELECT conv_id, max(CASE WHEN i = 0 THEN text END) AS task, string_agg(CASE WHEN role = 'assistant' THEN a || '. ' || text END, chr(10) ORDER BY i) AS lines
  FROM (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS a FROM numbered) GROUP BY conv_id)
SELECT conv_id, task || CASE WHEN lines IS NULL THEN '' ELSE chr(10) || 'Give an answer different from:' || chr(10) || lines END AS prompt FROM t"""))  # fmt: skip
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["content"])
    return _messages(spark, sf_dir).select("conv_id", cv.explore_prompt(F.element_at("messages", 1)["content"], tried).alias("prompt"))


@query("c18_splice_paraphrase", v.with_views("turns", "SELECT conv_id, turn, 'Instruction: [SEP] ' || lower(text) || ' [SEP] Search' AS observation FROM turns WHERE text NOT LIKE '%[SEP]%'"))
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("Instruction: [SEP] "), "text", F.lit(" [SEP] Search"))
    return v.turns(spark, sf_dir).where("text not like '%[SEP]%'").select("conv_id", "turn", cv.splice_paraphrase(shown, F.lower("text")).alias("observation"))


@query("c19_loss_mask", v.with_views("turns", "SELECT conv_id, turn, pos::INT AS pos, CASE WHEN role = 'assistant' THEN token ELSE NULL END AS label FROM (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM turns)"))
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.loss_mask(v.turns(spark, sf_dir), F.split("text", " ", -1)).select("conv_id", "turn", F.col("at").alias("pos"), "label")


def _mask_tokens(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    rows = tt.loss_mask(_messages(spark, sf_dir), template, _tokenizer(), bos=50_256, length=512, pad=50_256)
    learnt = F.filter("labels", lambda x: x != cv.IGNORE)
    return rows.select("conv_id", F.size(learnt).alias("n_learnt"), F.sha2(F.array_join("ids", ","), 256).alias("ids"), F.sha2(F.array_join("labels", ","), 256).alias("labels"))


@query("c19_loss_mask_tokens_llama2")
def c19_llama2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by token spans; tested against a rule over letters."""
    return _mask_tokens(spark, sf_dir, "llama2")


@query("c19_loss_mask_tokens_llama3")
def c19_llama3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_tokens(spark, sf_dir, "llama3")


@query("c20_token_profile")
def c20_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of rendered conversations in tokens."""
    prompt = cv.render(F.col("messages"), "llama2")
    rows = _messages(spark, sf_dir).select("conv_id", tt.token_count(prompt, _tokenizer(), 1).alias("size"))
    profile = cv.length_profile(rows, "size", 512)
    return profile.select(*(F.round(c, 6).alias(c) if c in ("mean", "over_share") else F.col(c) for c in profile.columns))


v.SQL["lengths"] = "SELECT doc_id, len(string_split(text, ' ')) AS size FROM documents"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", _words(F.col("text")).alias("size"))


@query(
    "c20_length_profile",
    v.with_views("lengths", """
WITH o AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS pos, count(*) OVER () AS n FROM lengths)
SELECT count(*) AS count, round(avg(size), 6) AS mean, median(size) AS median, max(CASE WHEN pos = floor(n * 0.95) THEN size END)::INT AS p95, max(size)::INT AS max, count(*) FILTER (size > 1000) AS over, round(count(*) FILTER (size > 1000) / count(*), 6) AS over_share FROM o"""),  # fmt: skip
)
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.length_profile(_lengths(spark, sf_dir), "size", limit=1000).withColumns({c: F.round(c, 6) for c in ("mean", "over_share")})


@query("c20_longest", v.with_views("lengths", "SELECT doc_id, size::INT AS size FROM lengths ORDER BY size DESC, doc_id LIMIT 20"))
def c20_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.longest(_lengths(spark, sf_dir), "size", "doc_id")


@query("c21_system_split", v.with_views("turns", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS system, CASE WHEN turn % 2 = 0 THEN text END AS task FROM turns WHERE text NOT LIKE '%---%'"))
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit("\n---\nexamples\n---\n"), "text")).otherwise(F.concat("role", F.lit("\n---\n"), "text"))
    rows = v.turns(spark, sf_dir).where("text not like '%---%'").withColumn("s", cv.system_split(told))
    return rows.select("conv_id", "turn", F.col("s.system").alias("system"), F.col("s.task").alias("task"))


_LINES = ["Action: go to shelf 1", "Action: put mug 1 in/on desk 2", "Action: take mug 1 from shelf 1", "Action: open drawer 3", "Action: close drawer 3", "Action: toggle lamp 1", "Action: heat egg 1 with microwave 1", "Action: cool egg 1 with fridge 1", "Action: clean mug 1 with sink 1", "Action: look", "Action: use lamp 1", "Think: I need a mug", "Observation: a shelf", "Action: dance"]
_CALLS = ['<execute> goto("shelf 1") </execute>', '<execute> put("mug 1","desk 2") </execute>', '<execute> take_from("mug 1","shelf 1") </execute>', '<execute> open("drawer 3") </execute>', '<execute> close("drawer 3") </execute>', '<execute> toggle("lamp 1") </execute>', '<execute> heat("egg 1","microwave 1") </execute>', '<execute> cool("egg 1","fridge 1") </execute>', '<execute> clean("mug 1","sink 1") </execute>', "<execute> look() </execute>", '<execute> use("lamp 1") </execute>', "<thought> I need a mug </thought>", "Observation: a shelf"]


@query("c22_execute_lines", v.with_views("turns", f"SELECT conv_id, turn, ([{', '.join(map(_sql_text, _CALLS))}, NULL])[(conv_id + turn) % 14 + 1] AS line FROM turns"))
def c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, _LINES)), ((F.col("conv_id") + F.col("turn")) % 14 + 1).cast("int"))
    return v.turns(spark, sf_dir).select("conv_id", "turn", cv.execute_line(line).alias("line"))


@query("c23_state_json", v.with_views("steps episodes episodes_nulls", "SELECT user_id, chunk, attempt, reward, success, CASE WHEN success THEN NULL ELSE 'limit' END AS reason, event_type AS value FROM episodes_nulls"))
def c23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.episodes(spark, sf_dir, nulls=True)
    meta = F.struct(F.col("attempt").alias("steps"), "reward", F.lit(True).alias("finished"), "success", F.when(~F.col("success"), "limit").alias("terminate_reason"), F.lit(None).cast("string").alias("error"))
    talk = F.array(F.struct(F.lit("human").alias("from"), F.col("event_type").alias("value")))
    back = rows.withColumn("json", cv.to_result_json(meta, talk)).withColumn("r", cv.from_result_json(F.col("json")))
    return back.select("user_id", "chunk", "attempt", F.col("r.meta.reward").alias("reward"), F.col("r.meta.success").alias("success"), F.col("r.meta.terminate_reason").alias("reason"), F.col("r.conversations")[0]["value"].alias("value"))


@query("t22_skip_repeated_actions", v.with_views("turns", "SELECT conv_id, turn, action FROM (SELECT *, lag(action) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT conv_id, turn, substr(text, 1, 1) AS action FROM turns)) WHERE before IS NULL OR before <> action"))
def t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.skip_repeated_actions(v.turns(spark, sf_dir), F.substr("text", F.lit(1), F.lit(1))).select("conv_id", "turn", "action")


@query("t23_expert_graft", v.with_views("turns numbered", """
SELECT a.conv_id, ((a.i - 1) // 2)::INT AS step, a.text AS action, count(b.i)::INT AS n_state FROM numbered a JOIN numbered b ON b.conv_id = a.conv_id AND b.i < a.i
WHERE a.i % 2 = 1 GROUP BY 1, 2, 3, a.i"""))  # fmt: skip
def t23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cv.graft_prefixes(_messages(spark, sf_dir))
    return rows.select("conv_id", "step", F.col("action.content").alias("action"), F.size("state").alias("n_state"))
