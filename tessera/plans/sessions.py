"""Queries over shop sessions and plans (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import episodes as ep
from ..operators import sessions as ss
from ..operators import shop_state
from ..sources import views as v
from ..sources import workspace
from ..sources.ledger import Ledger
from .reference import REGISTRY

query = REGISTRY.query


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session steps from events: every kind of click, by the event's own number."""
    kinds = F.array(*(F.lit(a) for a in ("search[red mug]", "click[b0001]", "click[next >]", "click[< prev]", "click[description]", "click[back to search]", "click[large]", "click[buy now]", "think")))
    pick = F.when(F.col("k") == 1, 1).otherwise(F.col("event_id") % 9 + 1).cast("int")
    return v.steps(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("k").alias("step"), F.element_at(kinds, pick).alias("action"), F.concat("event_type", F.lit(" page")).alias("observation"))


v.SQL["session_log"] = """
SELECT user_id AS session, k::INT AS step, (['search[red mug]', 'click[b0001]', 'click[next >]', 'click[< prev]', 'click[description]', 'click[back to search]', 'click[large]', 'click[buy now]', 'think'])[CASE WHEN k = 1 THEN 1 ELSE event_id % 9 + 1 END] AS action,
  event_type || ' page' AS observation FROM steps
"""


@query("w15_action_parse", v.with_views("steps", r"SELECT event_id, event_type AS name, CAST(prop_k AS VARCHAR) AS arg FROM steps WHERE event_type <> 'view' UNION ALL SELECT event_id, event_type || '[a', 'b]' || prop_k FROM steps WHERE event_type = 'view'").replace("event_type || '[a', 'b]' || prop_k", "event_type || '[a', CAST(prop_k AS VARCHAR)"))
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("prop_k").cast("string")
    action = F.when(F.col("event_type") == "view", F.concat("event_type", F.lit("[a["), k, F.lit("] and more"))).otherwise(F.concat("event_type", F.lit("["), k, F.lit("]")))
    return v.steps(spark, sf_dir).withColumn("a", ss.parse_action(action)).select("event_id", "a.name", "a.arg")


@query("w16_url_arguments", v.with_views("steps", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '|' || prop_k ELSE event_type END AS keywords, (event_id % 5)::INT AS page FROM steps"))
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("['"), "event_type", F.lit("', '"), F.col("prop_k").cast("string"), F.lit("']"))).otherwise(F.col("event_type"))
    return v.steps(spark, sf_dir).select("event_id", F.array_join(ss.parse_keywords(text), "|").alias("keywords"), ss.parse_page((F.col("event_id") % 5).cast("string")).alias("page"))


@query("w33_session_states", v.with_views("steps session_log", """
WITH a AS (SELECT session, step, CASE WHEN action LIKE 'search%' THEN 'search' WHEN action = 'click[back to search]' THEN 'reset' WHEN action IN ('click[next >]', 'click[< prev]') THEN 'turn' WHEN action = 'click[description]' THEN 'sub'
    WHEN action = 'click[buy now]' THEN 'end' WHEN action LIKE 'click%' THEN 'item' ELSE 'none' END AS kind, action FROM session_log),
b AS (SELECT *, coalesce(sum((kind = 'end')::INT) OVER (PARTITION BY session ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM a),
c AS (SELECT *, sum((kind IN ('search', 'reset'))::INT) OVER (PARTITION BY session ORDER BY step) AS epoch FROM b WHERE ended = 0),
d AS (SELECT *, first_value(kind) OVER w = 'search' AS searched, sum(CASE WHEN kind = 'turn' THEN CASE WHEN action = 'click[next >]' THEN 1 ELSE -1 END ELSE 0 END) OVER w AS turns FROM c WINDOW w AS (PARTITION BY session, epoch ORDER BY step))
SELECT session, step, kind, CASE WHEN kind = 'end' THEN 'done' WHEN kind = 'reset' THEN 'index' WHEN kind IN ('search', 'turn') AND searched THEN 'search_results' WHEN kind = 'sub' THEN 'item_sub_page' WHEN kind = 'item' THEN 'item_page' ELSE 'index' END AS page,
  CASE WHEN searched THEN greatest(1 + turns, 1)::BIGINT END AS page_number, kind = 'end' AS done, count(*) FILTER (action LIKE 'click%') OVER (PARTITION BY session ORDER BY step) AS clicks FROM d"""))  # fmt: skip
def w33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.page_states(_log(spark, sf_dir))


def _shop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session steps from events, with several items and an option."""
    item = F.concat(F.lit("click[b"), (F.col("prop_k") % 5).cast("string"), F.lit("]"))
    size = F.when(F.col("prop_k") % 2 == 0, "click[large]").otherwise("click[small]")
    kinds = F.array(F.lit("search[red mug]"), item, F.lit("click[next >]"), F.lit("click[< prev]"), F.lit("click[description]"), size, item, F.lit("think"), F.when(F.col("prop_k") % 4 == 0, "click[buy now]").otherwise("click[back to search]"))
    at = F.when(F.col("k") == 1, 0).otherwise(F.col("event_id") % 9).cast("int")
    return v.steps(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("k").alias("step"), F.get(kinds, at).alias("action"), F.when(at == 5, "Size").alias("option"))


v.SQL["shop_log"] = """
SELECT user_id AS session, k::INT AS step, (['search', 'item', 'next', 'prev', 'sub', 'option', 'item', 'none', CASE WHEN prop_k % 4 = 0 THEN 'buy' ELSE 'back' END])[CASE WHEN k = 1 THEN 1 ELSE event_id % 9 + 1 END] AS act,
  'B' || (prop_k % 5) AS item, CASE WHEN prop_k % 2 = 0 THEN 'large' ELSE 'small' END AS size FROM steps
"""


@query("w33_session_fold", v.with_views("steps shop_log", """
WITH RECURSIVE f AS (
  SELECT session, 0 AS step, 'index' AS page, NULL::INT AS page_number, NULL::VARCHAR AS asin, NULL::VARCHAR AS size, []::VARCHAR[] AS visited, 0 AS n_search, 0 AS n_asin, 0 AS n_options, 0 AS n_sub, 0 AS n_buy FROM shop_log WHERE step = 1
  UNION ALL
  SELECT session, step, CASE WHEN back THEN 'index' WHEN results IS NOT NULL THEN 'search_results' WHEN opens OR closes THEN 'item_page' WHEN looks THEN 'item_sub_page' WHEN buys THEN 'done' ELSE page END,
    CASE WHEN back THEN NULL ELSE coalesce(results, page_number) END, CASE WHEN back OR results IS NOT NULL THEN NULL WHEN opens THEN item ELSE asin END,
    CASE WHEN back OR results IS NOT NULL THEN NULL WHEN chooses THEN new_size ELSE size END,
    CASE WHEN back THEN [] WHEN opens AND NOT list_contains(visited, item) THEN list_append(visited, item) ELSE visited END,
    CASE WHEN back THEN 0 ELSE n_search + (results IS NOT NULL)::INT END, CASE WHEN back THEN 0 ELSE n_asin + opens::INT END, CASE WHEN back THEN 0 ELSE n_options + chooses::INT END,
    CASE WHEN back THEN 0 ELSE n_sub + looks::INT END, CASE WHEN back THEN 0 ELSE n_buy + buys::INT END
  FROM (SELECT f.* EXCLUDE (step), l.step, l.item, l.size AS new_size, act = 'back' AND page <> 'index' AS back, act = 'item' AND page = 'search_results' AS opens, act = 'prev' AND page = 'item_sub_page' AS closes,
      act = 'sub' AND page = 'item_page' AS looks, act = 'buy' AND page = 'item_page' AS buys, act = 'option' AND page = 'item_page' AS chooses,
      CASE WHEN act = 'search' THEN 1 WHEN act = 'next' AND page = 'search_results' THEN page_number + 1 WHEN act = 'prev' AND page = 'item_page' THEN page_number WHEN act = 'prev' AND page = 'search_results' AND page_number > 1 THEN page_number - 1 END AS results
    FROM f JOIN shop_log l ON l.session = f.session AND l.step = f.step + 1 WHERE f.page <> 'done'))
SELECT session, step::BIGINT AS step, page, page_number, asin, CASE WHEN size IS NULL THEN '' ELSE 'size=' || size END AS options, array_to_string(visited, ',') AS visited,
  concat_ws(';', CASE WHEN n_asin > 0 THEN 'asin=' || n_asin END, CASE WHEN n_sub > 0 THEN 'description=' || n_sub END, CASE WHEN n_options > 0 THEN 'options=' || n_options END, CASE WHEN n_buy > 0 THEN 'purchase=' || n_buy END, CASE WHEN n_search > 0 THEN 'search=' || n_search END) AS counts,
  page = 'done' AS done FROM f WHERE step > 0"""))  # fmt: skip
def w33_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop_state.fold(_shop_log(spark, sf_dir).withColumn("step", F.col("step").cast("bigint")))


@query("w33_page_names", v.with_views("steps", "SELECT event_id, (['', 'search_results', 'item_page', 'item_sub_page', 'done'])[event_id % 5 + 1] AS page FROM steps"))
def w33_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("", "search_results", "item_page", "item_sub_page", "done")))
    url = F.concat(F.lit("http://shop/"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")), F.lit("/x"))
    return v.steps(spark, sf_dir).select("event_id", ss.page_name(url).alias("page"))


@query("w34_observation_history", v.with_views("steps session_log", """
SELECT session, step, concat_ws(' [SEP] ', lag(observation, 2) OVER w, lag(action, 1) OVER w, lag(observation, 1) OVER w, action, observation) AS state FROM session_log WINDOW w AS (PARTITION BY session ORDER BY step)"""))  # fmt: skip
def w34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.observation_history(_log(spark, sf_dir), 2)


@query("w35_session_code", v.with_views("turns", "SELECT conv_id, turn, upper(substr(sha1(text), 1, 10)) AS code FROM turns"))
def w35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.turns(spark, sf_dir).select("conv_id", "turn", ss.session_code(F.col("text")).alias("code"))


@query("w36_session_log", v.with_views("steps", "SELECT event_id, event_type AS page, user_id AS goal, value AS content FROM steps"))
def w36(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = ss.log_line(F.col("event_type"), F.lit("http://shop"), F.col("user_id"), F.col("value"))
    back = v.steps(spark, sf_dir).select("event_id", F.from_json(line, "page string, url string, goal bigint, content double").alias("e"))
    return back.select("event_id", "e.page", "e.goal", "e.content")


@query("w36_session_log_batches", v.with_views("steps", "SELECT event_id, event_type AS page, user_id AS goal, value AS content FROM steps"))
def w36_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written in three batches, the second of them twice, and read again."""
    ledger = Ledger(spark, workspace.new_path(spark, "log"), "event_id bigint, page string, goal bigint, content double")
    rows = v.steps(spark, sf_dir).select("event_id", F.col("event_type").alias("page"), F.col("user_id").alias("goal"), F.col("value").alias("content"))
    for batch in (0, 1, 1, 2):
        ledger.append(rows.where(F.pmod("goal", F.lit(3)) == batch), f"goals-{batch}")
    return ledger.read()


@query("w43_plan_calls", v.with_views("steps", "SELECT event_id, 'R' || (event_id % 3) || '|R' || (event_id % 5) AS variables, event_type AS name, 'R' || prop_k || ', f(x), \"a\"' AS args, 'R' || (event_id % 3) || '|R' || (event_id % 5) || '|R' || prop_k AS used FROM steps"))
def w43(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: c.cast("string")
    line = F.concat(F.lit("R"), n(F.col("event_id") % 3), F.lit(", R"), n(F.col("event_id") % 5), F.lit(" = "), "event_type", F.lit("(R"), n(F.col("prop_k")), F.lit(', f(x), "a") and (more)'))
    rows = v.steps(spark, sf_dir).select("event_id", line.alias("line")).withColumn("c", ss.parse_call(F.col("line")))
    return rows.select("event_id", F.array_join("c.variables", "|").alias("variables"), F.col("c.name").alias("name"), F.col("c.args").alias("args"), F.array_join(ss.variables(F.col("line")), "|").alias("used"))


@query("w43_subgoals", v.with_views("steps", "SELECT event_id, 2 AS n, 'Subgoal 2: ' || event_type AS second, 'R2 = Buy()' AS action FROM steps"))
def w43_subgoals(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.concat(F.lit("Plan.\nSubgoal 1: look\nR1 = Search(x)\n\nSubgoal 2: "), "event_type", F.lit("\nR2 = Buy()"))
    rows = v.steps(spark, sf_dir).withColumn("s", ss.subgoals(plan))
    return rows.select("event_id", F.size("s").alias("n"), F.col("s")[1]["subgoal"].alias("second"), F.col("s")[1]["actions"][0].alias("action"))


@query("w46_random_policy", v.with_views("steps candidates", "SELECT user_id, state_id, action FROM (SELECT *, row_number() OVER (PARTITION BY user_id, state_id ORDER BY md5(CAST(event_id AS VARCHAR) || '#46'), event_id) AS rn FROM candidates) WHERE rn = 1"))
def w46(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.md5(F.concat(F.col("event_id").cast("string"), F.lit("#46"))), F.col("event_id")]
    return ss.random_policy(v.candidates(spark, sf_dir), ["user_id", "state_id"], order).select("user_id", "state_id", "action")


@query("w45_solved_average", v.with_views("steps episodes", "SELECT count(*) AS n, count(*) FILTER (success) AS solved, round(sum(reward) / count(*) FILTER (success), 6) AS average FROM episodes"))
def w45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.solved_average(v.episodes(spark, sf_dir)).withColumn("average", F.round("average", 6))
