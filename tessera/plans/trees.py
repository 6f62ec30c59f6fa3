"""Queries over search trees and evaluation episodes (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import episodes as ep
from ..operators import trees as tr
from ..sources import views as v
from .reference import REGISTRY

query = REGISTRY.query

_DEEP = 16  # levels: a binary heap of the largest user's events has far fewer

_BACKUP = """
b AS (SELECT u.tree_id, u.ancestor_id AS node_id, max(power(0.9, u.dist) * coalesce(l.reward, 0)) AS q_value, avg(coalesce(l.reward, 0)) AS mean_reward
      FROM leaves l JOIN up u USING (tree_id, node_id) GROUP BY 1, 2)
"""


def _tree_sql(body: str) -> str:
    return v.with_views("steps trees up leaves", f"WITH {_BACKUP.strip()}{body}", recursive=True)


@query("t01_concat_slices", v.with_views("steps episodes", "SELECT 0 AS slice_id, count(*) AS n, round(sum(reward), 6) AS total FROM episodes WHERE chunk % 2 = 0 UNION ALL SELECT 1, count(*), round(sum(reward), 6) FROM episodes WHERE chunk % 2 = 1"))
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.episodes(spark, sf_dir)
    parts = [rows.where(f"chunk % 2 = {i}").withColumn("slice_id", F.lit(i)) for i in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("slice_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("reward"), 6).alias("total"))


@query("t02_concat_trees", v.with_views("steps trees", "SELECT (tree_id % 3)::INT AS slice_id, count(DISTINCT tree_id) AS trees, count(*) AS nodes FROM trees GROUP BY 1"))
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.trees(spark, sf_dir)
    parts = [rows.where(F.col("tree_id") % 3 == i).withColumn("slice_id", F.lit(i)) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("slice_id").agg(F.countDistinct("tree_id").alias("trees"), F.count(F.lit(1)).alias("nodes"))


@query(
    "t03_tree_build",
    v.with_views(
        "steps trees",
        "SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY event_id)::INT AS node_id, (row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY event_id) - 1)::INT AS child_idx, parent_id, action FROM trees",
    ),
)
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.trees(spark, sf_dir).select("tree_id", "parent_id", "action", "event_id")
    return tr.build(rows, tree_id="tree_id", parent="parent_id", order=["event_id"]).drop("event_id")


@query("t04_q_backup", _tree_sql("SELECT tree_id, node_id, round(q_value, 9) AS q_value FROM b"))
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.q_backup(v.trees(spark, sf_dir), max_depth=_DEEP).withColumn("q_value", F.round("q_value", 9))


@query("t05_mean_leaf_reward", _tree_sql("SELECT tree_id, node_id, round(mean_reward, 9) AS mean_reward FROM b"))
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.mean_leaf_reward(v.trees(spark, sf_dir), max_depth=_DEEP).withColumn("mean_reward", F.round("mean_reward", 9))


_PSEUDO = """,
w AS (SELECT u.tree_id, u.node_id AS leaf_id, u.ancestor_id AS node_id, u.dist, b.mean_reward, l.depth, coalesce(l.reward, 0) AS r
      FROM leaves l JOIN up u USING (tree_id, node_id) JOIN b ON b.tree_id = u.tree_id AND b.node_id = u.ancestor_id),
x AS (SELECT *, power(0.9, dist) * (CASE WHEN 5 - depth > 1 THEN r * (1 - power(0.9, 5 - depth)) / (1 - 0.9) ELSE r END
        + sum(CASE WHEN dist > 0 THEN mean_reward * power(0.9, -dist) ELSE 0 END) OVER (PARTITION BY tree_id, leaf_id ORDER BY dist)) AS acc FROM w)
"""


@query("t06_pseudo_depth_backup", _tree_sql(_PSEUDO + "SELECT tree_id, node_id, round(max(acc), 9) AS q_value FROM x GROUP BY 1, 2"))
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.pseudo_depth_backup(v.trees(spark, sf_dir), max_depth=_DEEP).withColumn("q_value", F.round("q_value", 9))


@query("t07_reward_labels", _tree_sql("SELECT tree_id, node_id, round(mean_reward, 9) AS label FROM b JOIN trees t USING (tree_id, node_id) WHERE t.parent_id IS NOT NULL"))
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = v.trees(spark, sf_dir)
    return tr.flatten(edges, tr.mean_leaf_reward(edges, max_depth=_DEEP), "mean_reward").select("tree_id", "node_id", F.round("label", 9).alias("label"))


@query(
    "t08_tree_flatten",
    _tree_sql(
        """, p AS (SELECT u.tree_id, u.node_id, string_agg(t.action, '|' ORDER BY u.dist DESC) AS actions, count(*) AS n FROM up u JOIN trees t ON t.tree_id = u.tree_id AND t.node_id = u.ancestor_id
             WHERE t.parent_id IS NOT NULL GROUP BY 1, 2)
        SELECT p.tree_id, p.node_id, p.actions, p.n::INT AS n, round(b.q_value, 9) AS label FROM p JOIN b USING (tree_id, node_id)"""
    ),
)
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = v.trees(spark, sf_dir)
    labels = tr.flatten(edges, tr.q_backup(edges, max_depth=_DEEP))
    rows = tr.conversations(edges, max_depth=_DEEP).join(labels, tr.KEYS)
    return rows.select("tree_id", "node_id", F.array_join("actions", "|").alias("actions"), F.size("actions").alias("n"), F.round("label", 9).alias("label"))


@query("t09_min_max", _tree_sql(", m AS (SELECT *, min(q_value) OVER (PARTITION BY tree_id) AS lo, max(q_value) OVER (PARTITION BY tree_id) AS hi FROM b) SELECT tree_id, node_id, round(CASE WHEN hi = lo THEN 0.0 ELSE (q_value - lo) / (hi - lo) END, 9) AS label FROM m"))
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tr.q_backup(v.trees(spark, sf_dir), max_depth=_DEEP).withColumnRenamed("q_value", "label")
    return tr.min_max(q).withColumn("label", F.round("label", 9))


@query("t10_cap_per_tree", v.with_views("steps trees", "SELECT tree_id, node_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY md5(CAST(event_id AS VARCHAR) || '#0'), event_id) AS rn FROM trees) WHERE rn <= 40"))
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.md5(F.concat(F.col("event_id").cast("string"), F.lit("#0"))), F.col("event_id")]
    return tr.cap_per_tree(v.trees(spark, sf_dir), order, most=40).select("tree_id", "node_id", "event_id")


_ACTION = r"regexp_extract(action, '\[(.*?)\]', 1)"
# the third level's nodes move up to the root, so that trees have several root children
_BUSHY = "SELECT tree_id, node_id, CASE WHEN depth IN (2, 3) THEN 1::BIGINT ELSE parent_id END AS parent_id, node_id AS child_idx, CASE WHEN node_id > 1 THEN event_type || '[' || (prop_k % 4) || ']' ELSE 'root' END AS action FROM (SELECT t.*, s.event_type, s.prop_k FROM trees t JOIN steps s ON s.user_id = t.tree_id AND s.k = t.node_id)"


def _bushy(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = v.steps(spark, sf_dir)
    k, depth = F.col("k").cast("bigint"), F.length(F.bin("k")) - 1
    parent = F.when(depth.isin(2, 3), F.lit(1)).when(k > 1, F.floor(k / 2)).cast("bigint")
    action = F.when(k > 1, F.concat("event_type", F.lit("["), (F.col("prop_k") % 4).cast("string"), F.lit("]"))).otherwise("root")
    return steps.select(F.col("user_id").alias("tree_id"), k.alias("node_id"), parent.alias("parent_id"), k.alias("child_idx"), action.alias("action"))


@query(
    "t11_merge_branches",
    v.with_views(
        "steps trees",
        f"""WITH e AS ({_BUSHY}), f AS (SELECT tree_id, node_id, {_ACTION} AS key, row_number() OVER (PARTITION BY tree_id ORDER BY child_idx DESC) AS rn FROM e WHERE parent_id = 1),
        g AS (SELECT f.tree_id, f.node_id AS old, x.node_id AS expert_id FROM f JOIN f x ON x.tree_id = f.tree_id AND x.rn = 1 AND x.key = f.key AND x.node_id <> f.node_id)
        SELECT e.tree_id, e.node_id, coalesce(g.expert_id, e.parent_id) AS parent_id, e.action FROM e LEFT JOIN g ON g.tree_id = e.tree_id AND g.old = e.parent_id
        WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.tree_id = e.tree_id AND h.old = e.node_id)""",
    ),
)
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.merge_expert_branches(_bushy(spark, sf_dir), F.regexp_extract("action", r"\[(.*?)\]", 1)).select("tree_id", "node_id", "parent_id", "action")


@query(
    "t12_sibling_dedup",
    v.with_views(
        "steps trees",
        f"""WITH RECURSIVE e AS ({_BUSHY}), m AS (SELECT *, parent_id IS NULL OR row_number() OVER (PARTITION BY tree_id, parent_id, action ORDER BY child_idx) = 1 AS ok FROM e),
        r AS (SELECT tree_id, node_id, action FROM m WHERE parent_id IS NULL UNION ALL SELECT m.tree_id, m.node_id, m.action FROM r JOIN m ON m.tree_id = r.tree_id AND m.parent_id = r.node_id WHERE m.ok)
        SELECT * FROM r""",
    ),
)
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.dedup_siblings(_bushy(spark, sf_dir), F.col("action"), max_depth=_DEEP).select("tree_id", "node_id", "action")


@query("t13_node_statistics", _tree_sql("SELECT tree_id, round(avg(reward), 9) AS avg_reward, min(reward) AS min_reward, max(reward) AS max_reward, round(avg(q_value), 4) AS avg_q_value, round(min(q_value), 9) AS min_q_value, round(max(q_value), 9) AS max_q_value FROM trees JOIN b USING (tree_id, node_id) GROUP BY tree_id"))
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = v.trees(spark, sf_dir)
    stats = tr.node_statistics(edges.join(tr.q_backup(edges, max_depth=_DEEP), tr.KEYS), ["reward", "q_value"])
    return stats.withColumns({c: F.round(c, 4 if c == "avg_q_value" else 9) for c in ("avg_reward", "avg_q_value", "min_q_value", "max_q_value")})


_BEST = "SELECT user_id, chunk, min_by(reward, attempt) AS first, max(reward) AS best, avg(reward) AS mean, count(*) AS attempts FROM episodes GROUP BY user_id, chunk"


@query("t14_best_of_n", v.with_views("steps episodes", f"WITH t AS ({_BEST}) SELECT count(*) AS tasks, round(avg(first), 6) AS mean_first, round(avg(best), 6) AS mean_best, round(avg(mean), 6) AS mean_mean FROM t"))
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ep.best_of_n_summary(ep.best_of_n(v.episodes(spark, sf_dir), ["user_id", "chunk"]))
    return done.withColumns({c: F.round(c, 6) for c in ("mean_first", "mean_best", "mean_mean")})


@query("t15_eval_summary", v.with_views("steps episodes episodes_nulls", "SELECT round(sum(reward) / count(*), 6) AS average_reward, round(avg(success::INT), 6) AS success_rate FROM episodes_nulls"))
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.summary(v.episodes(spark, sf_dir, nulls=True)).select(*(F.round(c, 6).alias(c) for c in ("average_reward", "success_rate")))


@query(
    "t16_success_counts",
    v.with_views("steps episodes", "WITH t AS (SELECT sum((reward = 1.0)::INT) AS wins, min_by((reward = 1.0)::INT, attempt) AS first_won FROM episodes GROUP BY user_id, chunk) SELECT sum(wins)::BIGINT AS successes, count(*) FILTER (wins > 1) AS tasks_with_several, sum(first_won)::BIGINT AS tasks_first_won FROM t"),
)
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.success_counts(v.episodes(spark, sf_dir), ["user_id", "chunk"])


@query("t17_reward_levels", v.with_views("steps episodes", "SELECT user_id, chunk, count(DISTINCT reward) AS levels FROM episodes GROUP BY 1, 2"))
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.reward_levels(v.episodes(spark, sf_dir), ["user_id", "chunk"])


@query(
    "t18_top_paths",
    _tree_sql(
        """, s AS (SELECT u.tree_id, u.node_id AS leaf_id, sum(b.q_value) AS total, count(*) AS length FROM leaves l JOIN up u USING (tree_id, node_id) JOIN b ON b.tree_id = u.tree_id AND b.node_id = u.ancestor_id GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY round(total, 9) DESC, leaf_id) AS rank FROM s)
        SELECT tree_id, leaf_id, round(total, 9) AS total_q, length, rank::INT AS rank FROM r WHERE rank <= 3"""
    ),
)
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = v.trees(spark, sf_dir)
    return tr.top_paths(edges, tr.q_backup(edges, max_depth=_DEEP), max_depth=_DEEP).withColumn("total_q", F.round("total_q", 9))


_SCORED = "c AS (SELECT *, CASE WHEN finished THEN env_reward ELSE q_value END AS score FROM candidates)"


@query("t19_best_of_n_action", v.with_views("steps candidates", f"WITH {_SCORED} SELECT user_id, state_id, cand_idx, action, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, state_id ORDER BY score DESC, cand_idx) AS rn FROM c) WHERE rn = 1"))
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.choose_best(v.candidates(spark, sf_dir), ["user_id", "state_id"]).select("user_id", "state_id", "cand_idx", "action", "score")


_STATE = "CAST(user_id AS VARCHAR) || '_' || state_id"


@query(
    "t20_epsilon_greedy",
    v.with_views(
        "steps candidates",
        f"""WITH {_SCORED}, x AS (SELECT *, {v.draw_sql(_STATE, 20)} < 0.1 AS explored, {v.draw_sql('event_id', 21)} AS pick FROM c)
        SELECT user_id, state_id, cand_idx, explored FROM (SELECT *, row_number() OVER (PARTITION BY user_id, state_id ORDER BY CASE WHEN explored THEN pick END, CASE WHEN NOT explored THEN score END DESC NULLS LAST, cand_idx) AS rn FROM x) WHERE rn = 1""",
    ).replace("CAST(CAST(user_id AS VARCHAR) || '_' || state_id AS VARCHAR)", "(CAST(user_id AS VARCHAR) || '_' || state_id)"),
)
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.concat_ws("_", F.col("user_id").cast("string"), F.col("state_id").cast("string"))
    chosen = ep.choose_epsilon_greedy(v.candidates(spark, sf_dir), ["user_id", "state_id"], v.draw(state, 20), v.draw(F.col("event_id"), 21))
    return chosen.select("user_id", "state_id", "cand_idx", "explored")


@query("t21_prune_expand", _tree_sql(", g AS (SELECT DISTINCT u.tree_id, u.ancestor_id AS node_id FROM leaves l JOIN up u USING (tree_id, node_id) WHERE coalesce(l.reward, 0) > 50) SELECT t.tree_id, t.node_id, t.depth FROM trees t JOIN g USING (tree_id, node_id) WHERE t.depth > 1 AND t.depth <= 4"))
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.expandable(v.trees(spark, sf_dir), 1, 4, least_reward=50).select("tree_id", "node_id", "depth")


@query("t24_slice_tasks", v.with_views("steps episodes", """
WITH t AS (SELECT user_id, chunk, row_number() OVER (ORDER BY user_id, chunk) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id, chunk FROM episodes))
SELECT 'drop' AS rule, user_id, chunk, (i // (n // 7))::INT AS slice FROM t WHERE i // (n // 7) < 7 UNION ALL SELECT 'last', user_id, chunk, least(i // (n // 7), 6)::INT FROM t"""))  # fmt: skip
def t24(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = v.episodes(spark, sf_dir).select("user_id", "chunk").distinct()
    parts = [ep.slice_of(tasks, ["user_id", "chunk"], 7, rule).withColumn("rule", F.lit(rule)) for rule in ("drop", "last")]
    return parts[0].unionByName(parts[1]).select("rule", "user_id", "chunk", "slice")


_TASK_PATH = "'x/json_2.1.1/train/' || category || '-' || asin || '/game.tw-pddl'"


def _task_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.products(spark, sf_dir).withColumn("path", F.concat(F.lit("x/json_2.1.1/train/"), "category", F.lit("-"), "asin", F.lit("/game.tw-pddl")))


@query("t25_match_experts", v.with_views("products", "SELECT category || '-' || asin AS task_key, asin, ord % 100 AS expert_id FROM products WHERE ord % 3 = 0"))
def t25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _task_paths(spark, sf_dir).withColumn("task_key", ep.task_key(F.col("path")))
    # two expert trajectories for each third task, the first in order has the wanted id
    experts = rows.where("ord % 3 = 0").select("task_key", F.explode(F.array(F.struct((F.col("ord") % 100).alias("expert_id"), F.lit(1).alias("at")), F.struct(F.lit(-1).cast("bigint").alias("expert_id"), F.lit(2).alias("at")))).alias("e")).select("task_key", "e.*")
    return ep.match_experts(rows.select("task_key", "asin"), experts, "at").select("task_key", "asin", "expert_id")


@query("t26_skip_finished", v.with_views("steps episodes", "SELECT DISTINCT user_id, chunk FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM episodes d WHERE d.user_id = e.user_id AND d.chunk = e.chunk AND d.success)"))
def t26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.episodes(spark, sf_dir)
    return ep.unfinished(rows.select("user_id", "chunk").distinct(), rows.where("success"), ["user_id", "chunk"])


@query("t27_tree_layout", v.with_views("steps trees", "SELECT tree_id, node_id, depth, (row_number() OVER (PARTITION BY tree_id, depth ORDER BY node_id) - 1)::INT AS x FROM trees"))
def t27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.layout(v.trees(spark, sf_dir)).select("tree_id", "node_id", "depth", "x")


_NAMES = ["pick_and_place_simple", "pick_clean_then_place_in_recep", "pick_heat_then_place_in_recep", "pick_cool_then_place_in_recep", "look_at_obj_in_light", "pick_two_obj_and_place", "unknown_task"]
_VERBS = " ".join(f"WHEN name LIKE '{a.replace('_', '!_')}%' ESCAPE '!' THEN '{b}'" for a, b in ep.TASK_VERBS)


@query("t28_task_verbs", v.with_views("products", f"WITH n AS (SELECT asin, ([{', '.join(repr(x) for x in _NAMES)}])[(ord % 7 + 1)::INT] || '-' || asin AS name FROM products) SELECT asin, CASE {_VERBS} END AS verb FROM n"))
def t28(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("ord") % 7 + 1).cast("int")), F.lit("-"), "asin")
    return v.products(spark, sf_dir).select("asin", ep.task_verb(name).alias("verb"))
