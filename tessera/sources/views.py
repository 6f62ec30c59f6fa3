"""Deterministic views that give the driver's tables the shapes the operators work on.

Each view has a Spark function and, in ``SQL``, the same rows as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views in front of its own common table expressions."""
    ctes = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in names.split())
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = True, body[14:].strip()
        joined = f"{ctes},\n{body}"
    elif body.upper().startswith("WITH"):
        joined = f"{ctes},\n{body[4:].strip()}"
    else:
        joined = f"{ctes}\n{body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}"


def draw(key: Column, seed: int) -> Column:
    """A reproducible number in [0, 1): the first 32 bits of the MD5 of the key and a seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def draw_sql(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || '#{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` numbered per user in time order: the ordinal k and the user's number of events n."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id", "user_id", "ts", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("prop_k"),
        F.row_number().over(order).alias("k"),
        F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"),
    )


SQL["steps"] = """
SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS prop_k,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events
"""


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search trees, one per user, as an edge table: node k hangs below node k div 2."""
    k = F.col("k")
    return steps(spark, sf_dir).select(
        F.col("user_id").alias("tree_id"),
        k.cast("bigint").alias("node_id"),
        F.when(k > 1, F.floor(k / 2)).cast("bigint").alias("parent_id"),
        (k % 2).cast("int").alias("child_idx"),
        (F.length(F.bin(k)) - 1).cast("int").alias("depth"),
        F.concat("event_type", F.lit("["), F.col("prop_k").cast("string"), F.lit("]")).alias("action"),
        F.when((2 * k > F.col("n")) & (F.col("event_id") % 7 == 0), None).otherwise(F.col("value")).alias("reward"),
        "event_id",
    )


SQL["trees"] = """
SELECT user_id AS tree_id, k::BIGINT AS node_id, CASE WHEN k > 1 THEN (k // 2)::BIGINT END AS parent_id, (k % 2)::INT AS child_idx,
       (length(bin(k)) - 1)::INT AS depth, event_type || '[' || prop_k || ']' AS action,
       CASE WHEN 2 * k > n AND event_id % 7 = 0 THEN NULL ELSE value END AS reward, event_id
FROM steps
"""

# leaf and ancestor at a distance, both with their own rewards
SQL["up"] = """
SELECT tree_id, node_id, node_id AS ancestor_id, 0 AS dist, parent_id AS following FROM trees
UNION ALL SELECT u.tree_id, u.node_id, t.node_id, u.dist + 1, t.parent_id FROM up u JOIN trees t ON t.tree_id = u.tree_id AND t.node_id = u.following
"""
SQL["leaves"] = "SELECT * FROM trees t WHERE NOT EXISTS (SELECT 1 FROM trees c WHERE c.tree_id = t.tree_id AND c.parent_id = t.node_id)"


def episodes(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """Evaluation episodes: three attempts a task, from consecutive events of a user; incomplete tasks dropped."""
    k = F.col("k")
    chunk = F.floor((k - 1) / 3)
    reward = F.least(F.col("value") / 100, F.lit(1.0))
    return steps(spark, sf_dir).where((chunk + 1) * 3 <= F.col("n")).select(
        "user_id", chunk.cast("bigint").alias("chunk"), ((k - 1) % 3).cast("int").alias("attempt"), "event_id",
        (F.when(F.col("event_id") % 11 != 0, reward) if nulls else reward).alias("reward"),
        (F.col("value") >= 100).alias("success"), "event_type",
    )


SQL["episodes"] = """
SELECT user_id, ((k - 1) // 3)::BIGINT AS chunk, ((k - 1) % 3)::INT AS attempt, event_id, least(value / 100, 1.0) AS reward, value >= 100 AS success, event_type
FROM steps WHERE ((k - 1) // 3 + 1) * 3 <= n
"""
SQL["episodes_nulls"] = "SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN reward END AS reward) FROM episodes"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sets: pairs of consecutive events of a user."""
    k = F.col("k")
    return steps(spark, sf_dir).select(
        "user_id", F.floor((k - 1) / 2).cast("bigint").alias("state_id"), ((k - 1) % 2).cast("int").alias("cand_idx"), "event_id",
        F.concat("event_type", F.lit("["), F.col("prop_k").cast("string"), F.lit("]")).alias("action"),
        (F.col("value") / 500).alias("q_value"), F.least(F.col("value") / 100, F.lit(1.0)).alias("env_reward"), (F.col("event_type") == "purchase").alias("finished"),
    )


SQL["candidates"] = """
SELECT user_id, ((k - 1) // 2)::BIGINT AS state_id, ((k - 1) % 2)::INT AS cand_idx, event_id, event_type || '[' || prop_k || ']' AS action,
       value / 500 AS q_value, least(value / 100, 1.0) AS env_reward, event_type = 'purchase' AS finished FROM steps
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


SQL["turns"] = "SELECT conv_id, turn, role, text FROM conversations"


def relabelled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, every third one with the role of the turn before it, so that some neighbours have one role."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    role = F.when((F.col("turn") % 3 == 2) & (before != "system"), before).otherwise(F.col("role"))
    return turns(spark, sf_dir).select("conv_id", "turn", role.alias("role"), "text")


SQL["relabelled_turns"] = """
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 AND before <> 'system' THEN before ELSE role END AS role, text
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw catalogue from ``part``: price texts in three forms, some missing."""
    price = F.format_string("$%.2f", "p_retailprice")
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("ord"), key.cast("string").alias("asin"), F.col("p_type").alias("category"), F.col("p_brand").alias("query"), F.col("p_name").alias("name"),
        F.concat_ws(" › ", "p_type", "p_brand").alias("product_category"),
        F.when(key % 10 == 0, None).when(key % 3 == 0, F.concat(price, F.lit(" to "), F.format_string("$%.2f", F.col("p_retailprice") + 10))).otherwise(price).alias("pricing"),
        F.split("p_name", " ").alias("attributes"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("retail"),
    )


SQL["products"] = """
SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS asin, p_type AS category, p_brand AS query, p_name AS name, p_type || ' › ' || p_brand AS product_category,
       CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN printf('$%.2f', p_retailprice) || ' to ' || printf('$%.2f', p_retailprice + 10)
            ELSE printf('$%.2f', p_retailprice) END AS pricing,
       string_split(p_name, ' ') AS attributes, p_size AS size, p_retailprice AS retail
FROM part
"""


def goal_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: the goal product (first line) and the purchased one (second line), with the goal's price limit."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(order).alias("rn")).where("rn <= 2")
    picked = lines.groupBy("l_orderkey").agg(F.max(F.when(F.col("rn") == 1, F.col("l_partkey"))).alias("goal_key"), F.max(F.when(F.col("rn") == 2, F.col("l_partkey"))).alias("bought_key")).where("bought_key is not null")
    parts = products(spark, sf_dir)
    cols = ["category", "query", "name", "product_category", "attributes", "size", "retail"]
    goal = parts.select(F.col("ord").alias("goal_key"), *(F.col(c).alias(f"goal_{c}") for c in cols))
    bought = parts.select(F.col("ord").alias("bought_key"), *(F.col(c).alias(f"bought_{c}") for c in cols))
    return picked.join(goal, "goal_key").join(bought, "bought_key").withColumn("price_upper", F.col("goal_retail") + 10 * (F.col("l_orderkey") % 3))


SQL["goal_purchases"] = """
SELECT p.l_orderkey, p.goal_key, p.bought_key,
       g.category AS goal_category, g.query AS goal_query, g.name AS goal_name, g.product_category AS goal_product_category, g.attributes AS goal_attributes, g.size AS goal_size, g.retail AS goal_retail,
       b.category AS bought_category, b.query AS bought_query, b.name AS bought_name, b.product_category AS bought_product_category, b.attributes AS bought_attributes, b.size AS bought_size, b.retail AS bought_retail,
       g.retail + 10 * (p.l_orderkey % 3) AS price_upper
FROM (SELECT l_orderkey, max(CASE WHEN rn = 1 THEN l_partkey END) AS goal_key, max(CASE WHEN rn = 2 THEN l_partkey END) AS bought_key
      FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem)
      WHERE rn <= 2 GROUP BY l_orderkey) p
JOIN products g ON g.ord = p.goal_key JOIN products b ON b.ord = p.bought_key
WHERE p.bought_key IS NOT NULL
"""
