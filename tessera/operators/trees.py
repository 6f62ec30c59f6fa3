"""Search trees as edge tables: (tree_id, node_id, parent_id, child_idx, depth, reward, ...).

A tree's levels are not recursed through. ``ancestors`` doubles paths: after step i a node knows
its next 2^i ancestors, so ``max_depth`` levels take log2 of as many joins on (tree, node), all of
one shape, and a huge tree is spread over tasks like any other rows. Back-ups are then one explode
of the leaves' paths and one pre-aggregated group by.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["tree_id", "node_id"]
GAMMA = 0.9


def build(steps: DataFrame, *, tree_id: str, parent: str, order: list[str]) -> DataFrame:
    """Edge table from child rows that name their parent: node ids and child ranks in the given order."""
    ids = Window.partitionBy(tree_id).orderBy(*order)
    siblings = Window.partitionBy(tree_id, parent).orderBy(*order)
    return steps.withColumn("node_id", F.row_number().over(ids)).withColumn("child_idx", F.row_number().over(siblings) - 1)


def ancestors(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Per node: path, its ancestors from the parent up to the root.

    ``max_depth`` bounds the number of ancestors of any node; without it, the column depth says how many there are.
    """
    if max_depth is None:
        max_depth = edges.agg(F.max("depth")).first()[0] or 0
    path = edges.select(*KEYS, F.when(F.col("parent_id").isNotNull(), F.array("parent_id")).otherwise(F.array().cast("array<bigint>")).alias("path"))
    for _ in range(math.ceil(math.log2(max(1, max_depth)))):
        above = path.select(F.col("tree_id").alias("t"), F.col("node_id").alias("last"), F.col("path").alias("more")).where(F.size("path") > 0)
        joined = path.join(above, (F.col("tree_id") == F.col("t")) & (F.try_element_at("path", F.lit(-1)) == F.col("last")), "left")
        path = joined.select(*KEYS, F.when(F.col("more").isNotNull(), F.concat("path", "more")).otherwise(F.col("path")).alias("path"))
    return path


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes without children."""
    inner = edges.where("parent_id is not null").select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).distinct()
    return edges.join(inner, (F.col("tree_id") == F.col("t")) & (F.col("node_id") == F.col("p")), "left_anti")


def _leaf_paths(edges: DataFrame, max_depth: int) -> DataFrame:
    """One row per leaf and node on its way to the root, itself included at distance 0."""
    paths = leaves(edges).select(*KEYS, "depth", F.coalesce("reward", F.lit(0.0)).alias("leaf_reward")).join(ancestors(edges, max_depth), KEYS)
    return paths.select("tree_id", F.col("node_id").alias("leaf_id"), "depth", "leaf_reward", F.posexplode(F.concat(F.array("node_id"), F.col("path"))).alias("dist", "node_id"))


def q_backup(edges: DataFrame, gamma: float = GAMMA, max_depth: int | None = None) -> DataFrame:
    """(tree_id, node_id, q_value): leaves keep their reward (null is 0), inner rewards are 0, Q = gamma * best child's Q.

    As gamma is positive, the best child's Q is the greatest discounted leaf reward below.
    """
    reached = _leaf_paths(edges, max_depth)
    return reached.groupBy(*KEYS).agg(F.max(F.pow(F.lit(gamma), F.col("dist")) * F.col("leaf_reward")).alias("q_value"))


def mean_leaf_reward(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(tree_id, node_id, mean_reward): the mean over all leaves below a node, null leaves counting 0."""
    return _leaf_paths(edges, max_depth).groupBy(*KEYS).agg(F.avg("leaf_reward").alias("mean_reward"))


def pseudo_depth_backup(edges: DataFrame, gamma: float = GAMMA, height: int = 5, max_depth: int | None = None) -> DataFrame:
    """(tree_id, node_id, q_value): mean leaf rewards backed up; a leaf above the last level counts as if it went on.

    A leaf at depth d has h = height - d levels left: Q = r (1 - gamma^h) / (1 - gamma) where h > 1, else r.
    An inner node's Q is its mean reward and gamma times the best child's Q.
    """
    reached = _leaf_paths(edges, max_depth)
    means = reached.groupBy(*KEYS).agg(F.avg("leaf_reward").alias("mean_reward"))
    left = F.lit(height) - F.col("depth")
    leaf_q = F.when(left > 1, F.col("leaf_reward") * (1 - F.pow(F.lit(gamma), left)) / (1 - gamma)).otherwise(F.col("leaf_reward"))
    along = Window.partitionBy("tree_id", "leaf_id").orderBy("dist").rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(F.col("dist") > 0, F.col("mean_reward") * F.pow(F.lit(gamma), -F.col("dist"))).otherwise(0.0)
    backed = reached.join(means, KEYS).withColumn("acc", F.pow(F.lit(gamma), F.col("dist")) * (leaf_q + F.sum(share).over(along)))
    return backed.groupBy(*KEYS).agg(F.max("acc").alias("q_value"))


def flatten(edges: DataFrame, labels: DataFrame, label: str = "q_value") -> DataFrame:
    """One sample per node but the root: (tree_id, node_id, label) of nodes with a label."""
    return edges.where("parent_id is not null").join(labels, KEYS).where(F.col(label).isNotNull()).select(*KEYS, "action", F.col(label).alias("label"))


def conversations(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Per node but the root: the actions from the root's child down to it, as one array."""
    paths = edges.where("parent_id is not null").select(*KEYS, "action").join(ancestors(edges, max_depth), KEYS)
    on_path = paths.select(*KEYS, F.posexplode(F.concat(F.array("node_id"), F.col("path"))).alias("dist", "on_id"))
    actions = edges.where("parent_id is not null").select(F.col("tree_id").alias("t"), F.col("node_id").alias("o"), F.col("action").alias("step"))
    joined = on_path.join(actions, (F.col("tree_id") == F.col("t")) & (F.col("on_id") == F.col("o")))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), "step")))
    return joined.groupBy(*KEYS).agg(F.transform(ordered, lambda s: s["step"]).alias("actions"))  # at most max_depth a node


def min_max(samples: DataFrame, key: str = "label", by: str = "tree_id") -> DataFrame:
    """``key`` scaled to 0..1 within each tree; 0 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(key).over(w), F.max(key).over(w)
    return samples.withColumn(key, F.when(high == low, 0.0).otherwise((F.col(key) - low) / (high - low)))


def cap_per_tree(samples: DataFrame, order, most: int = 300) -> DataFrame:
    """At most ``most`` rows a tree, the first in the given (hash) order: a uniform draw that reruns agree on."""
    return samples.withColumn("rn", F.row_number().over(Window.partitionBy("tree_id").orderBy(*order))).where(F.col("rn") <= most).drop("rn")


def merge_expert_branches(edges: DataFrame, key) -> DataFrame:
    """New parents: a root child whose key equals the last (expert) root child's is dissolved into it.

    ``key`` is a column of the edge table; the dissolved nodes' children hang below the expert's.
    """
    roots = edges.where("parent_id is null").select(F.col("tree_id").alias("t"), F.col("node_id").alias("root"))
    first = edges.join(roots, (F.col("tree_id") == F.col("t")) & (F.col("parent_id") == F.col("root"))).select(*KEYS, "child_idx", key.alias("key"))
    expert = first.groupBy("tree_id").agg(F.max_by(F.struct("node_id", "key"), F.struct("child_idx", "node_id")).alias("e"))
    gone = first.join(expert, "tree_id").where((F.col("key") == F.col("e.key")) & (F.col("node_id") != F.col("e.node_id")))
    gone = gone.select(F.col("tree_id").alias("t"), F.col("node_id").alias("old"), F.col("e.node_id").alias("expert_id"))
    kept = edges.join(gone, (F.col("tree_id") == F.col("t")) & (F.col("node_id") == F.col("old")), "left_anti")
    moved = kept.join(gone, (F.col("tree_id") == F.col("t")) & (F.col("parent_id") == F.col("old")), "left")
    return moved.withColumn("parent_id", F.coalesce("expert_id", "parent_id")).drop("t", "old", "expert_id")


def dedup_siblings(edges: DataFrame, key, max_depth: int | None = None) -> DataFrame:
    """The first of siblings with one key stays; whatever hangs below a dropped node goes too."""
    rank = F.row_number().over(Window.partitionBy("tree_id", "parent_id", key).orderBy("child_idx", "node_id"))
    marked = edges.withColumn("dropped", F.col("parent_id").isNotNull() & (rank > 1))
    gone = marked.where("dropped").select(F.col("tree_id").alias("t"), F.col("node_id").alias("g")).distinct()
    reach = ancestors(edges, max_depth).select(*KEYS, F.explode(F.concat(F.array("node_id"), F.col("path"))).alias("on_id"))
    lost = reach.join(gone, (F.col("tree_id") == F.col("t")) & (F.col("on_id") == F.col("g")), "left_semi").select(*KEYS).distinct()
    return marked.drop("dropped").join(lost, KEYS, "left_anti")


def node_statistics(nodes: DataFrame, columns: list[str], by: str = "tree_id") -> DataFrame:
    """Mean, least and greatest of each column per tree; nulls are left out, all null gives null."""
    return nodes.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))


def top_paths(edges: DataFrame, values: DataFrame, k: int = 3, max_depth: int | None = None) -> DataFrame:
    """The k root-to-leaf paths of a tree with the greatest sum of q_value, the root's included."""
    reached = _leaf_paths(edges, max_depth).join(values, KEYS)
    sums = reached.groupBy("tree_id", "leaf_id").agg(F.sum("q_value").alias("total_q"), F.count(F.lit(1)).alias("length"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.round("total_q", 9).desc(), "leaf_id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k)


def expandable(edges: DataFrame, min_prune_depth: int, max_depth: int, least_reward: float = 0.01) -> DataFrame:
    """Nodes to expand next: below ``min_prune_depth``, down to ``max_depth``, on a roll-out that ended above the reward."""
    ends = _leaf_paths(edges, None).where(F.col("leaf_reward") > least_reward)
    good = ends.select(*KEYS).distinct()
    return edges.join(good, KEYS, "left_semi").where((F.col("depth") > min_prune_depth) & (F.col("depth") <= max_depth))


def layout(edges: DataFrame) -> DataFrame:
    """Places for drawing: the level and the running number within the level."""
    return edges.withColumn("x", F.row_number().over(Window.partitionBy("tree_id", "depth").orderBy("node_id")) - 1)
