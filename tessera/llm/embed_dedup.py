"""Near-duplicate vectors by dual traversal of cover trees (operator 10).

Method: unit vectors lie on a sphere, where cosine >= t is distance <= sqrt(2 - 2t). Equal vectors
are first collapsed into one class with its multiplicity. Classes are dealt to blocks by their
nearest pivot (the top of the tree); each block builds a cover tree with halving radii, in which a
node knows its centre, its covering radius and its number of vectors. A pair of trees is walked
level by level: a node pair whose centres are further apart than both covering radii and the link
distance is pruned; a pair whose farthest members must still be linked is accepted whole; the rest
descend, and small remainders, or nodes of too few points to be worth bounding, are compared by their
cosines: tiles in single precision find what may reach the threshold, and that is decided in double
precision. So every pair is decided exactly, and no group's pairs are written out: a task returns counts of links and one
spanning star per component of what it saw.

Plan: a block holds at most ``BLOCK`` classes; a pivot's surplus is split by hash into further
blocks, so a hot group of near copies spreads over many tasks. Each tree is built once and saved.
Block pairs meet in a Cartesian product of the saved table with itself, which reads it again and
writes nothing; pairs that the blocks' own covering radii exclude go before their vectors reach
Python. Vectors are moved twice (to meet their copies, and to their block) and saved twice, whatever the
size; everything else goes by class or by a hash of 128 bits. The work on data without close
groups is quadratic in the number of blocks, as for any exact method; the saved constant is one
matrix product of the tree centres.

Defined results: vectors that are null, zero, empty or hold a null or non-finite component link
with nothing: 0 links, their own id as component. Shorter vectors count as padded with zeros. Rows
sharing an id are separate rows, each with its own links, and a component is named by its smallest
id. Ids that are null get no component of their own. Labels and other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .topk import usable
from .workers import tidy

THRESHOLD = 0.95
BLOCK = 4_096
LEAST_PIVOTS = 16
MOST_PIVOTS = 4_096
#: Radii of the tree's levels; below the last one a node's members are leaves.
RADII = (1.0, 0.5, 0.25)
#: Node pairs with at most this many vector pairs are compared directly.
DIRECT = 1 << 20
#: Nodes with fewer points than this on average are not bounded but compared point by point.
MEMBERS = 8
#: Points of either side whose cosines are worked out at a time (a tile of single precision stays in a core's cache), and links
#: that a tile may hold to be decided pair by pair, those of ``MOST`` tiles at once.
TILE, FEW, MOST = 512, 2_048, 512
#: Bytes of block pairs that go to a Python worker at a time.
BATCH_BYTES = 32_000_000
_SLACK = 1e-6


def _cover(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the index of its centre: greedy, so centres are more than ``radius`` apart."""
    n = len(points)
    centre = np.full(n, -1)
    for a in range(0, n, 512):
        open_ = np.flatnonzero(centre[a : a + 512] < 0) + a
        if not len(open_):
            continue
        rest = np.flatnonzero(centre < 0)
        near = points[open_] @ points[rest].T >= 1 - radius * radius / 2
        where = np.searchsorted(rest, open_)
        free = np.ones(len(rest), bool)
        for row, i, p in zip(near, where, open_):
            if free[i]:
                got = row & free
                got[i] = True
                free &= ~got
                centre[rest[got]] = p
    return centre


class Tree:
    """Points in an order in which every node's members are consecutive; nodes level by level.

    ``bounds`` holds, for each level, where its nodes begin, and the number of points at the end.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, weights: np.ndarray, bounds: list[np.ndarray]):
        self.points, self.ids, self.weights, self.bounds = points, ids, weights, bounds
        self.singles = points.astype(np.float32)
        self._levels: dict[int, tuple] = {}

    def level(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, centres, covering radii) of a level's nodes, worked out when first asked for."""
        if at not in self._levels:
            points, (starts, ends) = self.points, (self.bounds[at][:-1], self.bounds[at][1:])
            centres = points[starts]
            owner = np.repeat(np.arange(len(starts)), ends - starts)
            cosine = np.ones(len(points))
            for a in range(0, len(owner), 8192):
                cosine[a : a + 8192] = np.einsum("ij,ij->i", points[a : a + 8192], centres[owner[a : a + 8192]])
            radii = np.sqrt(np.maximum(0, 2 - 2 * np.minimum.reduceat(cosine, starts))) if len(starts) else np.zeros(0)
            radii[ends - starts == 1] = 0
            self._levels[at] = starts, ends, centres, radii
        return self._levels[at]

    @staticmethod
    def order(points: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """An order of the points and the bounds of the levels: each node's cover refines its parent's."""
        order, bounds = np.arange(len(points)), [np.array([0, len(points)])]
        for radius in RADII:
            cuts, pieces = [0], []
            for a, b in zip(bounds[-1][:-1], bounds[-1][1:]):
                members = order[a:b]
                if b - a == 1:
                    pieces.append(members)
                    cuts.append(b)
                    continue
                centre = _cover(points[members], radius)
                by = np.argsort(centre, kind="stable")
                pieces.append(members[by])
                cuts.extend(a + np.flatnonzero(np.diff(centre[by])) + 1)
                cuts.append(b)
            order = np.concatenate(pieces) if pieces else order
            bounds.append(np.array(cuts))
        return order, bounds[1:]

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> Tree:
        order, bounds = cls.order(points)
        return cls(points[order], ids[order], weights[order], bounds)


def _labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label within each component of a bipartite graph, starting from the given labels."""
    big = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], big).min(1))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], big).min(0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _by_radius(in_a: np.ndarray, radius_a: np.ndarray, in_b: np.ndarray, radius_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles of two node lists whose nodes have about equal radii, so that one bound prunes a whole tile well."""
    edges = np.array([0.0, *sorted(RADII)])
    group_a, group_b = np.searchsorted(edges, radius_a), np.searchsorted(edges, radius_b)
    for g in np.unique(group_a):
        rows = in_a[group_a == g]
        for h in np.unique(group_b):
            cols = in_b[group_b == h]
            for at in range(0, len(rows), 2048):
                yield rows[at : at + 2048], cols


def _roots(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node of its component in the graph of edges (p, q)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], least)
        np.minimum.at(new, root[q], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def dual_traversal(a: Tree, b: Tree, same: bool, threshold: float = THRESHOLD) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """(links of each id, spanning edges) over all pairs between two trees, or within one."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    width = a.points.shape[1]
    # single precision errs by less than width + 4 units in the last place: what may reach the threshold is decided in double
    floor = threshold - 2 * (width + 4) * 2.0**-24
    links_a = np.zeros(len(a.ids), np.int64)
    links_b = links_a if same else np.zeros(len(b.ids), np.int64)
    edges: set[tuple[int, int]] = set()
    few: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(x: np.ndarray, y: np.ndarray, own: bool) -> None:
        """Cosines of a's points x with b's points y; ``own``: the same points, each pair once."""
        left, right = a.singles[x], b.singles[y]
        for s in range(0, len(x), TILE):
            for t in range(s if own else 0, len(y), TILE):
                cosine = left[s : s + TILE] @ right[t : t + TILE].T
                if cosine.max() < floor:
                    continue
                p, q = np.divmod(np.flatnonzero(cosine >= floor), cosine.shape[1])
                if own and s == t:
                    p, q = p[p < q], q[p < q]
                if len(p) > FEW:
                    many(x[s : s + TILE], y[t : t + TILE], own and s == t)
                elif len(p):
                    few.append((x[s + p], y[t + q]))
                    if len(few) == MOST:
                        decide()

    def many(i: np.ndarray, j: np.ndarray, own: bool) -> None:
        """Links of a tile that holds many."""
        linked = a.points[i] @ b.points[j].T >= threshold
        if own:
            linked = np.triu(linked, 1)
        links_a[i] += linked @ b.weights[j]
        links_b[j] += a.weights[i] @ linked
        left, right = _labels(linked, a.ids[i], b.ids[j])
        edges.update((p, q) for p, q in zip(np.concatenate([a.ids[i], b.ids[j]]).tolist(), np.concatenate([left, right]).tolist()) if p != q)

    def decide() -> None:
        """Links of the tiles that hold few."""
        p, q = (np.concatenate(x) for x in zip(*few))
        few.clear()
        step = max(1, (1 << 22) // width)
        linked = np.concatenate([np.einsum("ij,ij->i", a.points[p[k : k + step]], b.points[q[k : k + step]]) for k in range(0, len(p), step)]) >= threshold
        p, q = p[linked], q[linked]
        np.add.at(links_a, p, b.weights[q])
        np.add.at(links_b, q, a.weights[p])
        ids, at = np.unique(np.concatenate([a.ids[p], b.ids[q]]), return_inverse=True)
        root = _roots(at[: len(p)], at[len(p) :], len(ids))
        out = root != np.arange(len(ids))
        edges.update(zip(ids[out].tolist(), ids[root[out]].tolist()))

    def accept(x: slice, y: slice) -> None:
        ids_a, ids_b = a.ids[x], b.ids[y]
        links_a[x] += b.weights[y].sum()
        links_b[y] += a.weights[x].sum()
        root = int(min(ids_a.min(), ids_b.min()))
        edges.update((i, root) for i in [*ids_a.tolist(), *ids_b.tolist()] if i != root)

    def walk(level: int, in_a: np.ndarray, in_b: np.ndarray, mirrored: bool) -> None:
        """Pairs of the given neighbouring nodes of a level; ``mirrored``: the same nodes twice, each pair once."""
        cuts_a, cuts_b = a.bounds[level], b.bounds[level]
        x, y = (np.arange(cuts[some[0]], cuts[some[-1] + 1]) for cuts, some in ((cuts_a, in_a), (cuts_b, in_b)))
        if MEMBERS * len(in_a) > len(x) or MEMBERS * len(in_b) > len(y):  # nodes of so few points exclude less than they cost
            compare(x, y, mirrored)
            return
        (start_a, end_a, centre_a, radius_a), (start_b, end_b, centre_b, radius_b) = a.level(level), b.level(level)
        for rows, cols in _by_radius(in_a, radius_a[in_a], in_b, radius_b[in_b]):
            # a node pair survives if its centres are within reach and both radii: first by the widest radii of all
            cosine = centre_a[rows] @ centre_b[cols].T
            widest = radius_a[rows].max() + radius_b[cols].max() + reach + _SLACK
            some, other = np.nonzero(cosine >= 1 - widest * widest / 2)
            far = radius_a[rows[some]] + radius_b[cols[other]] + (reach + _SLACK)
            near = cosine[some, other] >= 1 - far * far / 2
            if mirrored:
                near &= rows[some] <= cols[other]
            some, other = some[near], other[near]
            p, q = rows[some], cols[other]
            size = (end_a - start_a)[p] * (end_b - start_b)[q]
            apart = np.sqrt(np.maximum(0, 2 - 2 * cosine[some, other]))
            self_pair = (p == q) & same
            whole = ~self_pair & (size > 64) & (apart + radius_a[p] + radius_b[q] <= reach - _SLACK)
            deep = ~whole & (size > DIRECT) & (level + 1 < len(a.bounds))
            for k in np.flatnonzero(whole | deep | self_pair):
                x, y = slice(int(start_a[p[k]]), int(end_a[p[k]])), slice(int(start_b[q[k]]), int(end_b[q[k]]))
                if whole[k]:
                    accept(x, y)
                elif deep[k]:
                    below_a, below_b = a.bounds[level + 1], b.bounds[level + 1]
                    walk(level + 1, np.arange(*np.searchsorted(below_a, [x.start, x.stop])), np.arange(*np.searchsorted(below_b, [y.start, y.stop])), bool(self_pair[k]))
                elif size[k] > 1:
                    compare(np.arange(x.start, x.stop), np.arange(y.start, y.stop), True)
            rest = np.flatnonzero(~(whole | deep | self_pair))
            starts = np.flatnonzero(np.append(True, some[rest][1:] != some[rest][:-1])) if len(rest) else rest
            for first, last in zip(starts, [*starts[1:], len(rest)]):
                k = rest[first:last]
                x = np.arange(start_a[p[k[0]]], end_a[p[k[0]]])
                compare(x, np.concatenate([np.arange(s, e) for s, e in zip(start_b[q[k]], end_b[q[k]])]), False)

    if len(a.ids) and len(b.ids):
        walk(0, np.arange(len(a.bounds[0]) - 1), np.arange(len(b.bounds[0]) - 1), same)
        if few:
            decide()
    links: dict[int, int] = {}
    for ids, n in ((a.ids, links_a),) if same else ((a.ids, links_a), (b.ids, links_b)):
        links.update(zip(ids[n > 0].tolist(), n[n > 0].tolist()))
    return links, list(edges)


def _unit(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)


def _normal(m: np.ndarray) -> np.ndarray:
    m = m / np.maximum(np.abs(m).max(1, keepdims=True), np.finfo(float).tiny)  # squares neither vanish nor overflow
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _pairs(width: int, threshold: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                trees = []
                for side in ("a", "b")[: 1 if row["a"] == row["b"] else 2]:
                    if side == "a" and last and last[0] == row["a"]:  # a task meets one block with many before the next
                        trees.append(last[1])
                        continue
                    points = _normal(np.frombuffer(row[f"{side}_vectors"], row[f"{side}_kind"]).astype(np.float64).reshape(-1, width))
                    cuts = np.frombuffer(row[f"{side}_cuts"], "<i4").astype(np.int64)
                    bounds = np.split(cuts, np.flatnonzero(cuts == len(points))[:-1] + 1)
                    trees.append(Tree(points, np.frombuffer(row[f"{side}_ids"], np.int64), np.frombuffer(row[f"{side}_weights"], np.int64), bounds))
                last = (row["a"], trees[0])
                links, edges = dual_traversal(trees[0], trees[-1], len(trees) == 1, threshold)
                a, b = [*links, *(p for p, _ in edges)], [None] * len(links) + [q for _, q in edges]
                n = [*links.values(), *[0] * len(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    return run


def near_duplicates(embeddings: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    scratch = scratch or Scratch(spark, "embed")
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"))
    fit = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    width = rows.where(fit).agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    kind = "<f4" if "float" in dict(rows.dtypes)["embedding"] else "<f8"
    padded = F.concat("embedding", F.array_repeat(F.lit(0).cast(dict(rows.dtypes)["embedding"][6:-1]), F.lit(width) - F.size("embedding")))
    rows = rows.withColumn("vector", F.when(fit, padded))
    key = F.when(F.col("vector").isNotNull(), F.struct(F.xxhash64("vector").alias("x"), F.xxhash64(F.lit(1), "vector").alias("y"))).alias("key")
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("class"), "vector", key, "least", "weight"), "classes")  # ids hold once saved
    n = classes.count()

    # the tree's top: pivots from a bounded sample in hash order, which only decides who shares a block
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(n / block)))
    sample = classes.orderBy(F.xxhash64("vector"), "class").limit(wanted).select("vector").toArrow()
    pivots = _normal(_unit(sample["vector"], width))

    @tidy
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _normal(_unit(batch.column(1), width))
            found = np.concatenate([(points[a : a + 4096] @ pivots.T).argmax(1) for a in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=["class", "vector", "weight", "pivot"])

    dealt = classes.select("class", "vector", "weight").mapInArrow(nearest, f"class bigint, vector {dict(classes.dtypes)['vector']}, weight bigint, pivot int")
    sizes = scratch.save(dealt.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "sizes")  # at most MOST_PIVOTS rows
    total = sizes.agg(F.sum("parts")).first()[0]
    blocked = dealt.join(F.broadcast(sizes), "pivot").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))

    parts = ("vectors", "ids", "weights", "cuts")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        raw = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(table.num_rows, width)
        points = _normal(raw.astype(np.float64))
        centre = _normal(points.sum(0, keepdims=True) + 1e-300)[0]
        spread = math.sqrt(max(0.0, 2 - 2 * float((points @ centre).min()))) + _SLACK
        order, bounds = Tree.order(points)
        rest = [raw[order], table["class"].to_numpy()[order], table["weight"].to_numpy()[order], np.concatenate(bounds).astype("<i4")]
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([centre.tolist()]), pa.array([spread]), *(pa.array([x.tobytes()]) for x in rest)]
        return pa.table(columns, names=["pivot", "part", "centre", "spread", *parts])

    # few blocks a file, so that the readers of the saved table get like shares of it
    built = blocked.repartition(max(LEAST_PIVOTS, -(-total // 4)), "pivot", "part").groupBy("pivot", "part").applyInArrow(build, "pivot int, part int, centre array<double>, spread double, vectors binary, ids binary, weights binary, cuts binary")
    built = scratch.save(built.select("pivot", "part", "centre", "spread", *parts), "blocks")
    classes = scratch.save(classes.select("class", "key", "least", "weight"), "names")
    scratch.drop("classes")

    # each pair of blocks once, in an order that gives every task of the product about as many; pruned by the covering radii
    def side(name: str) -> DataFrame:
        block_id = (F.col("pivot") * F.lit(1 << 32).cast("bigint") + F.col("part")).alias(name)
        return built.select(block_id, (F.col("pivot") + F.col("part")).alias(f"{name}_odd"), *(F.col(c).alias(f"{name}_{c}") for c in ("centre", "spread", *parts)), F.lit(kind).alias(f"{name}_kind"))

    cosine = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    once = (F.col("a") < F.col("b")) == ((F.col("a_odd") + F.col("b_odd")) % 2 == 0)
    near = (F.col("a") == F.col("b")) | ((F.col("a") != F.col("b")) & once & (apart <= F.col("a_spread") + F.col("b_spread") + F.lit(reach + _SLACK)))
    met = side("a").hint("shuffle_replicate_nl").join(side("b"), near).drop("a_odd", "b_odd", "a_centre", "b_centre", "a_spread", "b_spread")
    found = met.mapInArrow(_pairs(width, threshold), "a bigint, b bigint, n bigint")
    found = scratch.save(found, "found", max(1, BATCH_BYTES // (2 * block * width * np.dtype(kind).itemsize)))
    scratch.drop("blocks")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    labels = components(found.where("b is not null").select("a", "b"), scratch, "cc")

    per_class = classes.join(links, classes["class"] == links["a"], "left").join(labels, classes["class"] == labels["node"], "left")
    per_class = per_class.select("class", "key", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "class").alias("component"))
    per_class = scratch.save(per_class, "per-class")
    names = per_class.groupBy("component").agg(F.min("least").alias("name"))
    named = per_class.join(names, "component").select(F.col("key").alias("k"), "n", "name")
    keyed = rows.select("vec_id", key)
    out = keyed.join(named, keyed["key"] == named["k"], "left")
    component = F.when(F.col("k").isNotNull(), F.col("name")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT c.node, l.b FROM c JOIN l ON c.other = l.a),
g AS (SELECT node, min(other) AS component_id FROM c GROUP BY node)
SELECT g.node AS vec_id, (SELECT count(*) FROM l WHERE l.a = g.node)::BIGINT AS n_links, component_id, component_id = g.node AS kept FROM g
"""
