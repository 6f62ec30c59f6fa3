"""MinHash near-duplicate documents with odd sketches (operator 4).

Method: a document is its set of distinct word shingles. One scan computes, from the whole text, an
identity of the set, 128 MinHash samples as 32 bands of 4, and an odd sketch: the samples folded
into a parity bitmap (Mitzenmacher, Pagh and Pham, "Efficient Estimation for High Similarities
using Odd Sketches", 2014). The population count of the XOR of two bitmaps estimates a high
similarity precisely, so a pair that shares a band is compared by four machine words before
anything longer moves. Pairs that pass are confirmed on their full sets, read from the texts.

At a similarity of 0.8 a pair misses all bands with probability (1 - 0.8^4)^32 < 1e-7, and the
sketch filter (``MOST_BITS``, an estimate of 0.49) with probability of about 1e-7.

Links and skew: equal sets are collapsed into one class first, pre-aggregated. Within each bucket the
sketches are compared, and of the pairs that pass only a spanning forest is written: at most one row a
member, however large a group of copies is. Its components hold every possible link; each one's
texts are read once, and all its pairs are decided exactly, by counting common shingles over an
inverted index. Again only a spanning forest of the links leaves the task. Buckets and groups beyond
a block's size are cut into blocks, and each pair of blocks is a task of its own, so a hot group is
spread and none is cut short; no link between different components is lost.

Defined results: a null or wordless text has the empty set, 0 shingles, and links with nothing; a
text with fewer words than a shingle is one shingle of all of them. Rows that share a doc_id are rows
of their own, each with the component of its text. Rows with a null doc_id are members of their class
but never name it; a component of nulls only has a null name, and its rows count as kept. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .tokens import slices
from .workers import PASSING, tidy

BANDS, ROWS = 32, 4
SKETCH_BITS = 256
#: Largest XOR population count of a pair that is still confirmed.
MOST_BITS = 81
PERCENT = 80
#: Up to this many ids (8 bytes each, counted first) a broadcast list picks rows.
BROADCAST_IDS = 2_000_000
#: Rows of a block of a bucket, and documents of a block of a group: a group has about SPREAD blocks within the bounds,
#: and more where its texts are long: about BLOCK_SHINGLES shingles go into one.
BLOCK_SHINGLES = 400_000
BUCKET_BLOCK = 2_048
SPREAD, LEAST_BLOCK, MOST_BLOCK = 16, 128, 1_024
_CACHE_WORDS = 300_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_random = np.random.default_rng(20_240_229)
_FACTORS = (_random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_OFFSETS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


class _Words(dict):
    """64-bit hashes of the words met so far, bounded."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = found
        return found


_words = _Words()
PASSING.append(_words)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles of ``size`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at 9 to 13 and 32
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(size, n)
    found = hashes[: n - size + 1]
    for j in range(1, size):
        found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - size + 1 + j])
    return np.unique(_mix(found + np.uint64(size)))


def minhash(found: np.ndarray) -> np.ndarray:
    """128 samples: the least value of the set under each of 128 permutations of 32-bit integers."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        least = np.minimum(least, (_FACTORS[:, None] * short[None, at : at + 1024] + _OFFSETS[:, None]).min(1))
    return least


def bands(samples: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band; different bands never share one on purpose."""
    rows = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return keys.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of each row of samples, as four 64-bit words."""
    n, k = samples.shape
    at = _mix((np.arange(k, dtype=np.uint64)[None, :] << np.uint64(32)) | samples.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    counts = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + at.astype(np.int64)).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1, bitorder="little").view("<i8")


def similarity(bits: np.ndarray | int, k: int = BANDS * ROWS, n: int = SKETCH_BITS) -> np.ndarray:
    """The similarity that an XOR population count estimates."""
    return 1 + n / (4 * k) * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(bits) / n))


_SIGNATURE = "doc_id bigint, print bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
_WORDS = ("s0", "s1", "s2", "s3")


def _sign(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            prints = batch.column(2)
            for a, b, texts in slices(batch.column(1), 2_000):
                sets = [shingles(t, size) for t in texts.to_pylist()]
                samples = np.array([minhash(s) for s in sets])
                whole = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                names = np.array([[w & 0xFFFFFFFFFFFFFFFF, w >> 64] for w in whole], np.uint64).view(np.int64)
                keys = bands(samples)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], prints[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), lists, *(pa.array(np.ascontiguousarray(c)) for c in odd_sketches(samples).T)],
                    names=["doc_id", "print", "n_shingles", "h1", "h2", "bands", *_WORDS],
                )

    return run


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """One row per row of (doc_id, text): hash of the text, set size, set identity, band buckets, sketch."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(_sign(size), _SIGNATURE)


def _block_pairs(rows: DataFrame, key: str, of: str, parts: Column) -> DataFrame:
    """Rows dealt to cells: every two blocks of a key meet in one cell, and each block meets itself.

    Adds cell, a struct of the key and the two blocks, and side, which of them the row is in.
    """
    placed = rows.withColumn("block", F.pmod(F.xxhash64(of), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    cell = F.struct(F.col(key).alias("key"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return placed.withColumn("cell", cell).withColumn("side", (F.col("block") > F.col("other")).cast("int")).drop("block", "other")


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal leading ``columns``, from batches in that order; a run is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(columns)]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        if held:
            last = held[-1]
            change[0] = any(last.column(i)[last.num_rows - 1].as_py() != k[0] for i, k in enumerate(keys))
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(batch)
            continue
        if starts[-1] or held:
            ready = [*held, batch.slice(0, starts[-1])]
            yield pa.Table.from_batches([b for b in ready if b.num_rows])
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Union-find over ids; ``join`` tells whether it joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(-1, dtype=np.int64)


def _sketched(percent: int):
    """Spanning edges of the pairs of each cell whose set sizes and sketches allow the similarity."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for table in _runs(batches, 3):
            cells = np.stack([table[i].to_numpy() for i in range(3)], 1)
            side, rep, n = (table[i].to_numpy() for i in (3, 4, 5))
            sketch = np.stack([table[i].to_numpy() for i in range(6, 10)], 1)
            starts = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(1)))
            ends = np.append(starts[1:], len(rep))
            size = np.repeat(ends - starts, ends - starts)
            cross = np.repeat(cells[starts, 1] != cells[starts, 2], ends - starts)
            run_of = np.repeat(np.arange(len(starts)), ends - starts)
            joined: list[tuple[int, int]] = []

            def passing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = (rep[i] != rep[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (~cross[i] | (side[i] != side[j]))
                ok[ok] = _bits(sketch[i[ok]], sketch[j[ok]]) <= MOST_BITS
                return ok

            few = np.flatnonzero(size <= 32)
            for d in range(1, int(size[few].max(initial=0))):
                i = few[few + d < len(rep)]
                i = i[run_of[i] == run_of[i + d]]
                i = i[passing(i, i + d)]
                joined.extend((p, q) for p, q in zip(rep[i].tolist(), rep[i + d].tolist()) if forest.join(p, q))
            for a, b in zip(starts[ends - starts > 32], ends[ends - starts > 32]):
                tree = np.array([forest.root(r) for r in rep[a:b].tolist()])
                for i in range(a, b - 1):
                    j = np.flatnonzero(tree[i + 1 - a :] != tree[i - a]) + i + 1
                    j = j[passing(np.full(len(j), i), j)]
                    for _, first in zip(*np.unique(tree[j - a], return_index=True)):
                        p, q = int(rep[i]), int(rep[j[first]])
                        if forest.join(p, q):
                            joined.append((p, q))
                    if len(j):
                        tree[np.isin(tree, np.append(tree[j - a], tree[i - a]))] = forest.root(int(rep[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in joined], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _common(sets: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the given rows: how many shingles it shares with every set, over an inverted index."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    posting = owner[np.argsort(term, kind="stable")]
    count = np.bincount(term)
    first = np.cumsum(count) - count
    at = np.cumsum([0, *map(len, sets)])
    for i in rows:
        mine = term[at[i] : at[i + 1]]
        sizes = count[mine]
        places = np.arange(sizes.sum()) + np.repeat(first[mine] - (np.cumsum(sizes) - sizes), sizes)
        yield i, np.bincount(posting[places], minlength=len(sets))


def links_of(reps: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, of both sides of a cell if it is of two blocks."""
    n = np.array([len(s) for s in sets])
    tree = np.arange(len(sets))
    for i, both in _common(sets, np.flatnonzero(sides == 0) if cross else np.arange(len(sets))):
        linked = 100 * both >= percent * (n[i] + n - both)
        if cross:
            linked &= sides == 1
        joined = np.unique(np.append(tree[linked], tree[i]))
        if len(joined) > 1:
            tree[np.isin(tree, joined)] = joined[0]
    return [(int(reps[i]), int(reps[root])) for i, root in enumerate(tree) if root != i and reps[i] != reps[root]]


def _confirmed(size: int, percent: int):
    """Spanning edges of the exact links of each cell, from the texts of its documents."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            cells = np.stack([table[i].to_numpy() for i in range(3)], 1)
            starts = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(1)))
            found: list[tuple[int, int]] = []
            for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
                part = table.slice(a, b - a)
                if b - a > 1:
                    sets = [shingles(t, size) for t in part[5].to_pylist()]
                    found += links_of(part[4].to_numpy(), sets, part[3].to_numpy(), cells[a, 1] != cells[a, 2], percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _by_cell(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a cell next to each other, in one task: (key, low, high, side, columns)."""
    flat = rows.select(F.col("cell.key").alias("key"), F.col("cell.low").alias("low"), F.col("cell.high").alias("high"), "side", *columns)
    return flat.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side")


def candidate_edges(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest, per task, of all pairs that share a bucket and whose sketches pass."""
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    rows = members.join(shared, "bucket")
    cells = _block_pairs(rows, "bucket", "node", F.ceil(F.col("many") / BUCKET_BLOCK)).select("node", "cell", "side")
    cells = cells.join(nodes.select("node", "n_shingles", *_WORDS), "node")
    return _by_cell(cells, "node", "n_shingles", *_WORDS).mapInArrow(_sketched(percent), "a bigint, b bigint")


def _picked(docs: DataFrame, asked: DataFrame, how: str, doc: str = "doc_id", text: str = "print") -> DataFrame:
    """Rows of ``docs`` by doc_id and hash of text, where ``asked`` has (ask_id, ask_print): a broadcast list up to a counted bound."""
    if asked.count() <= BROADCAST_IDS:
        asked = F.broadcast(asked)
    return docs.join(asked, docs[doc].eqNullSafe(asked["ask_id"]) & (docs[text] == asked["ask_print"]), how)


def confirmed_edges(groups: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest, per cell, of the exact links within each group.

    ``groups`` is (node, component, n_shingles, ask_id, ask_print), saved; ``docs`` is (doc_id, text, print).
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("many"), F.sum("n_shingles").alias("shingles"))
    block = F.least(F.greatest(F.ceil(F.col("many") / SPREAD), F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    parts = F.greatest(F.ceil(F.col("many") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    cells = _block_pairs(groups.select("node", "component").join(sizes, "component"), "component", "node", parts).select("node", "cell", "side")
    asked = groups.select("node", "ask_id", "ask_print")
    # one text a class, even where rows repeat
    texts = _picked(docs, asked, "inner").groupBy("node").agg(F.max("text").alias("text")).withColumnRenamed("node", "of")
    return _by_cell(cells.join(texts, cells["node"] == texts["of"]), "node", "text").mapInArrow(_confirmed(size, percent), "a bigint, b bigint")


def _grouped(docs: DataFrame, shingle_words: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(signed rows, classes with their component and its name); a class is a set that some rows have. Both saved."""
    signed = scratch.save(signatures(docs, shingle_words), "signed")
    first = [F.first(c).alias(c) for c in ("n_shingles", "bands", *_WORDS)]
    named = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "print")).alias("voice")  # a row whose text stands for the class
    classes = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(named, *first)
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")  # numbers hold once saved

    candidates = scratch.save(candidate_edges(classes, percent), "candidates")
    labels = components(candidates, scratch, "cc-candidates").withColumnRenamed("node", "of")
    asked = classes.select("node", "n_shingles", F.col("voice.doc_id").alias("ask_id"), F.col("voice.print").alias("ask_print"))
    groups = scratch.save(asked.join(labels, asked["node"] == labels["of"]).drop("of"), "groups")
    links = scratch.save(confirmed_edges(groups, docs.withColumn("print", F.xxhash64("text")), shingle_words, percent), "links")
    scratch.drop("candidates", "groups")
    labels = components(links, scratch, "cc-links").withColumnRenamed("node", "of")

    joined = classes.select("h1", "h2", "node", "voice").join(labels, classes["node"] == labels["of"], "left").select("h1", "h2", "voice", F.coalesce("component", "node").alias("component"))
    joined = scratch.save(joined, "joined")
    scratch.drop("classes", "links")
    chosen = joined.groupBy("component").agg(F.min("voice").alias("chosen"))
    named = scratch.save(joined.drop("voice").join(chosen, "component"), "named")
    scratch.drop("joined")
    return signed, named


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    signed, named = _grouped(_texts(docs, id_col, text_col), shingle_words, percent, scratch)
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    # the empty set has an identity too, but no class
    component = F.when(F.col("n_shingles") > 0, F.col("chosen.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, *, shingle_words: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each component, the one with the least doc_id, nulls last, and all rows without words.

    Texts of kept rows are not shuffled unless the kept row of some component is repeated.
    """
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    signed, named = _grouped(_texts(docs, id_col, text_col), shingle_words, percent, scratch)
    rows = signed.where("n_shingles > 0").select("doc_id", "print", "h1", "h2").join(named, ["h1", "h2"])
    stays = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("print") == F.col("chosen.print"))
    found = scratch.save(rows.groupBy("doc_id", "print").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("many")), "result")
    asked = lambda which: found.where(which).select(F.col("doc_id").alias("ask_id"), F.col("print").alias("ask_print"))
    id_, print_ = (f"dedup_{n}" + "_" * max(map(len, docs.columns)) for n in ("id", "print"))  # longer than any name there
    keyed = docs.select("*", F.col(f"`{id_col}`").cast("bigint").alias(id_), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias(print_))
    kept = _picked(keyed, asked("not stays"), "left_anti", id_, print_)
    if found.where("stays and many > 1").limit(1).count():
        again = _picked(kept, asked("stays and many > 1"), "left_semi", id_, print_).dropDuplicates([id_, print_])
        kept = _picked(kept, asked("stays and many > 1"), "left_anti", id_, print_).unionByName(again)
    return kept.select(*[f"`{c}`" for c in docs.columns])


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS t FROM s),
f AS (SELECT t, count(*) AS many FROM x GROUP BY t),
-- a similar pair shares one of each document's rarest shingles: as many as may be missing, and one more
p AS (
  SELECT x.doc_id, x.t, n.n, row_number() OVER (PARTITION BY x.doc_id ORDER BY f.many, x.t) AS place
  FROM x JOIN f USING (t) JOIN n USING (doc_id)),
c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.t = b.t AND a.doc_id < b.doc_id
  WHERE a.place <= a.n - ceil(0.8 * a.n) + 1 AND b.place <= b.n - ceil(0.8 * b.n) + 1
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT a, b, len(list_intersect(u.g, v.g)) AS common, len(u.g) + len(v.g) AS total FROM c JOIN s u ON u.doc_id = a JOIN s v ON v.doc_id = b),
e AS (SELECT a, b FROM i WHERE 100 * common >= 80 * (total - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS other FROM s UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.node = n.doc_id
"""
