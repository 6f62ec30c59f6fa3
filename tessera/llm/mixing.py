"""Mixing sources to target weights by nested hash thresholds (operator 5). DataFrame code only.

Method: each document has a 48-bit hash of its doc_id. Word counts are summed by source and hash
bucket; a running sum over a source's buckets finds the one bucket in which its budget ends. Only
the rows of that boundary bucket are summed again, by the next bits of the hash, until it holds a
single document. Where documents share a doc_id, or have none, a hash of the text decides among
them, and among equal rows their place in the table. What remains is one threshold per source, so
the selection is a filter: nothing is sorted, a larger budget always takes a superset, and reruns agree.

A source's budget may exceed its size: then every document is taken ``q`` whole times and the
threshold decides who is taken once more.

Plan: one scan computes (doc_id, source, size, hash), saved as a narrow table; each level is a
pre-aggregated sum over it, so a hot source costs one row per bucket and task. The thresholds are
one row a source; they are broadcast up to ``BROADCAST_SOURCES`` sources (counted first) and
beyond that joined with salted keys.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
null doc_id hashes as the empty text. Of rows with one doc_id or none, some may be taken and others
not. Sources of size 0 have target 0. An empty table gives an empty result. Further columns may have
any names. ``mix`` tells equal rows apart by their place in ``docs``, which it reads twice: pass a stored table, whose
rows come in one order, as the pipeline does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS = (5, 2, 1)
CAP = 3
BITS = 12
#: The bits that each level sums by: of the doc_id's hash, then of the text's, then of the row's place.
LEVELS = (("hash", 36), ("hash", 24), ("hash", 12), ("hash", 0), ("tie", 12), ("tie", 0), ("place", 12), ("place", 0))
BROADCAST_SOURCES = 20_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Words are runs of anything but space and the control characters 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def doc_hash(doc_id: Column) -> Column:
    """48 bits of the MD5 of the id's decimal text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, capped, the excess reshared.

    With sources in order of cap/weight, let level k be what is left after capping all before k,
    over the weights from k on. Resharing until none is above its cap ends at the greatest level.
    The windows run over one row a source.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("bigint")).withColumn("total", F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = F.max(F.col("left").cast("double") / F.col("weights_left")).over(everything)
    levelled = ranked.withColumn("left", left).withColumn("weights_left", weights_left).withColumn("level", level)
    return levelled.select("source", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.col("weight") * F.col("level")).alias("target"))


def keys(doc_id: Column, text: Column) -> list[Column]:
    """hash, tie and place: what a document is compared by with its source's threshold, in that order."""
    low = F.lit((1 << 2 * BITS) - 1)
    return [doc_hash(doc_id).alias("hash"), F.xxhash64(text).bitwiseAND(low).alias("tie"), F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(low).alias("place")]


def _below(names: dict[str, Column], cut: dict[str, Column]) -> Column:
    """Whether a document's keys come before the threshold's."""
    last = (names["tie"] < cut["tie"]) | ((names["tie"] == cut["tie"]) & (names["place"] < cut["place"]))
    return (names["hash"] < cut["hash"]) | ((names["hash"] == cut["hash"]) & last)


def thresholds(sized: DataFrame, per_source: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, whole, cut_hash, cut_tie, cut_place): take ``whole`` copies of all, one more of those before the cut."""
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("bigint")
    state = per_source.withColumn("whole", whole).withColumn(
        "rest", F.when(F.col("whole") < cap, F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).otherwise(0.0)
    )
    # at_*: the boundary bucket's bits so far; base: words below it; words, docs: what it holds
    zero = F.lit(0).cast("bigint")
    state = scratch.save(state.select("*", *(zero.alias(f"at_{n}") for n in ("hash", "tie", "place")), zero.alias("base")), "level-0")
    running = Window.partitionBy("source").orderBy("bucket")
    for level, (name, shift) in enumerate(LEVELS, 1):
        mark = state.select(F.col("source").alias("s"), "at_hash", "at_tie", "at_place", "base", "rest")
        rows = sized.withColumn("bucket", F.shiftright(name, shift))
        histogram = rows
        if level > 1:  # the boundary bucket only
            near = F.broadcast(mark) if _few(state) else mark
            inside = rows["source"].eqNullSafe(near["s"])
            for done in dict.fromkeys(n for n, _ in LEVELS[: level - 1] if n != name):
                inside &= F.col(done) == F.col(f"at_{done}")
            if LEVELS[level - 2][0] == name:
                inside &= F.shiftright("bucket", BITS) == F.col(f"at_{name}")
            histogram = rows.join(near, inside)
        histogram = histogram.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        summed = histogram.withColumn("upto", F.sum("words").over(running)).join(mark, F.col("source").eqNullSafe(F.col("s")))
        # the first bucket whose running sum reaches the rest of the budget
        first = F.min(F.when(F.col("base") + F.col("upto") >= F.col("rest"), F.struct("bucket", (F.col("base") + F.col("upto") - F.col("words")).alias("below"), "words", "docs")))
        found = summed.groupBy("source").agg(first.alias("b")).select(F.col("source").alias("s"), "b")
        ends = {n: F.coalesce("b.bucket", zero) if n == name else F.col(f"at_{n}") for n in ("hash", "tie", "place")}
        state = state.join(found, state["source"].eqNullSafe(found["s"]), "left").select(
            "source", "source_size", "target", "whole", "rest", *(c.alias(f"at_{n}") for n, c in ends.items()),
            F.coalesce("b.below", zero).alias("base"), F.coalesce("b.words", zero).alias("inside"), F.coalesce("b.docs", zero).alias("docs"),
        )
        state = scratch.save(state, f"level-{level}")
        scratch.drop(f"level-{level - 1}")
        if not state.where("docs > 1 and rest > 0").limit(1).count():
            break
    # the boundary bucket goes in where that ends nearer to the budget
    over = F.col("base") + F.col("inside") - F.col("rest") < F.col("rest") - F.col("base")
    cut = F.shiftleft(F.col(f"at_{name}") + F.when((F.col("rest") > 0) & over, 1).otherwise(0), shift)
    return state.select("source", "source_size", "target", "whole", *((cut if n == name else F.col(f"at_{n}")).alias(f"cut_{n}") for n in ("hash", "tie", "place")))


def _few(per_source: DataFrame) -> bool:
    return per_source.count() <= BROADCAST_SOURCES


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    prefix = ""
    while any(prefix + n in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def _with_source(rows: DataFrame, small: DataFrame, source: str, key: str) -> DataFrame:
    """``rows`` with the columns of ``small`` for its source: broadcast within the checked bound, else salted.

    The first column of ``small`` is the source; it goes again, and no other column of the two has one name.
    """
    name = small.columns[0]
    same = rows[f"`{source}`"].eqNullSafe(small[name])
    if _few(small):
        return rows.join(F.broadcast(small), same).drop(small[name])
    salt, row_salt = _fresh(rows, "mix_salt", "mix_row_salt")
    small = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(row_salt, F.pmod(F.xxhash64(F.col(f"`{key}`"), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return salted.join(small, salted[f"`{source}`"].eqNullSafe(small[name]) & (F.col(row_salt) == F.col(salt))).drop(name, salt, row_salt)


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(sized documents, thresholds), both saved."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    sized = docs.select(doc.alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), *keys(doc, text))
    sized = scratch.save(sized, "sized")
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    return sized, scratch.save(thresholds(sized, per_source, scratch, cap), "thresholds")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, the words that the mix takes of it."""
    sized, cuts = plan_mix(docs, **options)
    joined = _with_source(sized, cuts.withColumnRenamed("source", "mix_source"), "source", "doc_id")
    names = ("hash", "tie", "place")
    more = _below({n: F.col(n) for n in names}, {n: F.col(f"cut_{n}") for n in names})
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.when(more, 1).otherwise(0))).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it. Texts are not shuffled."""
    scratch = options.pop("scratch", None) or Scratch(docs.sparkSession, "mixing")
    _, cuts = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, scratch=scratch, **options)
    scratch.drop("sized")
    source, whole, hash_, tie, place, copies, copy = _fresh(docs, "mix_source", "mix_whole", "mix_hash", "mix_tie", "mix_place", "mix_copies", "mix_copy")
    small = cuts.select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("cut_hash").alias(hash_), F.col("cut_tie").alias(tie), F.col("cut_place").alias(place))
    own = dict(zip(("hash", "tie", "place"), keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))))
    k_hash, k_tie, k_place = _fresh(docs, "mix_key_hash", "mix_key_tie", "mix_key_place")
    keyed = docs.select("*", own["hash"].alias(k_hash), own["tie"].alias(k_tie), own["place"].alias(k_place))
    more = _below({"hash": F.col(k_hash), "tie": F.col(k_tie), "place": F.col(k_place)}, {"hash": F.col(hash_), "tie": F.col(tie), "place": F.col(place)})
    rows = _with_source(keyed, small, source_col, id_col).withColumn(copies, (F.col(whole) + F.when(more, 1).otherwise(0)).cast("int")).where(F.col(copies) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[f"`{c}`" for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
             (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, total - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_total,
             sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM w),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * max(rest_total::DOUBLE / weights_left::DOUBLE) OVER ()) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT *, CASE WHEN whole < 3 THEN greatest(target - whole * source_size, 0.0) ELSE 0.0 END AS rest FROM q),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT g.source, g.h, g.words, sum(g.words) OVER (PARTITION BY g.source ORDER BY g.h) AS upto FROM g),
e AS (SELECT c.source, c.h, coalesce(c.upto - c.words < r.rest AND (c.upto <= r.rest OR c.upto - r.rest < r.rest - (c.upto - c.words)), false) AS more
      FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size::BIGINT AS size, r.source_size, r.target, (d.size * (r.whole + CASE WHEN e.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
