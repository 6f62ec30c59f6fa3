"""Source divergence audit (operator 12): how far the sources of a language differ, and by which terms.

Method: Spark tasks count terms per (lang, source) as they read and emit what they hold, so a frequent
term leaves a task a few times, not once an occurrence. These rows are summed by (lang, term, source) and
dealt to shards by language and hash of the term. DuckDB, one in-memory database a shard, runs the SQL:

1. documents per (lang, term) are added up, rarer terms go, kept counts are returned;
2. after Spark has summed the kept counts of each group (N) and the kept terms of each language (V), each
   shard returns partial sums for the pairs of sources and its best terms of each source.

Spark merges: partial sums are added by pair, best terms are ranked. A source's p of a term that it
lacks is the same for all such terms, its zero. So with |x - y| summed over all V terms,

    pair(g, h) = V |g0 - h0| + one(g, h) + one(h, g) + both(g, h)
    one(g, h)  = sum over terms of g   of |p - h0| - |g0 - h0|
    both(g, h) = sum over terms of both of |p - q| - |p - h0| - |g0 - q| + |g0 - h0|

a shard reads no term that a source lacks: ``one`` runs over the different values of p, ``both`` over
terms that two sources share. All numbers are integers, products are 128 bits wide.

Scale: the number of shards follows the input's bytes, a shard holds one row a (term, source) and one row
a source of its language, and hands on one row a pair that it has found. A hot source or language is spread over all
shards by its terms; a hot term is at most one row a source in its shard. Counts are saved before the
second pass reads them. DuckDB has one thread and ``DUCKDB_MEMORY`` a shard and uses no files.

Defined results: null text, lang and source read as ''. Each row is a document, also where ids repeat or are
null. A group whose texts have no terms still has its pairs; a language with a single source has none. In a
language without kept terms every pair is 0. An empty table gives an empty result. Further columns may have any names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, input_bytes
from .workers import tidy

LEAST_DOCS, SMOOTHING, SCALE, BEST = 30, 5, 1_000_000_000, 50
#: Bytes of input for each shard and language; entries that a reading task holds before it emits them.
SHARD_BYTES, HELD_ENTRIES = 8 << 20, 400_000
#: Shards of a language at least, so that its terms fill many tasks in small tables too, and at most.
LEAST_SHARDS, MOST_SHARDS = 16, 1_000_000
DUCKDB_MEMORY = "400MB"

# a byte that is part of a term stands for itself, A-Z for a-z, any other for a space
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_COUNTED = "lang string, source string, term string, occurrences bigint, documents bigint"
_KEPT = "lang string, bucket int, source string, term string, occurrences bigint, overall bigint"
_FOUND = "lang string, source string, part string, item string, value bigint"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters A to Z and of anything beyond ASCII, A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of what the task has read, emitted whenever it holds many entries."""
    occurrences: dict = defaultdict(Counter)
    documents: dict = defaultdict(Counter)
    held = 0
    for batch in batches:
        langs, sources, texts = batch.columns
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
            group, found = (lang, source), terms_of(text.as_py())
            before = len(documents[group])
            occurrences[group].update(found)
            documents[group].update(set(found))
            held += len(documents[group]) - before
            if held >= HELD_ENTRIES:
                yield from _emitted(occurrences, documents)
                occurrences.clear()
                documents.clear()
                held = 0
    yield from _emitted(occurrences, documents)


def _emitted(occurrences: dict, documents: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), counts in occurrences.items():
        n = len(counts)
        held = documents[lang, source]
        # a group without terms leaves one row, so that it is known
        terms = [t.decode() for t in counts] if n else [""]
        columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string())]
        columns += [pa.array(list(counts.values()) or [0], pa.int64()), pa.array([held[t] for t in counts] or [0], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "occurrences", "documents"])


def _database(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
    for name, table in tables.items():
        con.register(name, table)
    return con


_KEEP_SQL = """
SELECT lang, bucket, source, term, occurrences, overall FROM (
  SELECT lang, bucket, source, term, sum(occurrences)::BIGINT AS occurrences, sum(sum(occurrences)) OVER (PARTITION BY term)::BIGINT AS overall, sum(sum(documents)) OVER (PARTITION BY term) AS holders
  FROM counted GROUP BY lang, bucket, source, term)
WHERE holders >= $least
"""

#: What a shard of a language adds to each pair of sources (source < item), and its best terms.
_SHARE_SQL = """
WITH g AS MATERIALIZED (SELECT source, n, v, all_n, 1 + ($scale::HUGEINT * $smoothing) // greatest(n::HUGEINT + $smoothing::HUGEINT * v, 1) AS zero FROM groups),
c AS MATERIALIZED (
  SELECT k.source, k.term, 1 + ($scale::HUGEINT * (k.occurrences::HUGEINT + $smoothing)) // (g.n::HUGEINT + $smoothing::HUGEINT * g.v) AS p,
         1 + ($scale::HUGEINT * (k.overall::HUGEINT + $smoothing)) // (g.all_n::HUGEINT + $smoothing::HUGEINT * g.v) AS q, g.zero
  FROM kept k JOIN g ON k.source = g.source WHERE k.occurrences > 0),
values_ AS (SELECT source, zero, p, count(*) AS times FROM c GROUP BY source, zero, p),
one AS (SELECT least(x.source, h.source) AS source, greatest(x.source, h.source) AS item, x.times * (abs(x.p - h.zero) - abs(x.zero - h.zero)) AS part FROM values_ x JOIN g h ON x.source <> h.source),
both_ AS (SELECT x.source, y.source AS item, abs(x.p - y.p) - abs(x.p - y.zero) - abs(x.zero - y.p) + abs(x.zero - y.zero) AS part FROM c x JOIN c y ON x.term = y.term AND x.source < y.source),
pairs AS (SELECT source, item, sum(part) AS value FROM (SELECT * FROM one UNION ALL SELECT * FROM both_) GROUP BY source, item),
base AS (SELECT x.source, y.source AS item, x.v::HUGEINT * abs(x.zero - y.zero) AS value FROM g x JOIN g y ON x.source < y.source WHERE $first),
best AS (SELECT source, term AS item, p - q AS value FROM c WHERE p > q QUALIFY row_number() OVER (PARTITION BY source ORDER BY p - q DESC, term) <= $best)
SELECT $lang AS lang, source, 'pair' AS part, item, value::BIGINT AS value FROM (SELECT * FROM pairs UNION ALL SELECT * FROM base)
UNION ALL SELECT $lang, source, 'term', item, value::BIGINT FROM best
"""


def _typed(table: pa.Table, **kinds: pa.DataType) -> pa.Table:
    return table.select(list(kinds)).cast(pa.schema(list(kinds.items())))


def keep_terms(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Kept counts (lang, bucket, source, term, occurrences, overall), all groups (lang, source), and the number of buckets."""
    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).cast("binary").alias("text"))
    buckets = max(LEAST_SHARDS, min(MOST_SHARDS, -(-input_bytes(docs, f"`{text_col}`") // SHARD_BYTES)))
    counted = rows.mapInArrow(tidy(_count), _COUNTED).groupBy("lang", "term", "source").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    counted = scratch.save(counted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")), "counted")
    groups = scratch.save(counted.select("lang", "source").distinct(), "groups")

    def keep(table: pa.Table) -> pa.Table:
        with _database(counted=table) as con:
            return _typed(con.execute(_KEEP_SQL, {"least": least_docs}).to_arrow_table(), lang=pa.string(), bucket=pa.int32(), source=pa.string(), term=pa.string(), occurrences=pa.int64(), overall=pa.int64())

    shards = counted.where("term <> ''").groupBy("lang", "bucket").applyInArrow(keep, _KEPT)
    kept = scratch.save(shards, "kept")
    scratch.drop("counted")
    return kept, groups, buckets


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, best: int = BEST, scratch: Scratch | None = None, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank): per group the other sources of its language by distance, and its leading terms."""
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    kept, groups, buckets = keep_terms(docs, least_docs=least_docs, scratch=scratch, **columns)
    n = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"))
    per_bucket = kept.groupBy("lang", "bucket").agg(F.countDistinct("term").alias("v"), F.sum("occurrences").alias("all_n"))
    v = per_bucket.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("all_n").alias("all_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    sized = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("all_n"))
    sized = scratch.save(sized, "sized")
    spread = sized.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    fixed = {"scale": scale, "smoothing": smoothing, "best": best}

    def share(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
        with _database(kept=counts, groups=sources) as con:
            lang, bucket = (k.as_py() for k in key)
            found = con.execute(_SHARE_SQL, fixed | {"lang": lang, "first": bucket == 0}).to_arrow_table()
            return _typed(found, lang=pa.string(), source=pa.string(), part=pa.string(), item=pa.string(), value=pa.int64())

    shares = scratch.save(kept.groupBy("lang", "bucket").cogroup(spread.groupBy("lang", "bucket")).applyInArrow(share, _FOUND), "shares")
    pairs = shares.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    way = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    both_ways = pairs.select("lang", "value", way).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = shares.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= best)
    return both_ways.withColumn("rank", F.row_number().over(order)).unionByName(terms)


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
o AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (SELECT c.lang, c.source, c.term, c.n,
             1 + (1000000000::HUGEINT * (c.n + 5)) // ((sum(c.n) OVER (PARTITION BY c.lang, c.source))::HUGEINT + 5 * v.v) AS p,
             1 + (1000000000::HUGEINT * ((sum(c.n) OVER (PARTITION BY c.lang, c.term))::HUGEINT + 5)) // ((sum(c.n) OVER (PARTITION BY c.lang))::HUGEINT + 5 * v.v) AS q
      FROM c JOIN v ON v.lang = c.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
