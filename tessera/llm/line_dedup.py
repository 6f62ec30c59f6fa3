"""Dedup of lines across documents (operator 13). DataFrame code only.

Method: each line's key is hashed to 128 bits, and the hashes of long keys go to a narrow table of
(hash, document, place). This is partitioned by ranges of (hash, document, place), largest document
first, and sorted by these within a range. Streaming over a range, the first row of each (hash,
document) leads it; the leads of a hash, counted and reduced to the first document, say which keys are
frequent and who keeps them. What other documents hold of frequent keys becomes a bitmap per document,
64 places a word; words without a dropped line are left out. Texts never move to find the bitmaps.

Skew: the document is part of the range key, so the rows of one very common line fill many ranges. The
count per hash is a partial aggregation before it is shuffled. The rows meet the frequent keys in a join of two
saved tables, whose hot partitions Spark splits. No group is ever collected but the words of one document.

``drop_plan`` gives the bitmaps, ``deduplicate`` the documents with the lines dropped, ``report`` a
digest per document. The bitmaps meet the texts by id and a 64-bit hash of the text.

Defined results: a null or empty text is one empty line. Only keys of at least ``least_chars`` code
points, in at least ``least_docs`` documents, are dropped; documents are told apart by their id, rows
without an id count together as one document that comes before all others. All lines of a key stay in
the rows with the largest id that holds it, repeated rows and repeated lines included. Where all lines go, the empty text stays.
An empty table gives an empty result. Ids are integers. Further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

LEAST_CHARS, LEAST_DOCS = 40, 5
WORD = 64
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts of ASCII alone take the fast function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def fingerprint(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def occurrences(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, back, print, place) of every line with a long key; back is smaller for larger ids, null ids come last."""
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    back = F.when(doc.isNull(), F.lit((1 << 63) - 1)).otherwise(-1 - doc.cast("bigint"))
    rows = docs.select(back.alias("back"), fingerprint(text).alias("print"), F.posexplode(lines_of(text)).alias("place", "line"))
    rows = rows.select("back", "print", "place", stripped(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return rows.withColumn("key", lower_ascii(F.col("key"))).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(13), "key").alias("h2"), "back", "print", "place")


def drop_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, scratch: Scratch | None = None) -> DataFrame:
    """(back, print, n_dropped, keep): per document that loses lines, an array of (word, bits), bit 1 for a line that stays."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    found = scratch.save(occurrences(docs, id_col, text_col, least_chars), "found")
    ranged = found.repartitionByRange("h1", "h2", "back").sortWithinPartitions("h1", "h2", "back", "print", "place")
    stream = Window.partitionBy("h1", "h2", "back").orderBy("print", "place")
    lines = scratch.save(ranged.withColumn("leads", F.row_number().over(stream) == 1), "lines")
    keys = lines.where("leads").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("holders"), F.min("back").alias("keeper"))
    frequent = scratch.save(keys.where(F.col("holders") >= least_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keeper"), "frequent")
    dropped = lines.join(frequent, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(F.col("back") > F.col("keeper"))
    dropped = dropped.select("back", "print", F.floor(F.col("place") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, place % {WORD})").alias("bit"))
    # rows repeated whole drop the same places, so the bits are joined and not added up
    words = dropped.groupBy("back", "print", "word").agg(F.bitwise_not(F.bit_or("bit")).alias("bits"))
    per_doc = words.groupBy("back", "print").agg(F.sum(WORD - F.bit_count("bits")).cast("bigint").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))
    plan = scratch.save(per_doc, "plan")
    scratch.drop("found", "lines", "frequent")
    return plan


def kept_text(text: Column, keep: Column) -> Column:
    """The text's lines whose bit in ``keep`` is 1, joined; words that are missing are all ones."""
    words = F.map_from_entries(keep)
    last = F.element_at(keep, -1)["word"]
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.element_at(words, w), F.lit(-1).cast("bigint")))
    # the dense array is made once a row: it travels through a one-element transform, not into each line's test
    stay = F.transform(F.array(dense), lambda d: F.filter(lines_of(text), lambda line, i: F.coalesce(F.getbit(F.get(d, F.floor(i / WORD).cast("int")), i % WORD), F.lit(1)) == 1))
    return F.array_join(F.get(stay, F.lit(0)), "\n")


def _fresh(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    prefix = ""
    while any(prefix + n in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def _with_plan(docs: DataFrame, id_col: str, text_col: str, plan: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with the columns of their plan, null where no line goes; the names of its n_dropped and keep."""
    back, mark, n, keep = _fresh(docs, "line_back", "line_print", "line_dropped", "line_keep")
    doc = F.col(f"`{id_col}`")
    own = docs.withColumn(back, F.when(doc.isNull(), F.lit((1 << 63) - 1)).otherwise(-1 - doc.cast("bigint"))).withColumn(mark, fingerprint(F.col(f"`{text_col}`")))
    small = plan.select(F.col("back").alias("plan_back__"), F.col("print").alias("plan_print__"), F.col("n_dropped").alias(n), F.col("keep").alias(keep))
    joined = own.join(small, (own[back] == small["plan_back__"]) & (own[mark] == small["plan_print__"]), "left")
    return joined.select(*(own[f"`{c}`"] for c in docs.columns), small[n], small[keep]), n, keep


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the dropped lines gone from their texts; a text that loses none is left as it is."""
    joined, _, keep = _with_plan(docs, id_col, text_col, drop_plan(docs, id_col=id_col, text_col=text_col, **options))
    text = F.col(f"`{text_col}`")
    short = F.when(F.col(keep).isNull(), text).otherwise(kept_text(text, F.col(keep)))
    return joined.select(*(short.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and kept_sha256, the digest of the text that stays."""
    plan = drop_plan(docs, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    joined, n, keep = _with_plan(rows, "doc_id", "text", plan)
    kept = F.when(F.col(keep).isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col(keep)))
    n_lines = (F.regexp_count("text", F.lit("\n")) + 1).cast("bigint")
    return joined.select("doc_id", n_lines.alias("n_lines"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.place, coalesce(k.doc_id < f.keeper, false) AS drops FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(drops)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT drops), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
