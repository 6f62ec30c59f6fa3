"""Fill-in-the-middle transformation (operator 11).

Method: a text is decoded to a UTF-32 numpy array of code points. Two comparisons give the class of
each code point (white space or not); where a non-space is followed by a space a unit ends, and
``flatnonzero`` of the compared neighbours yields these ends. The ranks of the two cuts are indexed in
the ends, and the three slices are encoded again and put into the order of the chosen form.

A unit is white space with the word after it, or the white space that ends the text. With h1 to h4 the
first four groups of eight hexadecimal digits of the SHA-256 of ``<seed>:<id>``, a text of n units is
cut after the lesser and after the greater of h1 % (n+1) and h2 % (n+1) units. It stays ``plain`` if it
is empty, holds a marker, or h3 % 100 is not below ``fim_percent``; else its form is ``spm`` where
h4 % 100 is below ``spm_percent`` and ``psm`` elsewhere:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

No marker can arise across a seam, as none begins with the end of another; so ``restore`` rebuilds the
exact text from output and form alone, in expressions.

Plan: one scan, no shuffle, no state between rows; a lost task is run again with the same result. Output
leaves in batches of ``BATCH_BYTES``, so a task holds one incoming batch, one text and one outgoing batch.

Defined results: a null text counts as empty (plain, n = 0, output empty). A null id is written as the
empty text in the hash. Rows that share an id are cut by the same hash, each within its own text. An
empty table gives an empty result. Only the id and the text are read: other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

MARKERS = ("<P>", "<S>", "<M>")
SEED, FIM_PERCENT, SPM_PERCENT = "42", 50, 80
BATCH_BYTES = 8 << 20


def unit_ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of ``text``, and where its units end (exclusive)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return points, np.zeros(0, dtype=np.int64)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    inner = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return points, np.append(inner, len(points))


def _piece(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def draws(seed: str, doc_id: str) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform_text(text: str, h: list[int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text; the lengths are null if it stays plain."""
    points, ends = unit_ends(text)
    n = len(ends)
    if not n or h[2] % 100 >= fim_percent or any(m in text for m in MARKERS):
        return n, "plain", None, None, text
    ranks = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, second = (int(ends[r - 1]) if r else 0 for r in ranks)
    prefix, middle, suffix = _piece(points[:first]), _piece(points[first:second]), _piece(points[second:])
    if h[3] % 100 < spm_percent:
        return n, "spm", first, second - first, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", first, second - first, f"<P>{prefix}<S>{suffix}<M>{middle}"


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars and output, the text in its form."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("written"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )
    kind = rows.schema["doc_id"].dataType
    schema = StructType(
        [StructField("doc_id", kind), StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, done = 0, 0, []
            ids, written, texts = batch.column(0), batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                done.append(transform_text(texts[i].as_py(), draws(seed, written[i].as_py()), fim_percent, spm_percent))
                held += len(done[-1][-1])
                if held >= BATCH_BYTES:
                    yield _batch(ids.slice(begin, len(done)), done)
                    begin, held, done = i + 1, 0, []
            if done:
                yield _batch(ids.slice(begin, len(done)), done)

    return rows.mapInArrow(run, schema)


def _batch(ids: pa.Array, done: list[tuple]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*done)
    arrays = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    rows = transform(docs, **options)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d),
n AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                     WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
