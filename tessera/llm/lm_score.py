"""Language-model scores of documents by stupid back-off (operator 9).

Model: Brants et al., "Large Language Models in Machine Translation" (2007). The n-gram counts come
from the whole corpus that is scored, and a document never vouches for itself: its own occurrences
are subtracted from every count before it is scored. With c' the counts of all other documents and
N' their words, a word v after context u scores c'(u v) / c'(u) where that is not zero, else 0.4
times the score of the shorter context, down to c'(v) / N', or 1 / (N' + 1) for an unknown word.

Plan: documents are dealt by hash to blocks. Each block explodes its n-grams (64-bit hashes),
counts them and sends each distinct one once to the count table's partition for its hash range;
the partition adds the counts of all blocks and answers each block, where the totals are joined
to the documents' n-grams and summed per document. An n-gram that is in every document so costs one
entry a block, not one a document: counts are pre-aggregated before they move and no hash range is
hot. A task holds one block (``BLOCK_BYTES`` of input) or one range of hashes. The texts are
exchanged once; both passes over them read the same exchange. What is exchanged is compressed without
loss: texts one by one, sorted hashes as differences, and of totals only what other blocks add.

Words are runs of anything but space and the control characters 9 to 13, A to Z in lower case.

Defined results: a null, empty or wordless text has 0 tokens, log-probability 0 and a null score.
Repeated rows are documents of their own, so copies vouch for each other. In a corpus of one
document every word is unknown. Null doc_ids are scored like any. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import _LOWER, _mix, _words
from .scratch import input_bytes
from .workers import release, tidy

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 64


def _ngrams(texts: list[str | bytes | None], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(document of each word, hashes of the n-grams of each order that end there, words per document).

    Where a document has too few words before a place, the hash of that order is 0 and not counted.
    """
    split = [(t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")).translate(_LOWER).split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    look = _words.__getitem__
    words = np.fromiter((h for w in split for h in map(look, w)), np.uint64, total)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = [_mix(words + np.uint64(1))]
    for m in range(2, order + 1):
        longer = np.zeros(total, np.uint64)
        longer[1:] = _mix(grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(m))
        longer[place < m - 1] = 0
        grams.append(longer)
    return doc, grams, sizes


def _counted(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.concatenate(grams)
    return np.unique(joined[joined != 0], return_counts=True)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed as planes of bytes of equal weight."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), asbytes=True) if len(values) else b""


def _unpack(raw: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, n * width), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _texts(table: pa.Table) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(raw, size, asbytes=True) if size else b"" for raw, size in zip(table["text"].to_pylist(), table["size"].to_pylist())]


def _bounds(ranges: int) -> np.ndarray:
    """Last hash of each range of hashes."""
    return np.array([((r + 1) << 64) // ranges - 1 for r in range(ranges)], np.uint64)


def score(docs: DataFrame, *, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, log_prob (natural, summed) and score (log_prob per token)."""
    blocks = max(LEAST_BLOCKS, math.ceil(input_bytes(docs.select(F.col(text_col).cast("string").alias("text")), "text") / BLOCK_BYTES))
    ranges = blocks
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    @tidy
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary()).to_pylist()
            squeezed = pa.array([codec.compress(t, asbytes=True) if t else None for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), squeezed, pa.array([len(t or b"") for t in texts], pa.int64()), batch.column(2)], names=["doc_id", "text", "size", "block"])

    rows = rows.mapInArrow(squeeze, "doc_id bigint, text binary, size bigint, block int")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, grams, sizes = _ngrams(_texts(table), order)
        keys, counts = _counted(grams)
        release()
        cuts = np.concatenate([[0], np.searchsorted(keys, _bounds(ranges), side="right")])
        parts = list(zip(cuts[:-1], cuts[1:]))
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * ranges, pa.int32()),
                "part": pa.array(range(ranges), pa.int32()),
                "words": pa.array([int(sizes.sum())] * ranges, pa.int64()),
                "n": pa.array([int(b - a) for a, b in parts], pa.int64()),
                "keys": pa.array([_pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()),
                "counts": pa.array([_pack(counts[a:b].astype("<u4")) for a, b in parts], pa.binary()),
            }
        )

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        keys = [np.cumsum(_unpack(x.as_py(), n, "<u8"), dtype=np.uint64) for x, n in zip(table["keys"], sizes)]
        counts = np.concatenate([_unpack(x.as_py(), n, "<u4") for x, n in zip(table["counts"], sizes)])
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(which, weights=counts, minlength=1).astype(np.int64)[which] - counts  # exact below 2**53
        totals = totals.astype("<u4" if not len(totals) or totals.max() < 1 << 32 else "<u8")
        cuts = np.cumsum([0, *sizes])
        return pa.table(
            {
                "block": table["block"],
                "part": table["part"],
                "corpus": pa.array([int(sum(table["words"].to_pylist()))] * table.num_rows, pa.int64()),
                "width": pa.array([totals.itemsize] * table.num_rows, pa.int32()),
                "n": table["n"],
                "totals": pa.array([_pack(totals[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            }
        )

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        doc, grams, sizes = _ngrams(_texts(table), order)
        keys, totals = _counted(grams)
        parts = sorted(zip(*(answers[c].to_pylist() for c in ("part", "width", "n", "totals"))))
        totals = totals + np.concatenate([_unpack(raw, n, f"<u{width}").astype(np.int64) for _, width, n, raw in parts] or [np.zeros(0, np.int64)])
        others = (answers["corpus"][0].as_py() if answers.num_rows else 0) - sizes  # words of all other documents
        logs = np.zeros(len(doc))
        if len(doc):
            context = None
            for m, gram in enumerate(grams, 1):
                there = gram != 0
                at = np.searchsorted(keys, gram[there])
                _, again, own = np.unique(doc[there] * np.int64(len(keys)) + at, return_inverse=True, return_counts=True)
                count = np.zeros(len(doc), np.int64)
                count[there] = totals[at] - own[again]
                if m == 1:
                    rest = others[doc]
                    logs = np.where(count > 0, np.log(np.maximum(count, 1) / np.maximum(rest, 1)), -np.log(rest + 1.0))
                else:
                    before = np.concatenate([[1], context[:-1]])
                    seen = np.log(np.maximum(count, 1) / np.maximum(before, 1))
                    logs = np.where(there, np.where(count > 0, seen, math.log(backoff) + logs), logs)
                context = count
        release()
        sums = np.bincount(doc, weights=logs, minlength=len(sizes)) if len(doc) else np.zeros(len(sizes))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_tokens": pa.array(sizes),
                "log_prob": pa.array(sums),
                "score": pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0),
            }
        )

    asked = rows.groupBy("block").applyInArrow(ask, "block int, part int, words bigint, n bigint, keys binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(answer, "block int, part int, corpus bigint, width int, n bigint, totals binary")
    return rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(finish, "doc_id bigint, n_tokens bigint, log_prob double, score double")



SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT doc_id, i, v, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM k),
n AS (SELECT count(*) AS total FROM t),
s AS (SELECT doc_id, count(*) AS size FROM t GROUP BY doc_id),
u1 AS (SELECT v, count(*) AS c FROM t GROUP BY v),
o1 AS (SELECT doc_id, v, count(*) AS c FROM t GROUP BY doc_id, v),
u2 AS (SELECT u, v, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, v),
o2 AS (SELECT doc_id, u, v, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY doc_id, u, v),
x AS (
  SELECT o2.doc_id, o2.u, o2.v, o2.c AS times, u2.c - o2.c AS pair, cu.c - ou.c AS context FROM o2 JOIN u2 USING (u, v)
  JOIN u1 cu ON cu.v = o2.u JOIN o1 ou ON ou.doc_id = o2.doc_id AND ou.v = o2.u),
y AS (
  SELECT o1.doc_id, o1.v, CASE WHEN u1.c > o1.c THEN ln((u1.c - o1.c)::DOUBLE / (n.total - s.size)) ELSE -ln(n.total - s.size + 1.0::DOUBLE) END AS logp
  FROM o1 JOIN u1 USING (v) JOIN s USING (doc_id) CROSS JOIN n),
z AS (
  SELECT x.doc_id, x.times * CASE WHEN x.pair > 0 THEN ln(x.pair::DOUBLE / x.context) ELSE ln(0.4::DOUBLE) + y.logp END AS logp
  FROM x JOIN y USING (doc_id, v)
  UNION ALL SELECT t.doc_id, y.logp FROM t JOIN y USING (doc_id, v) WHERE t.u IS NULL),
g AS (SELECT doc_id, sum(logp) AS logp FROM z GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_tokens, round(coalesce(g.logp, 0.0), 6) + 0.0 AS log_prob, round(g.logp / len(d.w), 6) + 0.0 AS score
FROM d LEFT JOIN g USING (doc_id)
"""
