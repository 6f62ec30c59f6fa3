"""Exact top-k inner-product search over integer vectors (operator 6).

Method: queries and rows are dealt to the cells of a grid: a cell holds a tile of queries and a
tile of rows, multiplies the two tiles as matrices, and keeps each query's best k of the cell
(partial selection). The cells' lists are merged in two levels, first within groups of cells and
then per query; Spark trims each level to k rows a key before it shuffles.

Every query meets every row in exactly one cell. The grid's size follows the table's counts, so a
cell's memory is bounded: about ``ROWS_PER_CELL`` rows by ``QUERIES_PER_CELL`` queries, with scores
held for ``TILE`` rows by ``QUERY_TILE`` queries at a time. Products are exact: in doubles where no sum can reach 2**53, else
in 64-bit integers where none can reach 2**63, else in Python's integers.

Defined results: vectors that are null or hold a null or non-finite component, and rows without
an id, take no part. Shorter vectors count as padded with zeros. Rows that share an id are rows of
their own: each query row has its own k results, and every row but itself is a candidate. Ties go
to smaller ids. Other columns are ignored. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

K = 5
ROWS_PER_CELL = 32_768
QUERIES_PER_CELL = 16_384
LEAST_CELLS = 64
CELLS_PER_GROUP = 16
#: Rows and queries whose scores are held at a time.
TILE, QUERY_TILE = 4_096, 1_024


def usable(vector: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


def _largest(m: np.ndarray) -> int:
    return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each line's k highest scores, ties to earlier ones; a line has more than k."""
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    over = scores > least
    tied = scores == least
    tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= k - over.sum(1, dtype=np.int32)[:, None]
    return np.nonzero(over | tied)[1].reshape(len(scores), k)


def best_of_tiles(q_rows: np.ndarray, q: np.ndarray, ids: np.ndarray, row_of: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best rows, ties to smaller ids; the query's own row is left out."""
    order = np.lexsort([row_of, ids])
    ids, row_of, rows = ids[order], row_of[order], rows[order]
    bound = _largest(q) * _largest(rows) * max(1, q.shape[1])
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    none = np.iinfo(np.int64).min if kind is np.int64 else -math.inf
    q, rows = q.astype(kind), rows.astype(kind)
    by_row = np.argsort(row_of)
    found: list[tuple[np.ndarray, ...]] = []
    for first in range(0, len(q_rows), QUERY_TILE):
        asking = q_rows[first : first + QUERY_TILE]
        at = by_row[np.minimum(np.searchsorted(row_of, asking, sorter=by_row), len(row_of) - 1)]
        own = np.where(row_of[at] == asking, at, -1)  # where a query meets itself
        best, place = np.zeros((len(asking), 0), kind), np.zeros((len(asking), 0), np.int64)
        for start in range(0, len(ids), TILE):
            scores = q[first : first + QUERY_TILE] @ rows[start : start + TILE].T
            mine = np.flatnonzero((own >= start) & (own < start + TILE))
            scores[mine, own[mine] - start] = none
            pick = _best(scores, k) if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
            # earlier tiles hold smaller ids, so ties stay in order
            best, place = np.hstack([best, np.take_along_axis(scores, pick, 1)]), np.hstack([place, pick + start])
            if best.shape[1] > k:
                pick = _best(best, k)
                best, place = np.take_along_axis(best, pick, 1), np.take_along_axis(place, pick, 1)
        real = best != none
        found.append((np.repeat(asking, real.sum(1)), ids[place[real]], np.array(best[real], np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(3))


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) from tables of row bigint, vec_id bigint and vector array<bigint>.

    ``row`` tells rows apart; a query that is itself a row of ``vectors`` has its number.
    """
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    asked, wide = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    width = max(width, wide)
    down, across = max(1, math.ceil(asked / QUERIES_PER_CELL)), max(LEAST_CELLS, math.ceil(n / ROWS_PER_CELL))

    def dealt(rows: DataFrame, own: int, other: int, own_name: str, other_name: str, seed: int) -> DataFrame:
        own_cell = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(own)).cast("int").alias(own_name)
        return rows.select("row", "vec_id", "vector", own_cell, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(other_name))

    left = dealt(queries, down, across, "r", "c", 1).groupBy("r", "c")
    right = dealt(vectors, across, down, "c", "r", 2).groupBy("r", "c")

    def cell(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 4
        if a.num_rows and b.num_rows:
            asking, found, scores = best_of_tiles(a["row"].to_numpy(), _matrix(a["vector"], width), b["vec_id"].to_numpy(), b["row"].to_numpy(), _matrix(b["vector"], width), k)
            by_row = np.argsort(a["row"].to_numpy())
            columns = [asking, a["vec_id"].to_numpy()[by_row[np.searchsorted(a["row"].to_numpy(), asking, sorter=by_row)]], found, scores]
        group = pa.array([int(key[1].as_py()) // CELLS_PER_GROUP] * len(columns[0]), pa.int32())
        return pa.table([*map(pa.array, columns), group], names=["row", "query_id", "vec_id", "score", "cells"])

    found = left.cogroup(right).applyInArrow(cell, "row bigint, query_id bigint, vec_id bigint, score bigint, cells int")
    order = [F.col("score").desc(), F.col("vec_id")]
    for by in (["row", "cells"], ["row"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, *, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """Top k of all other rows for each row whose id is divisible by ``every``."""
    scratch = scratch or Scratch(embeddings.sparkSession, "topk")
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("vector", quantised(F.col("vector"), scale))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # the numbers hold once saved
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k=k)


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.n <> b.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
