"""Scores of many queries in groups of documents: weights of terms times parts of documents, as matrix products.

A posting reaches the group of its document once, whatever the number of queries that ask for its term; joined with the queries
it would be a row for each of them. Queries come in tiles of ``TILE``, so a task holds the postings of one group, one tile's
weights and a strip of scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TILE, STRIP = 256, 512
#: Documents that meet in one task at a time.
GROUP_DOCS = 2_048


def tiled(weights: DataFrame) -> DataFrame:
    """``weights`` (query_id, term, w, ...) with the tile of each query."""
    tiles = -(-weights.agg(F.count_distinct("query_id")).first()[0] // TILE) or 1
    return weights.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int"))


def in_groups(postings: DataFrame, groups: DataFrame, weights: DataFrame, found: Callable[[pa.Table, "Weights"], pa.Table], schema: str) -> DataFrame:
    """``found`` of each group's postings with each tile's weights: ``postings`` has group and term, ``groups`` all groups, ``weights`` is tiled."""
    met = postings.join(weights.select("tile", "term").distinct(), "term")
    sides = weights.select(*(F.col(c).alias(c) for c in weights.columns)).crossJoin(groups.select(F.col("group").alias("group")))

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return found(left, Weights(right)) if len(left) and len(right) else empty

    return met.groupBy("tile", "group").cogroup(sides.groupBy("tile", "group")).applyInArrow(run, schema)


class Weights:
    """One tile's weights as a matrix of its queries by its terms; ``first`` is a query's first row in ``table``."""

    def __init__(self, table: pa.Table):
        queries = table["query_id"].combine_chunks().dictionary_encode()
        self.table, self.queries = table, queries.dictionary
        terms = table["term"].combine_chunks().dictionary_encode()
        self.terms = terms.dictionary
        row, column = queries.indices.to_numpy(), terms.indices.to_numpy()
        self.matrix = np.zeros((len(self.queries), len(self.terms)))
        self.matrix[row, column] = table["w"].to_numpy()
        self.first = np.unique(row, return_index=True)[1]

    def column_of(self, terms: pa.ChunkedArray) -> np.ndarray:
        return pc.index_in(terms.combine_chunks(), value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)

    def scores(self, column: np.ndarray, doc: np.ndarray, part: np.ndarray, n_docs: int):
        """(from, scores of all queries) for strips of documents, given each posting's term, document and part."""
        order = np.argsort(doc, kind="stable")
        column, doc, part = column[order], doc[order], part[order]
        for at in range(0, n_docs, STRIP):
            a, b = np.searchsorted(doc, [at, at + STRIP])
            used, place = np.unique(column[a:b], return_inverse=True)
            cells = np.zeros((len(used), min(STRIP, n_docs - at)))
            np.add.at(cells, (place, doc[a:b] - at), part[a:b])
            yield at, self.matrix[:, used] @ cells


def best(score: np.ndarray, k: int, places: int) -> np.ndarray:
    """The places of the k best positive scores by rounded score, ties to the earlier place."""
    some = np.flatnonzero(score > 0)
    if len(some) > k:
        rounded = np.round(score[some], places)
        least = np.partition(rounded, len(some) - k)[len(some) - k]
        some, rounded = some[rounded >= least], rounded[rounded >= least]
        some = some[np.argsort(-rounded, kind="stable")[:k]]
    return some
