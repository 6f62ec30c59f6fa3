"""Best-fit packing of documents into fixed-length training sequences (operator 3).

Method: bounded-space online best-fit. A packing task keeps at most ``open_bins`` open bins,
indexed by a bitset over free space (bit f is set when some open bin has f free places). The
best bin for a piece of length n is the lowest set bit at or above n, found with two integer
operations. When a new bin would exceed the bound, the fullest open bin closes first. A task's
pieces arrive longest first, which leaves about 0.1 % of the places empty, against 1 % in order of
doc_id; an open bin is one number, so the bound can be wide.

Plan: one scan turns each whole text into pieces (id, place and checksum, no ids), which are
saved; that table is about forty bytes a piece. The pieces are then dealt, without a key and so
without skew, to one slice for each ``pieces_per_task`` pieces; a slice's number is a column and part of its
sequences' ids, so it does not matter how slices meet in tasks. A task holds one batch and
``open_bins`` bins whatever the input's size. Texts are never shuffled.

Defined results: a null text is empty, and an empty document is its end id alone. Repeated rows
and repeated or null doc_ids are packed once per row. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch
from .workers import tidy

MAX_LENGTH = 2048
END_ID = 0
OPEN_BINS = 16_384
PIECES_PER_TASK = 50_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class OpenBins:
    """The open bins of one task: a bitset over free space and, for each free space, its bins."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.mask = 0
        self.at: dict[int, list[int]] = {}
        self.count = 0
        self.made = 0

    def _take(self, free: int) -> int:
        bins = self.at[free]
        found = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``capacity`` places."""
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.at.setdefault(left, []).append(number)
            self.mask |= 1 << left
            self.count += 1
        return number, self.capacity - free


def _cut(vocabulary: str, end_id: int, most: int, keep_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in tokens.slices(batch.column(1)):
                cols: list[list] = [[], [], [], [], [], []]
                for doc, payload in zip(ids[a:b], encode(texts)):
                    payload += end
                    for piece, at in enumerate(range(0, len(payload), 4 * most)):
                        part = payload[at : at + 4 * most]
                        for col, value in zip(cols, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None)):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECES)], schema=_PIECES)

    return run


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, max_length: int = MAX_LENGTH, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each text's ids and its end id, cut only beyond ``max_length``.

    ``ids`` holds the little-endian unsigned 32-bit ids where ``keep_ids`` asks for them, else null.
    """
    columns = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(_cut(vocabulary or tokens.vocabulary(), end_id, max_length, keep_ids), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


def _fit(capacity: int, open_bins: int, fields: list[str]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bins = None, OpenBins(capacity, open_bins)
        for batch in batches:
            ids, offsets = [], []
            for part, length in zip(batch.column(0).to_pylist(), batch.column(fields.index("length") + 1).to_pylist()):
                if part != current:
                    current, bins = part, OpenBins(capacity, open_bins)
                number, offset = bins.place(length)
                ids.append((part << 40) + number)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*fields, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, *, max_length: int = MAX_LENGTH, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``cut`` with sequence_id and offset; ``cut`` must be a saved table, since it is counted first."""
    parts = max(1, math.ceil(cut.count() / pieces_per_task))
    columns = [f"`{c}`" for c in cut.columns]
    numbered = cut.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("pack_slice"), *columns)
    dealt = numbered.repartition(parts, "pack_slice").sortWithinPartitions("pack_slice", F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(_fit(max_length, open_bins, cut.columns), f"{', '.join(f'`{n}` {t}' for n, t in cut.dtypes)}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, *, scratch: Scratch | None = None, keep_ids: bool = False, **options) -> DataFrame:
    """Packs every document: (doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset)."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    how = {k: options.pop(k) for k in ("open_bins", "pieces_per_task") if k in options}
    cut = pieces(docs, keep_ids=keep_ids, **options)
    cut = scratch.save(cut if keep_ids else cut.drop("ids"), "pieces")
    return pack(cut, max_length=options.get("max_length", MAX_LENGTH), **how)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed ids of each sequence, from pieces with their ids.

    A sequence has at most ``max_length`` pieces, so no group grows with the data.
    """
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "n_tokens", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
