"""Files that hold one JSON array each, read by as many tasks as their bytes ask for.

Spark's own reader needs a whole file in one task, because a byte in the middle of an array may stand in a
string or at any depth. Here the text reader splits the files (at every ``}``, which JSON has often, in whatever
store it reads), and the state at the start of a split is computed like a running sum:

1. each split reports how many quotation marks it holds (mod 2) and by how much it changes the depth of
   brackets, once as if it began outside a string and once as if inside;
2. running sums over the splits of a file, in order, give every split's true first state;
3. each split is read again from that state and cut at the commas between elements. What lies before its first
   and after its last cut are fragments; at most two a split, they are joined by file and order.

Result: one row an element with its text, file, and order (``block``, ``at``), for ``from_json`` or, where
fields change their types from row to row, for ``try_parse_json``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits whose first states travel to all tasks; with more, rows meet them in a shuffle.
BROADCAST_SPLITS = 500_000
_END = b"}"
_SUMMARY = "file string, block bigint, opens string, flips int, even bigint, odd bigint"
_PIECE = "file string, block bigint, at bigint, kind string, text string"


def _outside(block: np.ndarray, parity: int) -> tuple[np.ndarray, int]:
    """Which bytes stand outside strings (opening quotation marks do not), and the parity of quotation marks at the end."""
    quotes = np.flatnonzero(block == 0x22)
    behind = quotes[(quotes > 0) & (block[np.maximum(quotes - 1, 0)] == 0x5C)]
    if len(behind):
        slashes = np.flatnonzero(block == 0x5C)
        # the run of backslashes before a mark: places that fall in step with their rank
        run = np.arange(len(slashes)) - slashes
        first = np.r_[True, run[1:] != run[:-1]]
        began = slashes[first][np.cumsum(first) - 1]
        at = np.searchsorted(slashes, behind - 1)
        quotes = np.setdiff1d(quotes, behind[(behind - began[at]) % 2 == 1], assume_unique=True)
    inside = np.zeros(len(block) + 1, dtype=np.int8)
    inside[quotes] = 1
    inside = (np.cumsum(inside[:-1], dtype=np.int64) + parity) & 1
    return inside == 0, int((parity + len(quotes)) & 1)


def _steps(block: np.ndarray) -> np.ndarray:
    """+1 at an opening bracket or brace, -1 at a closing one."""
    return ((block == 0x7B) | (block == 0x5B)).astype(np.int8) - ((block == 0x7D) | (block == 0x5D)).astype(np.int8)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where another split begins: (the values of a split's columns, its rows)."""
    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[1:])))
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                yield keys[begin], batch.slice(begin, i - begin)
                begin = i


def _bytes(rows: pa.RecordBatch) -> bytes:
    return b"".join(x + _END for x in rows.column(0).to_pylist())


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, opens, parity, even, odd = None, "", 0, 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "opens": [opens], "flips": pa.array([parity], pa.int32()), "even": [even], "odd": [odd]})

    for key, rows in _splits(batches):
        if key != now:
            if now is not None:
                yield row()
            now, opens, parity, even, odd = key, "", 0, 0, 0
        text = _bytes(rows)
        opens = opens or text.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("ascii", "replace")
        block = np.frombuffer(text, dtype=np.uint8)
        outside, parity = _outside(block, parity)
        steps = _steps(block)
        even, odd = even + int(steps[outside].sum()), odd + int(steps[~outside].sum())
    if now is not None:
        yield row()


class _Cutter:
    """Cuts one split into elements and fragments."""

    def __init__(self, file: str, block: int, base: int | None, parity: int | None, depth: int | None):
        self.file, self.block = file, block
        self.base, self.parity, self.depth = base or 0, parity or 0, depth or 0
        self.held: list[bytes] = []
        self.first, self.over, self.at = True, block > 0 and self.depth <= 0, 0

    def row(self, kind: str) -> list[tuple]:
        text = b"".join(self.held)
        self.held = []
        if kind == "whole" and not text.strip():
            return []
        self.at += 1
        return [(self.file, self.block, self.at, kind, text.decode())]

    def feed(self, text: bytes) -> list[tuple]:
        block = np.frombuffer(text, dtype=np.uint8)
        outside, self.parity = _outside(block, self.parity)
        steps = np.where(outside, _steps(block), 0)
        depth = np.cumsum(steps, dtype=np.int64) + self.depth
        self.depth = int(depth[-1]) if len(depth) else self.depth
        cuts = outside & (((block == 0x2C) & (depth == self.base)) | ((steps == 1) & (depth == self.base)) if self.base else np.zeros(len(block), bool))
        ends = (steps == -1) & (depth == 0)
        out, begin = [], 0
        for at in np.flatnonzero(cuts | ends):
            if self.over:
                break
            at = int(at)
            self.held.append(text[begin : at + (1 if ends[at] and not self.base else 0)])
            # what stands before the first bracket of a file is no element
            out += self.row("whole" if not self.first or self.block == 0 else "head")
            self.first, self.over, begin = False, bool(ends[at]), at + 1
        if not self.over:
            self.held.append(text[begin:])
        return out

    def finish(self) -> list[tuple]:
        if self.over:
            return []
        return self.row("middle" if self.first and self.block else "tail")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter, now = None, None
    names = [f.split()[0] for f in _PIECE.split(", ")]

    def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for key, rows in _splits(batches):
        if key != now:
            if cutter:
                yield from batch(cutter.finish())
            now, cutter = key, _Cutter(*key)
        yield from batch(cutter.feed(_bytes(rows)))
    if cutter:
        yield from batch(cutter.finish())


def _split_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    # a text row is bytes here, so a sequence that UTF-8 forbids fails where elements are made and nowhere before
    rows = spark.read.option("lineSep", _END.decode()).text(paths)
    return rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def split_states(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, base, parity, depth): the state in which each split begins; base is the depth of the elements' commas, 0 for a single object."""
    found = _split_text(spark, paths).mapInArrow(_summarise, _SUMMARY)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.withColumn("parity", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int"))
    sums = sums.withColumn("step", F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd")))
    first = F.first("opens").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    return sums.select("file", "block", F.when(first == "[", 1).otherwise(0).alias("base"), "parity", F.coalesce(F.sum("step").over(before), F.lit(0)).cast("int").alias("depth"))


def read_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, block, at, text) of every element of files that each hold one JSON array, or one object.

    ``block`` and ``at`` give the order within a file. An element's text is as it stands, without the white space around it.
    """
    states = split_states(spark, paths).select(F.col("file").alias("file_"), F.col("block").alias("block_"), "base", "parity", "depth").persist()
    rows = _split_text(spark, paths)
    same = (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_"))
    columns = ["value", "file", "block", "base", "parity", "depth"]
    if states.count() <= BROADCAST_SPLITS:
        ready = rows.join(F.broadcast(states), same).select(*columns)
    else:
        placed = rows.withColumn("place", F.monotonically_increasing_id()).join(states, same)
        ready = placed.repartition("file", "block").sortWithinPartitions("file", "block", "place").select(*columns)
    pieces = ready.mapInArrow(_cut, _PIECE)
    whole = pieces.where("kind = 'whole'").select("file", "block", "at", "text")
    order = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.where("kind <> 'whole'").withColumn("element", F.count_if(F.col("kind") == "tail").over(order))
    joined = parts.groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("block", "at", "text"))).alias("p"))
    rest = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    both = whole.unionByName(rest).select(F.col("file").alias("source_file"), "block", "at", F.btrim("text", F.lit(" \t\r\n")).alias("text"))
    return both.where("text <> ''")


def read_rows(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """As Spark's reader of whole JSON files: the columns of ``schema``, and source_file, block, at."""
    rows = read_elements(spark, paths).select("source_file", "block", "at", F.from_json("text", schema).alias("r"))
    return rows.select("r.*", "source_file", "block", "at")


def read_variants(spark: SparkSession, paths: str | list[str], name: str = "value") -> DataFrame:
    """(source_file, block, at, raw, ``name``): each element's text, and the element as a variant, null if it is no JSON."""
    rows = read_elements(spark, paths)
    return rows.select("source_file", "block", "at", F.col("text").alias("raw"), F.try_parse_json("text").alias(name))
