"""Token ids in raw binary shards with a minimal perfect hash index (operator 2).

A dataset is a folder with, for each shard, a payload file of nothing but little-endian ids (two
bytes each while the vocabulary fits, else four) and an index file; ``manifest`` lists the shards
of the committed write. Shards hold consecutive ranges of doc_id in ascending order.

Index of a shard: a minimal perfect hash over its distinct keys, built level by level (Limasset
et al., "Fast and Scalable Minimal Perfect Hashing for Massive Key Sets", 2017): keys that fall
alone on a bit of a level are settled there, the rest go on. A key's rank among the set bits is
its slot; the slot has a 32-bit fingerprint, the key's first row and its number of rows; a row has
its offset in the payload. A keyed access reads one bit per level, one slot and one offset pair,
about 1.6 levels on average, however large the shard is. The sorted keys are stored as well, for
scans only.

Plan: one range exchange on doc_id (the order the format asks for), then encoding and writing in
the same task. Rows that share a doc_id, or have none, are told apart by how their texts begin and by
hashes of text and place, so that many of them fill several shards. An attempt writes files under names of its own, and only rows of successful tasks
reach the manifest, so lost executors and repeated attempts cannot damage a dataset; leftovers
of failed attempts are deleted at commit. Files go through pyarrow's file systems, by URI.

Defined results: a null text is empty and yields the end id alone; rows with one doc_id stay
separate rows, in the order of their texts' beginnings; null doc_ids come first and are reached by scans only.
An empty table gives an empty dataset. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch, delete, input_bytes
from .workers import tidy

END_ID = 1
#: Estimated bytes of input for each shard.
SHARD_BYTES = 64 << 20
GAMMA = 2.0
MAX_LEVELS = 48
MAGIC = b"TESSIDX1"

_MANIFEST = pa.schema([("shard", pa.int32()), ("stem", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over unsigned 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return _mix(keys.astype(np.int64).view(np.uint64) ^ _mix(np.full(1, level + 1, np.uint64)))


class PerfectHash:
    """A minimal perfect hash over distinct int64 keys."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - bits)
            total += int(bits.sum())
        self.settled = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys) and len(levels) < MAX_LEVELS:
            size = max(8, int(math.ceil(gamma * len(keys))))
            at = (_level_hash(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, from 0; for a key outside the set any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                return out
            at = (_level_hash(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            where = np.searchsorted(self.rest, keys[todo])
            hit = (where < len(self.rest)) & (self.rest[np.minimum(where, len(self.rest) - 1)] == keys[todo])
            out[todo[hit]] = self.settled + where[hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_level_hash(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


class ShardIndex:
    """Keys to places in the payload of one shard."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        sizes = arrays["level_sizes"]
        bits = np.unpackbits(arrays["level_bits"], bitorder="little").astype(bool)
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.hash = PerfectHash([bits[a:b] for a, b in zip(cuts[:-1], cuts[1:])], arrays["rest"])
        self.n_null = int(arrays["n_null"][0])

    @classmethod
    def build(cls, keys: list[int | None], lengths: np.ndarray, width: int) -> ShardIndex:
        """``keys`` ascending with nulls first; ``lengths`` in ids; ``width`` bytes an id."""
        n_null = next((i for i, k in enumerate(keys) if k is not None), len(keys))
        rows = np.array(keys[n_null:], dtype=np.int64)
        distinct, first, count = np.unique(rows, return_index=True, return_counts=True)
        table = PerfectHash.build(distinct)
        slot = table.slots(distinct)
        by_slot = np.argsort(slot)
        return cls(
            {
                "level_sizes": np.array([len(x) for x in table.levels], "<i8"),
                "level_bits": np.packbits(np.concatenate([*table.levels, np.zeros(0, bool)]), bitorder="little"),
                "rest": table.rest.astype("<i8"),
                "fingerprint": _fingerprint(distinct)[by_slot],
                "first": (first + n_null)[by_slot].astype("<i8"),
                "count": count[by_slot].astype("<i4"),
                "offsets": np.concatenate([[0], np.cumsum(lengths)]).astype("<i8"),
                "keys": rows.astype("<i8"),
                "n_null": np.array([n_null], "<i8"),
                "width": np.array([width], "<i8"),
            }
        )

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, number of rows) of each key; number 0 where the shard hasn't got the key."""
        a = self.arrays
        if not len(a["fingerprint"]):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.hash.slots(keys)
        known = (slot >= 0) & (a["fingerprint"][np.maximum(slot, 0)] == _fingerprint(keys))
        slot = np.maximum(slot, 0)
        return np.where(known, a["first"][slot], 0), np.where(known, a["count"][slot], 0)

    def dump(self) -> bytes:
        head = json.dumps([[k, v.dtype.str, len(v)] for k, v in self.arrays.items()]).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *(v.tobytes() for v in self.arrays.values())])

    @classmethod
    def load(cls, data: bytes) -> ShardIndex:
        if data[:8] != MAGIC:
            raise ValueError("not a token index")
        size = struct.unpack("<I", data[8:12])[0]
        at, arrays = 12 + size, {}
        for name, kind, n in json.loads(data[12:at]):
            arrays[name] = np.frombuffer(data, kind, n, at)
            at += arrays[name].nbytes
        return cls(arrays)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _write(root: str, vocabulary: str, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        shard = TaskContext.get().partitionId()
        stem = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        fs, path = _open(root)
        fs.create_dir(path, recursive=True)
        out, keys, lengths = None, [], []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in tokens.slices(batch.column(1)):
                out = out or fs.open_output_stream(f"{path}/{stem}.ids")
                payloads = encoder.encode(texts)
                if width == 2:
                    payloads = [np.frombuffer(p, "<u4").astype("<u2").tobytes() for p in payloads]
                for payload in payloads:
                    out.write(payload + end)
                    lengths.append(len(payload) // width + 1)
                keys.extend(ids[a:b])
        if out is None:
            return
        out.close()
        index = ShardIndex.build(keys, np.array(lengths, np.int64), width)
        with fs.open_output_stream(f"{path}/{stem}.idx") as f:
            f.write(index.dump())
        row = (shard, stem, len(keys), int(sum(lengths)), keys[index.n_null] if index.n_null < len(keys) else None, keys[-1])
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _MANIFEST)], schema=_MANIFEST)

    return run


def _shards(docs: DataFrame) -> int:
    """A number of shards from the input's bytes: the planner's estimate or, without one, a scan."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(input_bytes(docs, "text") / SHARD_BYTES))


def write_tokens(docs: DataFrame, root: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the dataset at ``root`` and returns its manifest, with each shard's first id as ``start``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    apart = rows.withColumn("head", F.left("text", F.lit(32))).withColumn("tie", F.xxhash64("text")).withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    order = ["doc_id", "head", "tie", "place"]
    ordered = apart.repartitionByRange(_shards(rows), *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(_write(root, vocabulary or tokens.vocabulary(), end_id), "shard int, stem string, n_docs bigint, n_tokens bigint, first_doc bigint, last_doc bigint").write.mode("overwrite").parquet(f"{root}/manifest")
    manifest = read_manifest(spark, root)
    _sweep(spark, root, {x["stem"] for x in manifest.select("stem").toLocalIterator()})
    return manifest


def _sweep(spark: SparkSession, root: str, stems: set[str]) -> None:
    """Deletes files of failed attempts; driver memory is one name a shard."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listing = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not listing.exists(folder):
        return
    for status in listing.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("shard-") and name.rsplit(".", 1)[0] not in stems:
            delete(spark, f"{root}/{name}")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row a shard: shard, stem, n_docs, n_tokens, first_doc, last_doc, start."""
    rows = spark.read.schema("shard int, stem string, n_docs bigint, n_tokens bigint, first_doc bigint, last_doc bigint").parquet(f"{root}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shards
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(root: str, with_ids: bool):
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, path = _open(root)
            for shard in batch.to_pylist():
                with fs.open_input_stream(f"{path}/{shard['stem']}.idx") as f:
                    index = ShardIndex.load(f.read())
                width = int(index.arrays["width"][0])
                offsets, keys = index.arrays["offsets"], index.arrays["keys"]
                ids = [None] * index.n_null + keys.tolist()
                rows = np.arange(len(ids))
                if len(keys):
                    first, count = index.lookup(keys)
                    if not count.all():
                        raise ValueError(f"a key of {shard['stem']} is missing from its index")
                    again = np.arange(len(keys)) + index.n_null - first
                    rows[index.n_null :] = first + np.where(again < count, again, 0)
                with fs.open_input_file(f"{path}/{shard['stem']}.ids") as payload:
                    for a in range(0, len(ids), 1000):
                        part = rows[a : a + 1000]
                        low, high = int(offsets[part[0]]), int(offsets[part[-1] + 1])
                        raw = np.frombuffer(payload.read_at((high - low) * width, low * width), f"<u{width}").astype("<u4")
                        cols: list[list] = [[], [], [], [], []]
                        for doc, row in zip(ids[a : a + 1000], part):
                            data = raw[offsets[row] - low : offsets[row + 1] - low]
                            for col, value in zip(cols, (doc, shard["start"] + int(offsets[row]), len(data), zlib.crc32(data.tobytes()), data if with_ids else None)):
                                col.append(value)
                        types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)][: 5 if with_ids else 4], names=names[: 5 if with_ids else 4])

    return run


def read_tokens(spark: SparkSession, root: str, *, with_ids: bool = False) -> DataFrame:
    """Every document of the dataset, from its files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    manifest = read_manifest(spark, root)
    shards = max(1, spark.read.schema("shard int").parquet(f"{root}/manifest").count())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return manifest.repartition(shards).mapInArrow(_read(root, with_ids), schema)


def fetch(spark: SparkSession, root: str, keys: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Keyed access: (doc_id, ids) for each row of each asked key that the dataset has.

    The ids are cut into as many equal ranges as there are shards, so keys and shards meet by an
    equality: a range's number. As shards are disjoint but for shared ends, they name at most about
    three times as many ranges as there are shards. A shard's task reads its index once and then only
    the payload ranges of its keys.
    """
    manifest = read_manifest(spark, root).select("shard", "stem", "first_doc", "last_doc").where("first_doc is not null")
    shards, low, high = manifest.agg(F.count(F.lit(1)), F.min("first_doc"), F.max("last_doc")).first()
    asked = keys.select(F.col(id_col).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    low, step = low or 0, max(1, ((high or 0) - (low or 0)) // max(1, shards) + 1)

    def place(doc: str):
        return F.floor((F.col(doc).cast("decimal(20,0)") - F.lit(low)) / F.lit(step)).cast("bigint")

    covered = manifest.withColumn("range", F.explode(F.sequence(place("first_doc"), place("last_doc"))))
    asked = asked.where(F.col("doc_id").between(low, high if high is not None else low)).withColumn("range", place("doc_id"))
    met = asked.join(covered, "range").where((F.col("doc_id") >= F.col("first_doc")) & (F.col("doc_id") <= F.col("last_doc")))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, index, payload = None, None, None
        for batch in batches:
            fs, path = _open(root)
            for doc, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != stem:
                    with fs.open_input_stream(f"{path}/{name}.idx") as f:
                        index = ShardIndex.load(f.read())
                    stem, payload = name, fs.open_input_file(f"{path}/{name}.ids")
                width, offsets = int(index.arrays["width"][0]), index.arrays["offsets"]
                first, count = index.lookup(np.array([doc], np.int64))
                found = [
                    np.frombuffer(payload.read_at(int(offsets[r + 1] - offsets[r]) * width, int(offsets[r]) * width), f"<u{width}").astype(np.int64)
                    for r in range(int(first[0]), int(first[0] + count[0]))
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return met.select("doc_id", "stem").repartition("stem").sortWithinPartitions("stem", "doc_id").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def round_trip(docs: DataFrame, *, scratch: Scratch | None = None, **options) -> DataFrame:
    """Writes ``docs`` to a dataset in the shared folder and reads it back."""
    scratch = scratch or Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, scratch.path("dataset"), **options)
    return read_tokens(docs.sparkSession, scratch.path("dataset"))
