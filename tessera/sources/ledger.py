"""Output that grows batch by batch, each batch in it once, whatever is killed or replayed.

A batch is written to a folder of its own attempt and becomes part of the output only when a manifest with the
batch's name appears, by a rename that fails if the name is taken. So an attempt that dies leaves a folder that no reader
looks at, a replay finds the name taken and leaves the output as it is, and of two attempts at once one wins.
Works on any store whose rename within a folder is atomic.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


class Ledger:
    """JSON lines of one schema below ``path``: attempts in data/, manifests in commits/."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self, folder: str) -> Iterator[str]:
        at = self._at(folder)
        fs = at.getFileSystem(self._conf)
        if fs.exists(at):
            for status in fs.listStatus(at):
                yield status.getPath().getName()

    @staticmethod
    def _checked(batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"a batch is named by letters, digits, dots, dashes and underscores: {batch!r}")
        return batch

    def committed(self, batch: str) -> bool:
        at = self._at("commits", f"{self._checked(batch)}.json")
        return at.getFileSystem(self._conf).exists(at)

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Adds ``rows`` as the batch, unless a batch of this name is there already; whether this call added it."""
        if self.committed(batch):
            return False
        attempt = f"{batch}--{uuid.uuid4().hex}"
        rows.write.json(f"{self.path}/data/{attempt}")
        return self._commit(batch, attempt)

    def _commit(self, batch: str, attempt: str) -> bool:
        jvm = self._jvm
        draft, final = self._at("commits", f"_{attempt}.tmp"), self._at("commits", f"{batch}.json")
        stream = draft.getFileSystem(self._conf).create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"batch": batch, "attempt": attempt}).encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, none)
            return True
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            draft.getFileSystem(self._conf).delete(draft, False)
            return False

    def attempts(self) -> dict[str, str]:
        """The attempt of each committed batch: one name a batch."""
        names = [n for n in self._files("commits") if n.endswith(".json") and not n.startswith("_")]
        if not names:
            return {}
        rows = self.spark.read.schema("batch string, attempt string").json([f"{self.path}/commits/{n}" for n in names]).collect()
        return {r.batch: r.attempt for r in rows}

    def read(self) -> DataFrame:
        """All rows of committed batches."""
        paths = [f"{self.path}/data/{attempt}" for attempt in self.attempts().values()]
        return self.spark.read.schema(self.schema).json(paths) if paths else self.spark.createDataFrame([], self.schema)

    def remaining(self, tasks: DataFrame, keys: list[str]) -> DataFrame:
        """Tasks of which the output has no row yet."""
        return tasks.join(self.read().select(*keys).distinct(), keys, "left_anti")

    def clean(self) -> list[str]:
        """Deletes attempts without a manifest and drafts; only while nothing is writing. The names of what went."""
        kept, gone = set(self.attempts().values()), []
        for folder, names in (("data", set(self._files("data")) - kept), ("commits", {n for n in self._files("commits") if n.startswith("_")})):
            for name in names:
                at = self._at(folder, name)
                at.getFileSystem(self._conf).delete(at, True)
                gone.append(name)
        return sorted(gone)

    def stream(self, frame: DataFrame, name: str) -> DataStreamWriter:
        """A writer whose batches are ``name`` and the batch's number: a batch that is run again after a failure is added once."""
        self._checked(name)
        return frame.writeStream.foreachBatch(lambda rows, number: self.append(rows, f"{name}-{number}") and None)
