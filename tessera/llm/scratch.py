"""Written intermediate tables in the folder that the whole cluster shares.

A table written here cuts the lineage and outlives any executor, so a lost executor costs the
tasks it was running and nothing that was already saved. The folder is the one the session
names in ``spark.checkpoint.dir``. Only a plain ``local[...]`` session that names none gets a
temporary folder of its own; on a cluster the missing setting is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI without a trailing slash."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


def delete(spark: SparkSession, path: str) -> None:
    """Removes ``path`` from whatever file system it is on; a missing path is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of the Arrow batches that pass between Spark and Python while a table is saved: whole texts may be long.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables of one operator call, below a folder of their own.

    ``drop`` frees a table as soon as nothing will read it again. What a returned frame still
    reads stays until the driver's Python ends, because the caller runs that frame later.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def save(self, df: DataFrame, tag: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
        path = self.path(tag)
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_BATCH, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            delete(self.spark, self.path(tag))

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended first; its folder is its own
            pass


def planned_bytes(df: DataFrame) -> int | None:
    """The planner's estimate of a frame's bytes, from file sizes; None where it has no useful one."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else None


def input_bytes(df: DataFrame, text: str) -> int:
    """About how many bytes a frame holds: the planner's estimate or, where it has none, the bytes of its texts by a scan."""
    size = planned_bytes(df)
    return size if size is not None else int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
