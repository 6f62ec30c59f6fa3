"""Written intermediate tables of the library, in the folder that driver and executors share.

The folder is the one that the session names in ``spark.checkpoint.dir``; only a plain ``local[...]`` session
that names none gets a temporary folder. A saved table cuts the lineage: what it holds does not change when
an executor is lost, even if the plan that made it would number or sample rows differently a second time.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='tessera-work-')}")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used; what is written there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended, and with it the use of the folder
        pass
