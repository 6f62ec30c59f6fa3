"""Readers and writers of the record files that agents and shops leave behind.

Schemas are given, so no reader looks through a file twice. ``read_json_arrays`` reads each file in one task,
which is what the files of workers, tasks and shards are; ``json_arrays`` splits large ones and ``products`` reads the
catalogue, whose fields change their types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "array<struct<`from`:string,value:string>>"
TRAJECTORY = f"dataset string, id string, conversations {TURNS}, reward double, success boolean, action_value_dict array<array<struct<action:string,value:double>>>"
SFT_SAMPLE = f"id string, conversations {TURNS}, game_file string, reward double"
Q_SAMPLE = f"id string, conversations {TURNS}, label double"
RESULT = f"meta struct<steps:int,reward:double,finished:boolean,success:boolean,terminate_reason:string,error:string>, conversations {TURNS}"
SESSION_LOG = "page string, url string, goal string, content string, reward double, reward_info string"


def read_json_arrays(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of files that each hold one JSON array (or one object), with the file they are from."""
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("source_file", F.input_file_name())


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """One row per task's result file; the task is the file's name."""
    rows = read_json_arrays(spark, folder, RESULT)
    return rows.withColumn("task", F.regexp_extract("source_file", r"([^/]+)\.json$", 1)).drop("source_file")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(at, task, variation) of a file like [["task", 3], ...], or (at, null, id) of one like [1, 2, ...]."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("at", "item"))
    pair = F.from_json("item", "array<string>")
    is_pair = F.col("item").startswith("[")
    return rows.select("at", F.when(is_pair, pair[0]).alias("task"), F.when(is_pair, pair[1]).otherwise(F.col("item")).cast("int").alias("variation"))


def read_ranked_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(category, at, attribute, score) of a file of 'category:' lines, each followed by '- attribute | 0.1234' lines."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\S[^\n]*:[ ]*(?:\n[ ]*- [^\n]*)*)"), F.lit(1))).alias("block"))
    category = F.regexp_replace(F.regexp_extract("block", r"^([^\n]*):", 1), "^['\"]|['\"]$", "")
    lines = F.regexp_extract_all("block", F.lit(r"(?m)^[ ]*- ['\"]?(.*?)['\"]?$"), F.lit(1))
    rows = blocks.select(category.alias("category"), F.posexplode(lines).alias("at", "line"))
    return rows.select("category", "at", F.trim(F.substring_index("line", "|", 1)).alias("attribute"), F.trim(F.substring_index("line", "|", -1)).try_cast("double").alias("score"))


def write_json_lines(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).json(path)


def write_index_documents(documents: DataFrame, path: str, order: str, limits: tuple[int | None, ...] = (100, 1_000, 100_000, None)) -> None:
    """JSON lines of (id, contents, ...) for indexing, one folder per limit: the first so many in catalogue order, or all."""
    for limit in limits:
        some = documents if limit is None else documents.where(F.col(order) <= limit)
        write_json_lines(some.drop(order), f"{path}/{'all' if limit is None else limit}")


def write_json_arrays(rows: DataFrame, path: str, order: list[str], per_file: int = 1_000) -> None:
    """Files that each hold one JSON array of about ``per_file`` rows, rows of a file in order."""
    write_element_arrays(rows.select(*order, F.to_json(F.struct(*rows.columns)).alias("json_")), path, order, "json_", per_file)


def write_element_arrays(rows: DataFrame, path: str, order: list[str], text: str, per_file: int = 1_000) -> None:
    """As write_json_arrays, of rows whose column ``text`` is an element's JSON already."""
    files = max(1, -(-rows.count() // per_file))
    chunk = F.pmod(F.xxhash64(*order), F.lit(files)).alias("chunk")
    lists = rows.select(chunk, F.struct(*order, F.col(text).alias("json_")).alias("r"))
    joined = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["json_"]), ",\n"), F.lit("]"))
    lists.groupBy("chunk").agg(joined.alias("value")).write.partitionBy("chunk").text(path)


def write_ranked_attributes(rows: DataFrame, path: str) -> None:
    """A folder of text with a 'category:' line and its '- attribute | 0.1234' lines per category."""
    line = F.concat(F.lit("- "), "attribute", F.lit(" | "), F.format_string("%.4f", "score"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "attribute", line.alias("line"))))
    blocks = rows.groupBy("category").agg(F.concat("category", F.lit(":\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("value"))
    blocks.select("value").write.text(path)
