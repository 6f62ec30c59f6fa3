"""A training corpus from ``documents``: five stages, each one operator, each written and read again.

toxicity: documents that the model rejects go. near_duplicates: one document of each group stays
(five-word shingles, similarity 0.8). personal_data: spans are replaced by their kind. mixing: each
source is taken as often as its target weight asks. packing: whole texts become sequences of at most
2048 tokens; the result is one row a piece.

Defined results: null and empty texts are kept by the first stage if the model's score for no words is below
its threshold, have no shingles and so no near copies, hold no spans, count as size 0, and become one piece of the end
id alone where mixing takes them. Of near copies the smallest id stays; rows without an id count by their texts. Repeated
rows are near copies of one another. A null source is a source of its own. Very long texts are processed whole and cut
in packing only. An empty table gives an empty result. Further columns travel to the last stage but one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_dup, packing, pii, toxicity
from tessera.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, recount="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot state a fitted model; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; a stage's input is dropped once its output is saved."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
