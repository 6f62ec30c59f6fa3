"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embed_dedup, fim, html_extract, line_dedup, lm_score, mixing, near_dup, packing, pii, token_files, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 2, as its SQL states."""
    return _scored(spark, sf_dir, 2)


def op9_lm_scoring_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production order; SQL for it is not written, tests compare it with a plain version."""
    return _scored(spark, sf_dir, lm_score.ORDER)


def _scored(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    scored = lm_score.score(_read(spark, sf_dir, "documents"), order=order)
    # six places: sums of logarithms differ beyond that with the order of addition; + 0.0 for minus zero
    return scored.select("doc_id", "n_tokens", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("log_prob", "score")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(_read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_token_files, op3_best_fit_packing, op4_minhash_near_dedup, op5_mixing,
        op6_exact_topk, op7_personal_data, op8_toxicity, op9_lm_scoring, op10_embedding_near_dedup,
        op11_fill_in_middle, op12_source_divergence, op13_line_dedup,
    )
}

#: Further queries of an operator.
MORE: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_lm_scoring_order3": op9_lm_scoring_order3}

SQL: dict[str, str] = {
    "op4_minhash_near_dedup": near_dup.SQL,
    "op5_mixing": mixing.SQL,
    "op6_exact_topk": topk.SQL,
    "op9_lm_scoring": lm_score.SQL,
    "op10_embedding_near_dedup": embed_dedup.SQL,
    "op11_fill_in_middle": fim.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_line_dedup": line_dedup.SQL,
}
