"""Queries over the data-parallel part of value models (M)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model_math as mm
from ..sources import views as v
from .reference import REGISTRY

query = REGISTRY.query

_WIDTH = 64
_WEIGHTS = [((7 * i) % 13 - 6) / 10 for i in range(_WIDTH)]


def _layers(seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [(rng.normal(size=(a, b)) / np.sqrt(a), rng.normal(size=b) / 10) for a, b in ((_WIDTH, 128), (128, 128), (128, 1))]


_DOT = "list_sum(list_transform(list_zip(embedding, [" + ", ".join(f"{w}" for w in _WEIGHTS) + "]), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) + 0.25"


@query("m01_linear_head", f"SELECT vec_id, round(1 / (1 + exp(-({_DOT}))), 6) AS score FROM embeddings")
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "embeddings").select("vec_id", F.round(mm.linear_score(F.col("embedding"), _WEIGHTS, 0.25, sigmoid=True), 6).alias("score"))


@query("m01_mlp_head")
def m01_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers in Arrow batches; tested against a plain product."""
    return v.table(spark, sf_dir, "embeddings").select("vec_id", F.round(mm.mlp_head(F.col("embedding"), _layers(), sigmoid=True), 6).alias("score"))


_IDS = "list_transform(string_split(text, ' '), lambda w: length(w)::INT)"
v.SQL["ids"] = f"SELECT conv_id, turn, {_IDS} AS ids FROM conversations"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand for token ids."""
    return v.turns(spark, sf_dir).select("conv_id", "turn", F.transform(F.split("text", " ", -1), lambda w: F.length(w)).alias("ids"))


_PADDED = "list_concat(ids[1:12], list_transform(range(greatest(12 - len(ids), 0)), lambda i: 0))"


@query("m02_last_token", v.with_views("ids", f"WITH p AS (SELECT conv_id, turn, {_PADDED} AS x FROM ids) SELECT conv_id, turn, (((greatest(coalesce(list_position(x, 0), 1), 1) - 2) % len(x) + len(x)) % len(x))::INT AS pos FROM p"))
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("conv_id", "turn", mm.last_token_index(mm.pad_or_cut(F.col("ids"), 12, 0), 0).alias("pos"))


@query("m03_masked_mean", "WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, dim::INT AS dim, round(sum(CASE WHEN vec_id % 3 <> 0 THEN x ELSE 0 END) / greatest(count(*) FILTER (vec_id % 3 <> 0), 1e-9), 6) AS mean FROM e GROUP BY 1, 2")
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3 != 0).cast("int").alias("m"), F.posexplode("embedding").alias("dim", "x"))
    rows = rows.withColumn("x", F.col("x").cast("double"))
    return mm.masked_mean(rows, "label", "dim", "x", "m").withColumn("mean", F.round("mean", 6))


@query("m04_mse", f"SELECT round(avg(power({_DOT} - label, 2)), 6) AS mse FROM embeddings")
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "embeddings").select("label", mm.linear_score(F.col("embedding"), _WEIGHTS, 0.25).alias("p"))
    return mm.mse(rows, "p", "label").select(F.round("mse", 6).alias("mse"))


@query("m05_last_index_clamped", v.with_views("ids", f"WITH p AS (SELECT conv_id, turn, {_PADDED} AS x FROM ids) SELECT conv_id, turn, least(greatest(CASE WHEN list_position(x, 0) > 0 THEN list_position(x, 0) - 2 ELSE len(x) - 1 END, 0), 7)::INT AS pos FROM p"))
def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("conv_id", "turn", mm.last_index_clamped(mm.pad_or_cut(F.col("ids"), 12, 0), 0, 8).alias("pos"))


@query("m06_pad_or_cut", v.with_views("ids", f"SELECT conv_id, turn, array_to_string({_PADDED}, ',') AS padded, array_to_string(list_concat(CASE WHEN len(ids) > 12 THEN ids[len(ids) - 11:] ELSE ids END, list_transform(range(greatest(12 - len(ids), 0)), lambda i: 0)), ',') AS left_cut FROM ids"))
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return _ids(spark, sf_dir).select("conv_id", "turn", text(mm.pad_or_cut(F.col("ids"), 12, 0)).alias("padded"), text(mm.pad_or_cut(F.col("ids"), 12, 0, left=True)).alias("left_cut"))


@query("m07_attention_mask", v.with_views("ids", f"SELECT conv_id, turn, len(list_filter({_PADDED}, lambda x: x <> 0))::INT AS on FROM ids").replace(" AS on ", " AS n_on "))
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = mm.attention_mask(mm.pad_or_cut(F.col("ids"), 12, 0), 0)
    return _ids(spark, sf_dir).select("conv_id", "turn", F.size(F.filter(mask, lambda b: b)).alias("n_on"))


@query("m08_length_grouped_batches", """
WITH s AS (SELECT doc_id, len(string_split(text, ' ')) AS size FROM documents),
a AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '#8'), doc_id) - 1 AS pos FROM s),
c AS (SELECT *, pos // 128 AS chunk FROM a),
p AS (SELECT doc_id, size, chunk * 128 + row_number() OVER (PARTITION BY chunk ORDER BY size DESC, pos) - 1 AS place FROM c)
SELECT doc_id, size::INT AS size, place, place // 16 AS batch_id FROM p""")  # fmt: skip
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ", -1)).alias("size"))
    draw = [F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("#8"))), F.col("doc_id")]
    return mm.length_grouped_order(rows, "size", draw, 16, mega=8)
