"""The data-parallel part of value models: pooling, heads, losses, padding, batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def mlp_head(vector: Column, layers: list[tuple[np.ndarray, np.ndarray]], sigmoid: bool = False) -> Column:
    """A value head: linear layers with ReLU between them. The weights travel with the task; batches are Arrow's."""

    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        x = np.vstack(vectors.to_numpy()).astype(np.float64)
        for i, (weight, bias) in enumerate(layers):
            x = x @ weight + bias
            if i + 1 < len(layers):
                x = np.maximum(x, 0)
        x = x[:, 0]
        return pd.Series(1 / (1 + np.exp(-x)) if sigmoid else x)

    return run(vector)


def linear_score(vector: Column, weights: list[float], bias: float = 0.0, sigmoid: bool = False) -> Column:
    """One linear unit, by expressions alone."""
    w = F.array(*map(F.lit, map(float, weights)))
    z = F.aggregate(F.zip_with(vector, w, lambda x, y: x.cast("double") * y), F.lit(float(bias)), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z)) if sigmoid else z


def last_token_index(ids: Column, pad: int) -> Column:
    """The place before the first padding, from 0; the last place where there is none."""
    return F.pmod(F.greatest(F.array_position(ids, pad), F.lit(1)) - 2, F.size(ids)).cast("int")


def last_index_clamped(ids: Column, pad: int, length: int) -> Column:
    """As last_token_index, but within 0 and the length of the states that were computed."""
    first = F.array_position(ids, pad)
    raw = F.when(first > 0, first - 2).otherwise(F.size(ids) - 1)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(length - 1)).cast("int")


def masked_mean(states: DataFrame, key: str, dim: str, value: str, mask: str) -> DataFrame:
    """Mean over unmasked places per dimension; the number of places is at least 1e-9."""
    m = F.col(mask).cast("double")
    return states.groupBy(key, dim).agg((F.sum(F.col(value) * m) / F.greatest(F.sum(m), F.lit(1e-9))).alias("mean"))


def mse(rows: DataFrame, prediction: str, label: str) -> DataFrame:
    """Mean squared error, each row's label standing for all of its predictions."""
    return rows.agg(F.avg(F.pow(F.col(prediction) - F.col(label), 2)).alias("mse"))


def pad_or_cut(ids: Column, length: int, pad: int, left: bool = False) -> Column:
    """Exactly ``length`` ids: padded on the right, cut on the right, or on the left if asked."""
    cut = F.when(F.size(ids) > length, F.slice(ids, F.size(ids) - length + 1, F.lit(length))).otherwise(ids) if left else F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda i: i != pad)


def length_grouped_order(rows: DataFrame, size: str, draw: list[Column], batch: int, mega: int = 50) -> DataFrame:
    """Batches of similar length: rows in hash order, cut into mega-batches, each sorted by falling length.

    Adds place (the order of reading) and batch_id. A mega-batch is sorted in one task, the table never is.
    """
    shuffled = numbered(rows, draw, "at")
    chunk = F.floor(F.col("at") / (batch * mega))
    within = Window.partitionBy("chunk").orderBy(F.col(size).desc(), "at")
    placed = shuffled.withColumn("chunk", chunk).withColumn("place", F.col("chunk") * batch * mega + F.row_number().over(within) - 1)
    return placed.withColumn("batch_id", F.floor(F.col("place") / batch)).drop("chunk", "at")
