"""Numbers and running sums in one order over a whole table, without a task that sees all of it.

The table is dealt out by ranges of the order and saved with each row's place in its range. Ranges are few and
have one row each in a table of counts and sums, whose running sums are the offsets that are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import workspace

_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` saved by ranges of ``order``, with range_ and at_, the row's place in its range."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id())
    saved = workspace.save(placed, "ranges")
    return saved.select("*", F.shiftright("id_", _ROW_BITS).alias("range_"), F.col("id_").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("at_")).drop("id_")


def _offsets(ranged: DataFrame, *sums: Column) -> DataFrame:
    """(range_, the sums over all ranges before it, the sums over all): one row a range."""
    names = [f"sum{i}_" for i in range(len(sums))]
    each = ranged.groupBy("range_").agg(*(s.alias(n) for s, n in zip(sums, names)))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("range_", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in names), *(F.sum(n).over(Window.partitionBy()).alias(f"all_{n}") for n in names))


def numbered(df: DataFrame, order: list[str | Column], name: str = "at", total: str | None = None) -> DataFrame:
    """``df`` with each row's place in ``order``, from 0, and on demand the number of rows.

    The order should be total; rows that tie are numbered in any order, but once for all.
    """
    ranged = _ranged(df, [F.col(c) if isinstance(c, str) else c for c in order])
    joined = ranged.join(F.broadcast(_offsets(ranged, F.count(F.lit(1)))), "range_")  # one row a shuffle partition
    more = [F.col("all_sum0_").alias(total)] if total else []
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("before_sum0_") + F.col("at_")).alias(name), *more)


def running(df: DataFrame, order: list[str | Column], value: str, upto: str = "upto", total: str = "total") -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row in ``order``, and over all rows.

    Sums of integers are exact; of floats they are the sum of a range's and the earlier ranges' sums.
    """
    ranged = _ranged(df, [F.col(c) if isinstance(c, str) else c for c in order])
    within = Window.partitionBy("range_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.withColumn("within_", F.sum(value).over(within)).join(F.broadcast(_offsets(ranged, F.sum(value))), "range_")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.coalesce(F.col("before_sum0_"), F.lit(0)) + F.coalesce(F.col("within_"), F.lit(0))).alias(upto), F.col("all_sum0_").alias(total))


def meet_ranges(points: DataFrame, ranges: DataFrame, u: str, low: str, high: str, buckets: int) -> DataFrame:
    """Each point with the ranges whose [low, high) holds it, all within [0, 1]: an equi-join on equal buckets.

    A range is in as many buckets as it covers; ranges that do not overlap come to at most their number plus ``buckets``.
    """
    bucket = lambda c: F.least(F.floor(F.col(c) * buckets), F.lit(buckets - 1)).cast("bigint")
    spread = ranges.withColumn("bucket_", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("bucket_", bucket(u)).join(spread, "bucket_").where((F.col(u) >= F.col(low)) & (F.col(u) < F.col(high))).drop("bucket_")
