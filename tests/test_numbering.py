"""Distributed numbers and running sums against plain ones."""

import random

from pyspark.sql import functions as F

from tessera.operators import goals
from tessera.operators.numbering import meet_ranges, numbered, running


def rows(n=500, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, *range(20)]), rng.randint(0, 9)) for i in rng.sample(range(n), n)]


def test_numbers(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, k int, w int").repartition(7)
    got = {r.id: (r.at, r.n) for r in numbered(df, [F.col("k").desc(), F.col("id")], "at", "n").collect()}
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: (i, len(data)) for i, r in enumerate(want)}
    assert numbered(df.where("id < 0"), ["id"]).collect() == []


def test_running_sums(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, k int, w int").repartition(7)
    got = {r.id: (r.upto, r.total) for r in running(df, ["id"], "w").collect()}
    sums, s = {}, 0
    for i, _, w in sorted(data):
        s += w
        sums[i] = s
    assert got == {i: (x, s) for i, x in sums.items()}


def test_no_task_sees_the_whole_table(spark):
    df = spark.range(1000).withColumn("w", F.lit(1))
    for frame in (numbered(df, ["id"]), running(df, ["id"], "w")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        alone = [i for i, line in enumerate(lines) if "SinglePartition" in line]
        # what one task sees has been counted by range
        assert alone and all("HashAggregate(keys=[range_" in lines[i + 1] for i in alone), plan


def test_points_meet_ranges(spark):
    rng = random.Random(4)
    cuts = sorted({0.0, 1.0, 0.5, *(rng.random() for _ in range(60))})
    ranges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], "r int, low double, high double")
    points = [0.0, 0.5, 0.999999999, *cuts[1:-1], *(rng.random() for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(points)), "p int, u double")
    for buckets in (1, 7, 1000):
        got = {r.p: r.r for r in meet_ranges(df, ranges, "u", "low", "high", buckets).collect()}
        assert got == {p: next(i for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a <= u < b) for p, u in enumerate(points)}


def test_choice_by_weight(spark):
    weights = [5, 0, 1, 30, 0, 4]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "g int, w int")
    draws = spark.createDataFrame([(i, i / 400) for i in range(400)], "draw_id int, u double")
    got = goals.weighted_choice(df, draws, "w", ["g"]).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {i: 10 * w for i, w in enumerate(weights) if w}
