import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barograph.operators.intervals import interval_counts, interval_join


@pytest.mark.parametrize("width", [1, 64, 10**9])
def test_counts_are_those_of_the_join(spark, width):
    draw = random.Random(5)
    points = [(draw.choice(["a", "b", None]), draw.randint(-300, 300), k) for k in range(600)] + [("a", None, 999)]
    ranges = [(draw.choice(["a", "b", None]), a, a + draw.choice([-3, 0, 1, 5, 60, 2500])) for a in (draw.randint(-400, 400) for _ in range(200))] + [("a", None, 5), ("a", 5, None), ("c", 0, 9)]
    p, r = spark.createDataFrame(points, "s string, at long, p long"), spark.createDataFrame(ranges, "s string, low long, high long")
    want = {}
    for s, low, high in {x for x in ranges if None not in x}:
        n = sum(x[0] == s and x[1] is not None and low <= x[1] < high for x in points)
        want |= {(s, low, high): n} if n else {}
    got = interval_counts(p, r, "at", "low", "high", ["s"], width, "n").collect()
    assert {(g.s, g.low, g.high): g.n for g in got} == want and len(got) == len(want) > 50


def test_listed_points_are_never_broadcast(spark, sf):
    """Points listed under many cells are more than Spark's estimate of them, which may be under the broadcast limit."""
    p = spark.range(1000).select(F.lit("a").alias("s"), F.col("id").alias("at"))
    r = spark.range(50).select(F.lit("a").alias("s"), F.col("id").alias("low"), (F.col("id") + 700).alias("high"), F.lit("x" * 500).alias("wide"))
    joined = interval_join(p, r, "at", "low", "high", ["s"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and joined.count() == 50 * 700
    plan = entry.queries()["window_tick_counts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" not in plan
