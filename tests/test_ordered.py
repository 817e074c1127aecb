import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.operators import indicators as I
from barograph.operators import quality
from barograph.operators.bars import with_index
from barograph.operators.ordered import BLOCK, largest, most_frequent, percentiles, rolling, scan


def series(n=400, seed=1, symbols=("a", None, "b")):
    draw, out = random.Random(seed), []
    for s in symbols:
        at = draw.randint(-5000, 0)
        for k in range(n):
            at += draw.choice([0, 1, 1, 7, 300])
            out.append((s, at, k, draw.choice([None, draw.randint(-50, 50)])))
    return out


@pytest.mark.parametrize(("width", "levels"), [(1, 2), (10, 1), (10, 2), (3000, 2), (10**9, 1)])
def test_scan_is_a_loop(spark, width, levels, monkeypatch):
    from barograph.operators import ordered

    monkeypatch.setattr(ordered, "FAN", 3)
    data = series()
    df = spark.createDataFrame(data, "symbol string, ms long, seq long, x long").repartition(5)
    kinds = {f"{k}_{i}": (k, F.col("x"), bool(i)) for k in ("sum", "max", "last") for i in (0, 1)}
    got = {(r.symbol, r.seq): r for r in scan(df, ["symbol"], ["ms", "seq"], width, kinds, levels).collect()}
    assert len(got) == len(data)
    for s in ("a", None, "b"):
        seen = []
        for _, ms, seq, x in sorted((r for r in data if r[0] == s), key=lambda r: r[1:3]):
            for upto in (0, 1):
                values = [v for v in [*seen, *([x] if upto else [])] if v is not None]
                r = got[s, seq]
                assert (r[f"sum_{upto}"], r[f"max_{upto}"], r[f"last_{upto}"]) == (sum(values), max(values, default=None), values[-1] if values else None)
                assert r[BLOCK] == ms // width
            seen.append(x)


def test_scan_of_nothing_and_of_null_times(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2)], "symbol string, ms long, x long")
    assert {(r.ms, r.s) for r in scan(df, ["symbol"], ["ms"], 10, {"s": ("sum", F.col("x"), True)}).collect()} == {(None, 1), (5, 3)}
    assert scan(df.limit(0), ["symbol"], ["ms"], 10, {"s": ("sum", F.col("x"), True)}).count() == 0


@pytest.mark.parametrize(("n", "block"), [(1, 4), (3, 4), (5, 4), (17, 4), (20, 1000)])
def test_frames_reach_over_blocks(spark, n, block):
    draw = random.Random(2)
    close = {s: [draw.uniform(1, 2) for _ in range(60)] for s in "ab"}
    df = spark.createDataFrame([(s, i, x, x + 0.5, x - 0.25) for s, xs in close.items() for i, x in enumerate(xs)], "symbol string, i long, close double, high double, low double")
    got = I.with_returns(I.with_true_range(I.with_sma(df, n, block=block), block=block), block=block).collect()
    assert len(got) == 120
    for r in got:
        xs = close[r.symbol]
        want = np.mean(xs[r.i - n + 1 : r.i + 1]) if r.i >= n - 1 else None
        assert r.sma == (None if want is None else pytest.approx(want))
        before = xs[r.i - 1] if r.i else None
        assert r.tr == pytest.approx(0.75 if before is None else max(0.75, abs(r.high - before), abs(r.low - before)))
        assert r.ret == (None if before is None else pytest.approx((r.close - before) / before))
    dd = {(r.symbol, r.i): r.dd for r in I.with_drawdown(df, block=block).collect()}
    assert all(dd[s, i] == pytest.approx(max(xs[: i + 1]) - xs[i]) for s, xs in close.items() for i in range(60))
    lag = rolling(df, ["symbol"], "i", n, {"far": lambda w: F.lag("close", n - 1).over(w)}, block)
    assert all(r.far == (close[r.symbol][r.i - n + 1] if r.i >= n - 1 else None) for r in lag.collect())


def test_percentiles_of_large_and_odd_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": np.concatenate((np.full(5000, 7.0), rng.normal(size=2500))), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "wide": rng.lognormal(0, 200, 999), None: rng.normal(size=101)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "symbol string, x double")
    wanted = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0, "p333": 0.333}
    got = {r.symbol: r for r in percentiles(df, ["symbol"], F.col("x"), wanted).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        for name, q in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(xs, q), rel=1e-9)
    assert percentiles(df.limit(0), ["symbol"], F.col("x"), wanted).count() == 0


def test_most_frequent_and_largest(spark):
    rows = [("a", 1), ("a", 2), ("a", 2), ("a", 1), ("a", None), ("b", None), ("c", 9)] + [("h", k % 3) for k in range(100)]
    df = spark.createDataFrame(rows, "symbol string, x long")
    assert {(r.symbol, r.value, r.n) for r in most_frequent(df, ["symbol"], F.col("x")).collect()} == {("a", 1, 2), ("c", 9, 1), ("h", 0, 34)}
    blocks = df.withColumn(BLOCK, F.col("x") * 2000)
    assert {(r.symbol, *r.top) for r in largest(blocks, ["symbol"], F.col("x"), 3).collect()} == {("a", 2, 2, 1), ("c", 9), ("h", 2, 2, 2)}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_no_window_lines_up_a_symbol(spark):
    """Every window over rows is parted by a block, too; those of blocks, stretches and parts have a row for each."""
    t = spark.createDataFrame([("a", 1, 1, 1.0, 2.0)], "symbol string, seq long, ms long, bid double, ask double")
    b = spark.createDataFrame([("a", 1, 1.0, 1.0, 1.0)], "symbol string, ms long, close double, high double, low double")
    made = [quality.quality_report(t), quality.top_gaps(t), quality.resolution(t), quality.utc_offset(t), quality.repeats(t), with_index(b), I.with_sma(with_index(b), 20), I.with_drawdown(with_index(b))]
    for df in made:
        plan = plan_of(df)
        assert not re.search(r"\b(percentile|mode)\(", plan)
        for parted, lined in re.findall(r"\n[^\n]*\bWindow \[[^\n]*?\], \[([^\]]*)\], \[([^\]]*)\]", plan):
            if re.fullmatch(r"symbol#\d+", parted):
                assert re.match(r"(_stretch|_part|_block)#", lined), (parted, lined)


def test_one_symbol_is_the_work_of_many_tasks(spark):
    t = spark.range(40_000).selectExpr("'a' as symbol", "id as seq", "id * 60000 as ms", "1.0 + id % 7 as bid", "2.0 + id % 11 as ask")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = quality.ordered(t).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 20_000
