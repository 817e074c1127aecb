import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.operators import charts, control, folds, plateau, search, signals
from barograph.plans.queries import CROSS, FIXED, SPEC, walk_bars


def test_axes():
    spec = search.spec_of({"len": [10, 50, 10], "mult": [1, 3, 1]})
    assert spec.grid_size() == 15 and isinstance(spec.axes["len"], search.IntAxis)
    assert search.FloatAxis(0, 1, 0.3).grid(0) == [0, 0.3, 0.6, 0.9] and search.FloatAxis(0, 1, 0.4).grid(0) == [0, 0.4, 0.8]
    assert search.thin(range(100), 10) == [0, 11, 22, 33, 44, 55, 66, 77, 88, 99] and search.thin([1, 2], 0) == [1, 2]
    for bad in ({}, {"a": [1, 2]}, {"a": [1, 2, 0]}, {"a": [3, 2, 1]}):
        with pytest.raises(ValueError):
            search.spec_of(bad)


def test_grid_order_and_samples(spark):
    spec = search.ParamSpec({"a": search.IntAxis(1, 2), "b": search.ChoiceAxis(("x", "y", "z"))}, {"k": 7})
    assert [(r.ord, r.a, r.b, r.k) for r in search.grid(spark, spec).orderBy("ord").collect()] == [(i, 1 + i // 3, "xyz"[i % 3], 7) for i in range(6)]
    wide = search.ParamSpec({"a": search.IntAxis(1, 9, 2), "f": search.FloatAxis(0.0, 1.0, 0.25)})
    one, two = (search.sample(spark, wide, 200, 3).orderBy("ord").collect() for _ in range(2))
    assert one == two and {r.a for r in one} == {1, 3, 5, 7, 9} and {r.f for r in one} == {0, 0.25, 0.5, 0.75, 1.0}
    assert search.sample(spark, wide, 200, 4).orderBy("ord").collect() != one


def test_sent_and_shuffled_bars_agree(spark, sf):
    b = walk_bars(spark, sf).cache()
    sent = search.grid_search(b, SPEC, signals.ema_cross_arrays, "H1").orderBy("ord").collect()
    other = search.run_all(b, search.grid(spark, SPEC), signals.ema_cross_arrays, "H1", sent_bars=0).orderBy("ord").collect()
    assert [r.asDict() for r in other] == [{k: v for k, v in r.asDict().items() if k != "score"} for r in sent]
    few = search.grid_search(b, SPEC, signals.ema_cross_arrays, "H1", max_evaluations=4, min_trades=10_000)
    assert few.count() == 4 and {r.score for r in few.collect()} == {-math.inf}
    assert search.best(few).first().ord == 0
    with pytest.raises(ValueError):
        search.score("luck")


def grid_of(spark, f):
    return spark.createDataFrame([(3 * a + b, a, b, float(f(a, b))) for a in range(3) for b in range(3)], "ord long, a long, b long, score double")


@pytest.mark.parametrize(
    "f, robustness, verdict",
    [(lambda a, b: 10, 1.0, "flat"), (lambda a, b: 10 if a == b == 1 else 1, 0.1, "spike"), (lambda a, b: 10 if a == b == 1 else 5, 0.5, "slope"), (lambda a, b: 1.0 if a == b == 1 else (0.90 if a == 1 else 0.95), 0.925, "flat"), (lambda a, b: -0.9 if a == b == 1 else -1, None, "unscored: the peak isn't positive")],
)
def test_plateaus(spark, f, robustness, verdict):
    r = plateau.plateau(grid_of(spark, f), ["a", "b"]).where("ord = 4").first()
    assert r.n_neighbours == 4 and (r.robustness is None if robustness is None else r.robustness == pytest.approx(robustness)) and r.verdict == verdict


def test_neighbour_counts(spark):
    g = grid_of(spark, lambda a, b: a + b)
    assert {r.ord: r.n_neighbours for r in plateau.plateau(g, ["a", "b"]).collect()} == {0: 2, 1: 3, 2: 2, 3: 3, 4: 4, 5: 3, 6: 2, 7: 3, 8: 2}
    assert plateau.swept_axes(g.withColumn("c", F.lit(1)), ["a", "b", "c"]) == ["a", "b"]
    holes = g.withColumn("score", F.when(F.col("ord") == 1, float("-inf")).otherwise(F.col("score")))
    assert plateau.plateau(holes, ["a", "b"]).where("ord = 4").first().n_neighbours == 3
    assert [r.ord for r in plateau.rank_by_robustness(grid_of(spark, lambda a, b: 10 if a == b == 0 else 5), ["a", "b"], 3).collect()][0] != 0


def test_fold_geometry(spark):
    t = lambda df: [tuple(r) for r in df.orderBy("fold").collect()]
    assert t(folds.rolling_folds(spark, 100, 40, 20, embargo=5)) == [(0, 0, 40, 45, 65), (1, 20, 60, 65, 85)]
    assert t(folds.anchored_folds(spark, 100, 40, 20)) == [(0, 0, 40, 40, 60), (1, 0, 60, 60, 80), (2, 0, 80, 80, 100)]
    assert folds.rolling_folds(spark, 10, 40, 20).count() == 0
    k = folds.purged_kfold(spark, 1000, 5)
    assert [(r.test_start, r.test_end) for r in k.orderBy("fold").collect()] == [(i * 200, i * 200 + 200) for i in range(5)]
    kept = k.crossJoin(spark.range(1000).withColumnRenamed("id", "i")).where(folds.train_mask(F.col("i"), F.lit(1000), 30, 10))
    assert {r.fold: r["count"] for r in kept.groupBy("fold").count().collect()} == {0: 790, 1: 760, 2: 760, 3: 760, 4: 770}


def test_purge_and_attribution(spark):
    t = spark.createDataFrame([(0, 40), (10, 51), (20, 25), (30, 33), (40, 44)], "entry_i long, exit_i long")
    assert folds.purge_width(t).first().purge >= 40 and folds.purge_width(t.limit(0)).first().purge == 0
    e = spark.createDataFrame([(5, 300), (95, 120), (150, 400), (290, 295)], "entry_i long, exit_i long")
    f = spark.createDataFrame([(0, 100, 200)], "fold int, test_start long, test_end long")
    assert [r.entry_i for r in folds.attribute(e, f).collect()] == [150]


def test_walk_forward_is_a_loop_of_searches(spark, sf):
    b = walk_bars(spark, sf).cache()
    held = b.orderBy("i").toPandas()
    from barograph.operators.fills import simulate
    from barograph.operators.metrics import metrics_of

    def one(a, z, p):
        x = signals.arrays_of(held.iloc[a:z])
        m = metrics_of(simulate(x, signals.ema_cross_arrays(x, p)), "H1")
        return m["net_profit"] / m["max_drawdown"] if m["max_drawdown"] > 0 else -math.inf

    got = {r.fold: r for r in folds.walk_forward(b, folds.rolling_folds(spark, len(held), 200, 80), SPEC, signals.ema_cross_arrays, "H1").collect()}
    assert got
    configs = [{"fast": f, "slow": s} | FIXED for f in (5, 10, 15) for s in (20, 30, 40)]
    for r in got.values():
        scores = [one(r.train_start, r.train_end, p) for p in configs]
        assert r.ord == int(np.argmax(scores)) and r.train_score == pytest.approx(max(scores))
        assert r.test_score == pytest.approx(one(r.test_start, r.test_end, configs[r.ord]))


@pytest.mark.parametrize("efficiency, positive, verdict", [(0.6, 9, "generalized"), (0.3, 9, "consistent but decayed"), (0.45, 7, "partial"), (-0.1, 7, "did not generalize"), (0.3, 6, "weak"), (float("nan"), 9, "no verdict")])
def test_walk_forward_verdicts(spark, efficiency, positive, verdict):
    from barograph.functions.columns import walk_forward_verdict

    assert spark.range(1).select(walk_forward_verdict(F.lit(efficiency), F.lit(positive), F.lit(10)).alias("v")).first().v == verdict


def test_control_keeps_returns_and_times(spark, sf):
    b = walk_bars(spark, sf).cache()
    s = control.shuffled_bars(b, 2, 1).cache()
    closes = {t: s.where(F.col("trial") == t).orderBy("i").toPandas()["close"].to_numpy() for t in (0, 1)}
    real = b.orderBy("i").toPandas()["close"].to_numpy()
    for c in closes.values():
        assert np.allclose(np.sort(np.diff(np.log(c))), np.sort(np.diff(np.log(real)))) and c[0] == pytest.approx(real[0]) and not np.allclose(c, real)
    assert not np.allclose(closes[0], closes[1])
    out = control.control_test(control.control_runs(b, signals.ema_cross_arrays, CROSS, "H1", 3)).first()
    assert out.passed == (out.real_expectancy_r > out.control_max_expectancy_r)


def test_charts():
    assert charts.window_range(100, 30, 10) == (60, 90) and charts.window_range(100, 30, 200) == (0, 30) and charts.window_range(10, 30) == (0, 10)
