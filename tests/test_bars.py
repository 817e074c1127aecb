import pytest

from barograph.functions.timeframes import TIMEFRAMES, bars_per_year, base_for, serves, served_by, timeframe_ms
from barograph.operators.bars import align_subbars, bars_from_ticks, build_bars, roll_up, slice_bars, with_index
from barograph.sources.ticks import TICKS

SEVEN = list(zip([0, 30000, 45000, 59999, 60000, 90000, 300000], [1900, 1901.5, 1899, 1900.5, 1902, 1903, 1890], [0.3, 0.4, 0.2, 0.2, 0.4, 0.2, 0.5], strict=True))


def ticks(spark, rows=SEVEN, symbol="X"):
    return spark.createDataFrame([(symbol, k, ms, float(b), float(b) + s) for k, (ms, b, s) in enumerate(rows)], TICKS)


def rows(df):
    return [(r.ms, r.open, r.high, r.low, r.close, r.volume, round(r.spread, 9), round(r.spread_max, 9)) for r in df.orderBy("ms").collect()]


def test_seven_ticks(spark):
    m1 = rows(bars_from_ticks(ticks(spark), "M1"))
    assert m1[0] == (0, 1900, 1901.5, 1899, 1900.5, 4, 0.275, 0.4) and [r[0] for r in m1] == [0, 60000, 300000]
    m5 = rows(bars_from_ticks(ticks(spark), "M5"))
    assert len(m5) == 2 and m5[0][5] == 6 and (m5[0][2], m5[0][3]) == (1903, 1899)


def test_order_does_not_matter_but_ties_do(spark):
    a = rows(bars_from_ticks(ticks(spark), "M1"))
    assert rows(bars_from_ticks(ticks(spark).repartition(5, "bid"), "M1")) == a
    tied = [(100, 5, 0.1), (100, 3, 0.1), (100, 4, 0.1)]
    assert rows(bars_from_ticks(ticks(spark, tied), "M1"))[0][1:5] == (5, 5, 3, 4)


def test_times_before_1970_and_ticks_have_no_bars(spark):
    assert rows(bars_from_ticks(ticks(spark, [(-1, 2, 0.1)]), "M1"))[0][0] == -60000
    with pytest.raises(ValueError):
        bars_from_ticks(ticks(spark), "TICK")


@pytest.mark.parametrize("tf", ["M5", "M15", "H1", "H4", "D1"])
def test_roll_up_is_direct(spark, sf, tf):
    from barograph.sources.ticks import ticks_walk

    t = ticks_walk(spark, sf).cache()
    direct, rolled = rows(bars_from_ticks(t, tf)), rows(roll_up(bars_from_ticks(t, "M1"), tf, "M1"))
    assert [r[:6] for r in direct] == [r[:6] for r in rolled]
    assert all(abs(a[6] - b[6]) < 1e-8 for a, b in zip(direct, rolled, strict=True))


def test_spread_is_weighted_and_finer_is_refused(spark):
    cols = "symbol string, ms long, open double, high double, low double, close double, volume long, spread double, spread_max double"
    two = spark.createDataFrame([("X", 0, 1.0, 1.0, 1.0, 1.0, 900, 0.1, 0.1), ("X", 60000, 1.0, 1.0, 1.0, 1.0, 3, 1.0, 1.0)], cols)
    assert rows(roll_up(two, "M5", "M1"))[0][5:] == (903, round((90 + 3) / 903, 9), 1.0)
    assert roll_up(two, "M1", "M1") is two
    with pytest.raises(ValueError):
        roll_up(two, "S30", "M1")
    none = two.drop("volume", "spread", "spread_max")
    assert rows(build_bars(none, "M5", 60000))[0][5:] == (0, 0.0, 0.0)
    with pytest.raises(ValueError):
        build_bars(two, "M1", 3_600_000)


def test_slices_and_alignment(spark):
    b = with_index(bars_from_ticks(ticks(spark), "M1"))
    assert [(r.i, r.ms) for r in slice_bars(b, 1, 3).orderBy("i").collect()] == [(0, 60000), (1, 300000)]
    coarse = spark.createDataFrame([("X", 0, 0), ("X", 1, 60_000), ("X", 2, 120_000)], "symbol string, i long, ms long")
    fine = spark.createDataFrame([("X", s * 1000) for s in (0, 30, 59, 60, 119, 120, 500)], "symbol string, ms long")
    assert sorted((r.i, r.ms) for r in align_subbars(coarse, fine, 60_000).collect()) == [(0, 0), (0, 30000), (0, 59000), (1, 60000), (1, 119000), (2, 120000)]
    odd = spark.createDataFrame([("X", 0, 30_500)], "symbol string, i long, ms long")
    assert sorted(r.ms for r in align_subbars(odd, fine, 60_000).collect()) == [59000, 60000]


def test_names():
    assert len(TIMEFRAMES) == 28 and timeframe_ms(" m15 ") == 900_000
    want = {"M1": 371_520, "M5": 74_304, "M15": 24_768, "M30": 12_384, "H1": 6_192, "H4": 1_548, "D1": 258, "W1": 52}
    assert {k: bars_per_year(k) for k in want} == want
    for bad in ("M7", "", "TICK"):
        with pytest.raises(ValueError):
            bars_per_year(bad)
    assert base_for("H1") == "M1" and base_for("S10") == "S10" and base_for("H1", "m5") == "M5"
    with pytest.raises(ValueError):
        base_for("M5", "H1")
    assert serves(0, "S1") and not serves(3_600_000, "M5") and served_by("D1") == ["D1", "W1"]
