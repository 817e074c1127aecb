import math
from types import SimpleNamespace

import numpy as np
import pytest

from barograph.functions.instrument import END, STOP, TARGET, Instrument
from barograph.operators import fills as Fl
from barograph.operators.metrics import METRICS, metrics, metrics_of

IT = Instrument(tick_size=0.001, tick_value=0.10, commission=3.5, default_spread=0.0)


def flat(n, **at):
    b = SimpleNamespace(**{c: np.full(n, 1900.0) for c in ("open", "high", "low", "close")})
    for k, v in at.items():
        c, i = k.rsplit("_", 1)
        getattr(b, c)[int(i)] = v
    return b


def want(n, side=1, at=0, stop=10.0, target=20.0):
    s = {"long_entry": np.zeros(n, bool), "short_entry": np.zeros(n, bool), "stop_distance": np.full(n, stop), "target_distance": np.full(n, target)}
    s["long_entry" if side > 0 else "short_entry"][at] = True
    return s


def test_worked_examples():
    t = Fl.simulate(flat(5, high_3=1925.0), want(5), IT).trades.iloc[0]
    assert (t.entry_i, t.exit_i, t.exit_px, round(t.lots, 2), round(t.pnl, 2), t.exit_reason) == (1, 3, 1920, 0.09, 179.37, TARGET)
    t = Fl.simulate(flat(5, high_3=1912.0), want(5, -1), IT).trades.iloc[0]
    assert (t.exit_px, round(t.pnl, 2), t.exit_reason) == (1910, -90.63, STOP)
    assert Fl.simulate(flat(5), want(5), Instrument(default_spread=0.5)).trades.iloc[0].entry_px == 1900.5
    assert Fl.simulate(flat(5), want(5, at=2), IT).trades.iloc[0].entry_i == 3
    t = Fl.simulate(flat(5, high_1=1990.0, low_1=1800.0), want(5), IT).trades.iloc[0]
    assert (t.exit_i, t.exit_reason) == (4, END)
    r = Fl.simulate(flat(5, high_3=1990.0, low_3=1800.0), want(5), IT)
    assert r.trades.iloc[0].exit_reason == STOP and r.counters["ambiguous"] == 1


def test_rejections():
    assert Fl.simulate(flat(5), want(5, stop=1.0), Instrument(stops_level=5.0)).counters["rej_stops"] == 1
    assert Fl.simulate(flat(5), want(5, stop=500.0), IT, 100.0, 0.001).counters["rej_zero"] == 1
    nan = Fl.simulate(flat(5), want(5, stop=math.nan), IT)
    assert nan.counters["rej_zero"] == 1 and nan.trades.empty
    assert len(Fl.simulate(flat(5), want(5, target=math.nan), IT).trades) == 1
    assert Fl.simulate(flat(5), want(5, stop=0.0), IT).counters == dict.fromkeys(Fl.COUNTERS, 0)
    assert set(metrics_of(Fl.simulate(flat(5), want(5, stop=-1.0), IT), "H1").values()) == {0}


@pytest.mark.parametrize(
    "sub, reason, counted",
    [
        ([(0, 100.2, 100), (15, 101.5, 100), (30, 101.5, 98)], TARGET, "resolved"),
        ([(0, 100.2, 100), (15, 100.1, 98), (30, 101.5, 98)], STOP, "resolved"),
        ([(0, 101.5, 98)], STOP, "ambiguous"),
        ([], STOP, "ambiguous"),
    ],
)
def test_finer_bars_settle(sub, reason, counted):
    b = SimpleNamespace(open=np.full(4, 100.0), close=np.full(4, 100.0), high=np.array([100, 100, 102, 100.0]), low=np.array([100, 100, 98, 100.0]))
    ms = np.arange(4) * 60_000
    sub_ms = np.array([120_000 + s * 1000 for s, _, _ in sub], np.int64)
    parts = (*Fl.sub_ranges(ms, sub_ms, 60_000), np.array([x for _, _, x in sub], float), np.array([x for _, x, _ in sub], float))
    r = Fl.simulate(b, want(4, stop=1.0, target=1.0), Instrument(commission=0, default_spread=0), sub=parts)
    assert r.trades.iloc[0].exit_reason == reason and r.counters[counted] == 1
    with pytest.raises(ValueError):
        Fl.sub_ranges(ms, sub_ms, 0)


def plain_loop(b, s, it, capital, risk):
    """One bar at a time, as the rules are stated."""
    cash, pos, rows, eq, vpu = capital, None, [], [], it.value_per_unit
    count = dict.fromkeys(Fl.COUNTERS, 0)
    n = len(b.close)

    def leave(i, px, why):
        nonlocal cash, pos
        side, e, e_px, _, _, lots, risked = pos
        gross = (px - e_px) * side * vpu * lots
        cash += gross - it.commission * lots
        net = gross - 2 * it.commission * lots
        rows.append((e, i, side, e_px, px, lots, net, net / risked if risked > 0 else 0, why))
        pos = None

    for i in range(n):
        if pos and i > pos[1]:
            side, _, _, sl, tp, _, _ = pos
            hit_s = b.low[i] <= sl if side > 0 else b.high[i] >= sl
            hit_t = b.high[i] >= tp if side > 0 else b.low[i] <= tp
            if hit_s and hit_t:
                count["ambiguous"] += 1
            if hit_s or hit_t:
                leave(i, sl if hit_s else tp, STOP if hit_s else TARGET)
        if pos is None and i and (s["long_entry"][i - 1] or s["short_entry"][i - 1]):
            side, sd, td = (1 if s["long_entry"][i - 1] else -1), s["stop_distance"][i - 1], s["target_distance"][i - 1]
            if sd <= 0 or td <= 0:
                pass
            elif sd < it.stops_level or td < it.stops_level:
                count["rej_stops"] += 1
            else:
                per = sd * vpu + 2 * it.commission
                lots = min(math.floor(cash * risk / per / it.lot_step) * it.lot_step, it.lot_max) if per > 0 else 0.0
                if lots < it.lot_min:
                    count["rej_zero"] += 1
                else:
                    px = b.open[i] + (b.spread[i] if side > 0 else 0)
                    pos = (side, i, px, px - sd * side, px + td * side, lots, per * lots)
                    cash -= it.commission * lots
        eq.append(cash + ((b.close[i] - pos[2]) * pos[0] * vpu * pos[5] if pos else 0))
    if pos:
        leave(n - 1, b.close[-1], END)
        eq[-1] = cash
    return rows, eq, count


@pytest.mark.parametrize("seed", range(20))
def test_kernel_is_the_plain_loop(seed):
    r = np.random.default_rng(seed)
    n = 400
    close = 1900 + np.cumsum(r.normal(0, 1, n))
    open_ = np.concatenate(([close[0]], close[:-1]))
    b = SimpleNamespace(open=open_, close=close, high=np.maximum(open_, close) + r.exponential(0.6, n), low=np.minimum(open_, close) - r.exponential(0.6, n), spread=r.uniform(0, 0.5, n))
    s = {"long_entry": r.random(n) < 0.06, "short_entry": r.random(n) < 0.06, "stop_distance": r.uniform(-0.1, 6, n), "target_distance": r.uniform(-0.1, 6, n)}
    it = Instrument(stops_level=0.5 if seed % 2 else 0.0)
    capital = 10_000 if seed % 3 else 40
    got, (rows, eq, count) = Fl.simulate(b, s, it, capital, 0.01), plain_loop(b, s, it, capital, 0.01)
    assert [tuple(x)[1:] for x in got.trades.itertuples(index=False)] == [pytest.approx(x, rel=1e-9) for x in rows]
    assert got.equity.tolist() == pytest.approx(eq, rel=1e-12) and got.counters == count
    t = got.trades.astype(float)
    assert abs(got.equity[-1] - capital - t["pnl"].sum()) < 1e-6
    assert np.allclose(t["lots"] / it.lot_step, np.rint(t["lots"] / it.lot_step)) and (t["entry_i"].to_numpy()[1:] >= t["exit_i"].to_numpy()[:-1]).all()


def test_frames_say_the_same(spark, sf):
    from barograph.plans.queries import CROSS, walk_bars
    from barograph.operators.signals import arrays_of, ema_cross, ema_cross_arrays

    b = walk_bars(spark, sf).cache()
    run = Fl.backtest(ema_cross(b, CROSS)).cache()
    trades, equity = Fl.trades(run), Fl.equity(run)
    held = arrays_of(b.orderBy("i").toPandas())
    one = Fl.simulate(held, ema_cross_arrays(held, CROSS))
    assert len(one.trades) == trades.count() and len(one.trades) > 5
    m, row = metrics_of(one, "H1"), metrics(trades, equity, "H1").first()
    assert [row[c] for c in METRICS] == pytest.approx([m[c] for c in METRICS], rel=1e-9)
    none = metrics(trades.limit(0), equity, "H1").first()
    assert [none[c] for c in METRICS] == [0] * 16
    again = Fl.equity_of(b, trades).join(equity.withColumnRenamed("equity", "e"), ["symbol", "i"]).selectExpr("max(abs(equity - e)) d").first().d
    assert again < 1e-6


def test_first_touch_climbs_any_number_of_blocks(spark):
    draw = np.random.default_rng(5)
    close = 100 + np.cumsum(draw.normal(0, 1, 300))
    rows = [("X", i, float(c - 0.5), float(c + 0.5)) for i, c in enumerate(close)] + [("Y", i, 1.0, 2.0) for i in range(7)]
    bars = spark.createDataFrame(rows, "symbol string, i long, low double, high double")
    asked = [("X", i, d, float(close[i] - d * w), float(close[i] + d * w)) for i in range(0, 300, 3) for d, w in ((1, 1.0), (-1, 4.0), (1, 40.0))] + [("Y", 2, 1, 0.5, 3.0), ("Z", 0, 1, 0.0, 1.0)]
    want = {}
    for s, i, d, stop, target in asked:
        down, up = (stop, target) if d > 0 else (target, stop)
        want[s, i, d, stop, target] = next((k for t, k, low, high in rows if t == s and k > i and (low <= down or high >= up)), None)
    entries = spark.createDataFrame(asked, "symbol string, entry_i long, direction int, stop double, target double")
    for block in (3, 64):
        got = {tuple(r)[:5]: r.exit_i for r in Fl.first_touch(bars, entries, block).collect()}
        assert got == want
    assert None in want.values() and len(set(want.values())) > 50
