"""The fill simulator: signals become trades and an equity curve, one position at a time.

The exit of an entry depends on prices only; cash decides the size alone. So the kernel jumps from entry to exit: it
searches the next touch of stop or target in growing blocks of bars, and looks at no bar in between.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.instrument import END, STOP, TARGET, Instrument

TRADES = "k long, entry_i long, exit_i long, direction int, entry_px double, exit_px double, lots double, pnl double, r_multiple double, exit_reason int"
COUNTERS = ("ambiguous", "resolved", "rej_stops", "rej_zero")


@dataclass
class Result:
    trades: pd.DataFrame
    equity: np.ndarray
    counters: dict[str, int]


def _first_touch(low: np.ndarray, high: np.ndarray, start: int, down: float, up: float) -> int:
    """The first bar from ``start`` on with low <= down or high >= up; the number of bars if there is none."""
    n, step = len(low), 32
    while start < n:
        hit = (low[start : start + step] <= down) | (high[start : start + step] >= up)
        at = int(hit.argmax())
        if hit[at]:
            return start + at
        start, step = start + step, min(step * 4, 1 << 16)
    return n


def simulate(bars: Any, signals: dict[str, np.ndarray], instrument: Instrument = Instrument(), capital: float = 10_000.0, risk_pct: float = 0.01, sub: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None) -> Result:
    """Trades and equity of one series. ``sub``: first and end position of each bar's finer bars, and their lows and highs.

    A signal is acted on at the next bar's open, long before short. Exits are tested from the bar after the entry and
    fill at the level itself; a bar that spans both is settled by its finer bars, and otherwise is a stop and
    counted as ambiguous. A position that ends on a bar may be followed by another one on the same bar. What is
    still open at the end is closed at the last close.
    """
    n, vpu, fee = len(bars.close), instrument.value_per_unit, instrument.commission
    low, high, close = bars.low, bars.high, bars.close
    spread = getattr(bars, "spread", None)
    spread = np.full(n, instrument.default_spread) if spread is None else spread
    stops, targets, long_ = signals["stop_distance"], signals["target_distance"], signals["long_entry"]
    with np.errstate(invalid="ignore"):
        ignored = (stops <= 0) | (targets <= 0)
    at = np.flatnonzero((long_ | signals["short_entry"])[:-1] & ~ignored[:-1]) + 1
    count = dict.fromkeys(COUNTERS, 0)
    cash, equity, rows, done = capital, np.empty(n), [], 0  # equity is set up to ``done``
    k = 0
    while k < len(at):
        i = int(at[k])
        sd, td, side = float(stops[i - 1]), float(targets[i - 1]), 1 if long_[i - 1] else -1
        if sd < instrument.stops_level or td < instrument.stops_level:
            count["rej_stops"] += 1
            k += 1
            continue
        entry = float(bars.open[i]) + (float(spread[i]) if side > 0 else 0.0)
        per_lot = sd * vpu + fee * 2.0
        raw = cash * risk_pct / per_lot if per_lot > 0 else 0.0
        lots = min(math.floor(raw / instrument.lot_step) * instrument.lot_step, instrument.lot_max)
        if lots < instrument.lot_min:
            count["rej_zero"] += 1
            k += 1
            continue
        stop, target, risked = entry - sd * side, entry + td * side, per_lot * lots
        equity[done:i] = cash
        cash -= fee * lots
        down, up = (stop, target) if side > 0 else (target, stop)
        j = _first_touch(low, high, i + 1, down, up)
        if j < n:
            reason = STOP if (low[j] <= stop if side > 0 else high[j] >= stop) else TARGET
            if low[j] <= down and high[j] >= up:
                first = None
                if sub is not None:
                    a, b = int(sub[0][j]), int(sub[1][j])
                    m = a + _first_touch(sub[2][a:b], sub[3][a:b], 0, down, up)
                    if m < b and not (sub[2][m] <= down and sub[3][m] >= up):
                        first = STOP if (sub[2][m] <= stop if side > 0 else sub[3][m] >= stop) else TARGET
                count["ambiguous" if first is None else "resolved"] += 1
                reason = first or STOP
            px, held = (stop if reason == STOP else target), j
        else:
            j, reason, px, held = n - 1, END, float(close[n - 1]), n - 1
        equity[i:held] = cash + (close[i:held] - entry) * side * vpu * lots
        gross = (px - entry) * side * vpu * lots
        cash += gross - fee * lots
        net = gross - fee * lots * 2.0
        rows.append((len(rows), i, j, side, entry, px, lots, net, net / risked if risked > 0 else 0.0, reason))
        done = held
        if reason == END:
            break
        k = int(np.searchsorted(at, j))
    equity[done:] = cash
    return Result(pd.DataFrame(rows, columns=[x.split()[0] for x in TRADES.split(", ")]), equity, count)


def sub_ranges(ms: np.ndarray, sub_ms: np.ndarray, bar_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges of finer bars inside [ms, ms + bar_ms) of each bar."""
    if bar_ms <= 0:
        raise ValueError("finer bars need the width of the coarse ones")
    return np.searchsorted(sub_ms, ms, "left"), np.searchsorted(sub_ms, ms + bar_ms, "left")


def backtest(signals: DataFrame, instrument: Instrument = Instrument(), capital: float = 10_000.0, risk_pct: float = 0.01, sub: DataFrame | None = None, bar_ms: int = 0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Runs of all series: rows of kind trade, equity and counter, by ``keys``.

    ``signals``: keys, i, ms, OHLC, spread and the four signal columns. ``sub``: finer bars (keys, ms, low, high). A
    task holds the bars of one run; runs are spread by their keys. ``trades``, ``equity`` and ``counters`` pick the parts.
    """
    names = list(keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signals.schema.fields if f.name in names) + f", kind string, {TRADES}, i long, ms long, equity double, " + ", ".join(f"{c} long" for c in COUNTERS)
    wanted = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame, finer: pd.DataFrame | None) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        bars = SimpleNamespace(**{c: pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "spread") if c in pdf})
        given = {c: pdf[c].to_numpy(bool if c.endswith("entry") else float) for c in ("long_entry", "short_entry", "stop_distance", "target_distance")}
        parts = None
        if finer is not None and len(finer):
            finer = finer.sort_values("ms")
            parts = (*sub_ranges(pdf["ms"].to_numpy(), finer["ms"].to_numpy(), bar_ms), finer["low"].to_numpy(float), finer["high"].to_numpy(float))
        out = simulate(bars, given, instrument, capital, risk_pct, parts)
        rows = pd.concat([out.trades.assign(kind="trade"), pd.DataFrame({"kind": "equity", "i": pdf["i"].to_numpy(), "ms": pdf["ms"].to_numpy(), "equity": out.equity}), pd.DataFrame([{"kind": "counter", **out.counters}])])
        return rows.assign(**{c: pdf[c].iloc[0] for c in names}).reindex(columns=wanted)

    need = [*names, "i", "ms", "open", "high", "low", "close", *(["spread"] if "spread" in signals.columns else []), "long_entry", "short_entry", "stop_distance", "target_distance"]
    groups = signals.select(*need).groupBy(*names)
    if sub is None:
        return groups.applyInPandas(lambda pdf: run(pdf, None), schema)
    return groups.cogroup(sub.select(*names, "ms", "low", "high").groupBy(*names)).applyInPandas(lambda a, b: run(a, b) if len(a) else pd.DataFrame(columns=wanted), schema)


def trades(run: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return run.where("kind = 'trade'").select(*keys, *[x.split()[0] for x in TRADES.split(", ")])


def equity(run: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return run.where("kind = 'equity'").select(*keys, "i", "ms", "equity")


def counters(run: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return run.where("kind = 'counter'").select(*keys, *COUNTERS)


def first_touch(bars: DataFrame, entries: DataFrame, block: int = 64) -> DataFrame:
    """The first bar after each entry that touches its stop or target, by equality joins only.

    ``entries``: symbol, entry_i, direction, stop, target (prices); returns them with exit_i (null if nothing is
    touched). Blocks of bars, of blocks and so on are known by their extremes. An entry climbs: it is held against what
    follows it in its own block, then against the blocks that follow in the block above, until one reaches a level; from
    there the search goes down again. So an entry meets ``block`` rows a step, and steps grow with the logarithm of the series.
    """
    down = F.when(F.col("direction") > 0, F.col("stop")).otherwise(F.col("target"))
    up = F.when(F.col("direction") > 0, F.col("target")).otherwise(F.col("stop"))
    hit = (F.col("low") <= F.col("_down")) | (F.col("high") >= F.col("_up"))
    key = ["symbol", "entry_i", "direction", "stop", "target"]
    open_ = entries.select(*key, F.col("entry_i").cast("long").alias("_at"), down.alias("_down"), up.alias("_up")).distinct()
    last = bars.agg(F.max("i")).first()[0] or 0
    levels = [bars.select("symbol", F.col("i").cast("long").alias("at"), "low", "high")]
    while last >= block:
        last //= block
        levels.append(levels[-1].groupBy("symbol", F.floor(F.col("at") / block).alias("up")).agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumnRenamed("up", "at"))
    inside = lambda rows: rows.withColumn("_in", F.floor(F.col("at") / block))
    first = lambda met: met.where(hit).groupBy(*key, "_down", "_up").agg(F.min("at").alias("_at"))
    found = []
    for level in levels:
        met = open_.withColumn("_in", F.floor(F.col("_at") / block)).join(inside(level), ["symbol", "_in"]).where(F.col("at") > F.col("_at"))
        found.append(first(met))
        open_ = open_.join(found[-1].select(*key), key, "left_anti").withColumn("_at", F.floor(F.col("_at") / block))
    at = found.pop()
    for level in reversed(levels[:-1]):
        below = first(at.withColumnRenamed("_at", "_in").join(inside(level), ["symbol", "_in"]))
        at = below.unionByName(found.pop())
    return entries.join(at.select(*key, F.col("_at").alias("exit_i")), key, "left")


def equity_of(bars: DataFrame, done: DataFrame, instrument: Instrument = Instrument(), capital: float = 10_000.0) -> DataFrame:
    """The equity curve that a trade list implies, by joins and windows: realised money and what is open, marked to the close."""
    vpu, fee = instrument.value_per_unit, instrument.commission
    gross = (F.col("exit_px") - F.col("entry_px")) * F.col("direction") * vpu * F.col("lots")
    paid = done.select("symbol", F.col("entry_i").alias("i"), (-F.lit(fee) * F.col("lots")).alias("d")).unionByName(done.select("symbol", F.col("exit_i").alias("i"), (gross - fee * F.col("lots")).alias("d"))).groupBy("symbol", "i").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = done.select("symbol", F.col("entry_i").alias("i"), F.struct("entry_i", "exit_i", "entry_px", "direction", "lots").alias("_t"))
    last = t.groupBy("symbol", "i").agg(F.max("_t").alias("_t"))
    b = bars.select("symbol", "i", "ms", "close").join(paid, ["symbol", "i"], "left").join(last, ["symbol", "i"], "left")
    b = b.withColumns({"cash": F.lit(capital) + F.coalesce(F.sum("d").over(w), F.lit(0.0)), "_o": F.last("_t", ignorenulls=True).over(w)})
    open_ = F.when(F.col("i") < F.col("_o.exit_i"), (F.col("close") - F.col("_o.entry_px")) * F.col("_o.direction") * vpu * F.col("_o.lots"))
    return b.select("symbol", "i", "ms", (F.col("cash") + F.coalesce(open_, F.lit(0.0))).alias("equity"))

