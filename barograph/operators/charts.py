"""What a chart shows of a run: a window of bars, its trades as markers, a thinned equity curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.instrument import REASONS


def window_range(n_bars: int, limit: int, offset: int = 0) -> tuple[int, int]:
    """[start, end) of ``limit`` bars that end ``offset`` before the last; the first bars if that is before them all."""
    end = max(0, n_bars - offset)
    start = max(0, end - limit)
    return (start, end) if end > start else (0, min(limit, n_bars))


def chart_window(bars: DataFrame, start: int, end: int) -> DataFrame:
    return bars.where((F.col("i") >= start) & (F.col("i") < end))


def trades_in(trades: DataFrame, start: int, end: int, most: int | None = None) -> DataFrame:
    """Trades entered or left within the window; every so manieth if there are more than ``most``."""
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    found = trades.where(inside("entry_i") | inside("exit_i"))
    if most is None:
        return found
    w = Window.partitionBy("symbol")
    numbered = found.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy("k")) - 1})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return numbered.where((F.pmod(F.col("_k"), step) == 0) & (F.col("_k") < step * most)).drop("_n", "_k")


def markers(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Two rows a trade, entry and exit, in time order, with a label."""
    t = bars.select("symbol", "i", "ms")
    at = lambda c: trades.join(t, (trades["symbol"] == t["symbol"]) & (trades[c] == t["i"])).drop(t["symbol"])
    label = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("exit_reason"))
    enter = at("entry_i").select("symbol", "k", "ms", F.lit("entry").alias("kind"), F.col("entry_px").alias("price"), F.when(F.col("direction") > 0, "long").otherwise("short").alias("label"))
    leave = at("exit_i").select("symbol", "k", "ms", F.lit("exit").alias("kind"), F.col("exit_px").alias("price"), label.alias("label"))
    return enter.unionByName(leave).orderBy("symbol", "ms", "kind", "k")


def thin_equity(equity: DataFrame, start: int, end: int, points: int = 2000) -> DataFrame:
    step = max(1, (end - start) // points)
    return equity.where((F.col("i") >= start) & (F.col("i") < end) & (F.pmod(F.col("i") - start, F.lit(step)) == 0))
