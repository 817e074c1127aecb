"""Bars from ticks, coarser bars from finer ones, and positions in a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.functions.columns import bucket
from barograph.functions.timeframes import DAY, assert_serves, timeframe_ms
from barograph.operators.ordered import BLOCK, scan

BARS = "symbol string, ms long, open double, high double, low double, close double, volume long, spread double, spread_max double"


def bars_from_ticks(ticks: DataFrame, tf: str) -> DataFrame:
    """One bar for each width that has ticks: OHLC of the bid, tick count, mean and largest spread.

    ``ticks``: symbol, seq, ms, bid, ask. Of equal times the smaller seq is earlier. Late ticks find their bar,
    since bars are groups and not runs. One shuffle, after partial aggregation.
    """
    at, spread = F.struct("ms", "seq"), F.col("ask") - F.col("bid")
    return (
        ticks.groupBy("symbol", bucket(F.col("ms"), tf).alias("bar_ms"))
        .agg(
            F.min_by("bid", at).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", at).alias("close"),
            F.count("*").alias("volume"), F.avg(spread).alias("spread"), F.max(spread).alias("spread_max"),
        )
        .withColumnRenamed("bar_ms", "ms")
    )


def roll_up(bars: DataFrame, to: str, origin: str | None = None) -> DataFrame:
    """Bars of ``to`` from finer ones; a finer target raises. Spreads are weighted by volume, 0 where there is none.

    ``origin``: the width of ``bars``, if it is to be checked; the same width passes through.
    """
    if origin is not None:
        assert_serves(timeframe_ms(origin), to)
        if timeframe_ms(origin) == timeframe_ms(to):
            return bars
    weighted = F.coalesce(F.try_divide(F.sum(F.col("spread") * F.col("volume")), F.sum("volume")), F.lit(0.0))
    return (
        bars.groupBy("symbol", bucket(F.col("ms"), to).alias("bar_ms"))
        .agg(
            F.min_by("open", "ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ms").alias("close"),
            F.sum("volume").alias("volume"), weighted.alias("spread"), F.max("spread_max").alias("spread_max"),
        )
        .withColumnRenamed("bar_ms", "ms")
    )


def build_bars(data: DataFrame, tf: str, resolution_ms: int = 0) -> DataFrame:
    """Bars of ``tf`` from ticks (resolution 0) or from bars that are at least as fine.

    Bars without volume or spread get zeros; the largest spread of a bar is its spread.
    """
    if not resolution_ms:
        return bars_from_ticks(data, tf)
    assert_serves(resolution_ms, tf)
    have = set(data.columns)
    full = data.withColumns({c: F.lit(0).cast(t) for c, t in (("volume", "long"), ("spread", "double")) if c not in have})
    if "spread_max" not in have:
        full = full.withColumn("spread_max", F.col("spread"))
    full = full.select(*[x.split()[0] for x in BARS.split(", ")])
    return full if timeframe_ms(tf) == resolution_ms else roll_up(full, tf)


def with_index(bars: DataFrame, width: int = 32 * DAY) -> DataFrame:
    """``i``: 0, 1, ... in time order within a symbol. Rows are counted by blocks of ``width``, which are added up."""
    return scan(bars, ["symbol"], ["ms"], width, {"i": ("sum", F.lit(1).cast("long"), False)}, levels=1).drop(BLOCK)


def slice_bars(bars: DataFrame, start: int, stop: int) -> DataFrame:
    """The bars at positions [start, stop), counted from 0 again."""
    return bars.where((F.col("i") >= start) & (F.col("i") < stop)).withColumn("i", F.col("i") - start)


def align_subbars(bars: DataFrame, sub: DataFrame, bar_ms: int) -> DataFrame:
    """Finer bars (sub: symbol, ms, ...) with the position of the bar whose time [ms, ms + bar_ms) holds them.

    Bars may begin anywhere. An equality on the width's grid stands in for the range, so that this is a hash or
    merge join: a bar is listed under its own grid cell and the next one.
    """
    cell = lambda ms: F.floor(ms / F.lit(bar_ms))
    listed = bars.select("symbol", "i", F.col("ms").alias("bar_start"), F.explode(F.array(cell(F.col("ms")), cell(F.col("ms")) + 1)).alias("_cell"))
    keyed = sub.withColumn("_cell", cell(F.col("ms")))
    inside = (F.col("ms") >= F.col("bar_start")) & (F.col("ms") < F.col("bar_start") + bar_ms)
    return keyed.drop("i").join(listed, ["symbol", "_cell"]).where(inside).drop("_cell")
