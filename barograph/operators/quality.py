"""What a source's rows say about it: counts, spreads, gaps, resolution, clock.

Series are scanned by blocks of time and of source order (see ``ordered``), so that one long symbol is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.timeframes import DAY, HOUR
from barograph.operators.ordered import BLOCK, largest, most_frequent, percentiles, same, scan

#: UTC hour at which the market opens on Sunday (fixed value).
SUNDAY_OPEN = 22
#: Places of a source that make a block.
SEQ_BLOCK = 1 << 18


def ordered(rows: DataFrame, width: int = HOUR) -> DataFrame:
    """gap: milliseconds since the row before in time order. The rows come with their block of time."""
    order = ["ms", "seq"] if "seq" in rows.columns else ["ms"]
    found = scan(rows, ["symbol"], order, width, {"gap": ("last", F.col("ms"), False)}, levels=1)
    return found.withColumn("gap", F.col("ms") - F.col("gap"))


def backward_steps(rows: DataFrame) -> DataFrame:
    """symbol and n, how many rows are earlier than the one before in source order; none for rows without seq, which are in time order."""
    if "seq" not in rows.columns:
        return rows.select("symbol").distinct().withColumn("n", F.lit(0).cast("long"))
    found = scan(rows.select("symbol", "seq", "ms"), ["symbol"], ["seq"], SEQ_BLOCK, {"before": ("last", F.col("ms"), False)}, levels=1)
    return found.groupBy("symbol").agg(F.count_if(F.col("ms") < F.col("before")).alias("n"))


def longest_run(rows: DataFrame, flag: Column, keys: list[str], order: list[str], width: int | None = None) -> DataFrame:
    """Per key the most neighbouring rows for which ``flag`` holds: n, 0 if there are none.

    With ``width``, that much of the first order column is a block of a scan; without, a key's rows are lined up in one task.
    """
    breaks = F.when(flag, 0).otherwise(1)
    if width is None:
        islands = rows.withColumn("_island", F.sum(breaks).over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        islands = scan(rows, keys, order, width, {"_island": ("sum", breaks, True)})
    return islands.groupBy(*keys, "_island").agg(F.count_if(flag).alias("n")).groupBy(*keys).agg(F.max("n").alias("n"))


def repeats(rows: DataFrame) -> DataFrame:
    """symbol and n, how many rows follow one of the same time without a break at most. Times are counted, not lined up."""
    return rows.groupBy("symbol", "ms").agg((F.count("*") - 1).alias("n")).groupBy("symbol").agg(F.max("n").alias("n"))


def quality_report(ticks: DataFrame) -> DataFrame:
    """One row a symbol. ``ticks``: symbol, seq, ms, bid, ask; or with close (and spread) instead of bid and ask.

    Bars have one price, their close: it is counted for either side, and no spread of theirs is zero or
    negative. Percentiles are exact, with linear interpolation.
    """
    quoted = "bid" in ticks.columns
    low, high = (F.col("bid"), F.col("ask")) if quoted else (F.col("close"), F.col("close"))
    spread = high - low if quoted else F.col("spread") if "spread" in ticks.columns else F.lit(None).cast("double")
    rows = ordered(ticks)
    top = lambda lists: F.slice(F.sort_array(lists, asc=False), 1, 5).alias("largest_gaps_ms")
    adds = ("rows", "duplicate_timestamps", "negative_spread", "zero_spread", "bad_price", "_spreads", "_spread")
    blocks = rows.groupBy("symbol", BLOCK).agg(
        F.count("*").alias("rows"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
        F.count_if(F.col("gap") == 0).alias("duplicate_timestamps"),
        F.count_if(high < low).alias("negative_spread"), (F.count_if(high == low) if quoted else F.lit(0).cast("long")).alias("zero_spread"),
        (F.count_if(low <= 0) + F.count_if(high <= 0)).alias("bad_price"), F.count(spread).alias("_spreads"), F.sum(spread).alias("_spread"), top(F.collect_list("gap")),
    )
    whole = blocks.groupBy("symbol").agg(*(F.sum(c).alias(c) for c in adds), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), top(F.flatten(F.collect_list("largest_gaps_ms"))))
    shares = percentiles(ticks, ["symbol"], spread, {"spread_p50": 0.5, "spread_p99": 0.99})
    counts = same(repeats(ticks).withColumnRenamed("n", "max_duplicate_run"), backward_steps(ticks).withColumnRenamed("n", "out_of_order"), ["symbol"])
    out = same(same(whole, counts, ["symbol"]), shares, ["symbol"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "symbol", "rows", "first_ms", "last_ms", "out_of_order", "duplicate_timestamps", "negative_spread", "zero_spread", "bad_price",
        zero(F.try_divide("_spread", "_spreads")).alias("spread_mean"), zero(F.col("spread_p50")).alias("spread_p50"), zero(F.col("spread_p99")).alias("spread_p99"), "max_duplicate_run", "largest_gaps_ms",
    )


def top_gaps(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k longest gaps of each symbol: symbol, rank, gap."""
    return largest(ordered(rows.select("symbol", "ms")), ["symbol"], F.col("gap"), k).select("symbol", F.posexplode("top").alias("rank", "gap")).withColumn("rank", F.col("rank") + 1)


def resolution(rows: DataFrame) -> DataFrame:
    """The most frequent positive gap of each symbol, the smallest of ties; 0 without one."""
    found = most_frequent(ordered(rows.select("symbol", "ms")), ["symbol"], F.when(F.col("gap") > 0, F.col("gap")))
    return same(rows.select("symbol").distinct(), found, ["symbol"], "left").select("symbol", F.coalesce("value", F.lit(0)).alias("resolution_ms"))


def utc_offset(rows: DataFrame, top: int = 12) -> DataFrame:
    """The hours by which a source's clock differs from UTC, told from when its longest gaps end.

    Of the ``top`` longest gaps those over a day count; the median hour at which they end is held
    against Sunday's opening, wrapped to 12 hours and rounded to a quarter. Null without such a gap.
    """
    found = largest(ordered(rows.select("symbol", "ms")), ["symbol"], F.when(F.col("gap").isNotNull(), F.struct("gap", "ms")), top)
    hours = F.array_sort(F.transform(F.filter("top", lambda g: g["gap"] > DAY), lambda g: F.pmod(g["ms"], F.lit(DAY)) / HOUR))
    n = F.size("hours")
    middle = (F.get("hours", F.floor((n - 1) / 2).cast("int")) + F.get("hours", F.floor(n / 2).cast("int"))) / 2
    hour = F.when(n > 0, middle - SUNDAY_OPEN)
    wrapped = F.when(hour > 12, hour - 24).when(hour < -12, hour + 24).otherwise(hour)
    told = found.withColumn("hours", hours).select("symbol", (F.rint(wrapped * 4) / 4).alias("utc_offset_hours"))
    return same(rows.select("symbol").distinct(), told, ["symbol"], "left")


def decimals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Most digits after the last point in any of the text columns: one row, decimals."""
    most = [F.max(F.length(F.regexp_extract(F.col(c).cast("string"), r"\.([^.]*)$", 1))) for c in columns]
    return rows.agg(F.coalesce(F.greatest(*most) if len(most) > 1 else most[0], F.lit(0)).cast("int").alias("decimals"))
