"""Loading a CSV stream: partial bars and summaries a micro-batch, which merge in any order.

A micro-batch is read once, is kept while its partial bars and its summary are made, and is then let go. Both are
written under the batch's number, so that a batch that is run again replaces what it had written.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.functions.columns import bucket
from barograph.operators.ordered import largest
from barograph.operators.quality import backward_steps, ordered
from barograph.sources.csv_source import SourceSpec, first_line, header_of, layout_of, resolve_columns, scale_of, separator_of
from barograph.sources.csv_stream import stream_text
from barograph.sources.shared import shared_path

PARTS = "symbol string, ms long, opened struct<ms:long,seq:long>, open double, high double, low double, closed struct<ms:long,seq:long>, close double, volume long, spread_sum double, spread_max double, digits int"
#: k of the KLL sketches of spreads. Their rank error is about 2.3 / k^0.9 of the rows, a fifth of a percent here.
SKETCH_K = 2048
#: What the rank error of a quantile of a merged sketch stays under, as a share of the rows (with 99 % confidence).
RANK_ERROR = 0.005


def partial_bars(ticks: DataFrame, tf: str) -> DataFrame:
    """Bars of some of the ticks, with all that it takes to merge them: PARTS."""
    at, spread = F.struct("ms", "seq"), F.col("ask") - F.col("bid")
    digits = F.max("digits" if "digits" in ticks.columns else F.lit(None).cast("int")).alias("digits")
    return (
        ticks.groupBy("symbol", bucket(F.col("ms"), tf).alias("bar_ms"))
        .agg(
            F.min(at).alias("opened"), F.min_by("bid", at).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max(at).alias("closed"), F.max_by("bid", at).alias("close"),
            F.count("*").alias("volume"), F.sum(spread).alias("spread_sum"), F.max(spread).alias("spread_max"), digits,
        )
        .withColumnRenamed("bar_ms", "ms")
    )


def merge_bars(parts: DataFrame) -> DataFrame:
    """Bars from partial ones: those of all ticks at once, up to the rounding of mean spreads."""
    return parts.groupBy("symbol", "ms").agg(
        F.min_by("open", "opened").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "closed").alias("close"),
        F.sum("volume").alias("volume"), (F.sum("spread_sum") / F.sum("volume")).alias("spread"), F.max("spread_max").alias("spread_max"),
    )


def late_ticks(parts: DataFrame) -> DataFrame:
    """One row, late: ticks of bars before the last bar of an earlier batch. ``parts`` have the batch's number."""
    ends = parts.groupBy("symbol", "batch").agg(F.max("ms").alias("last"))
    before = ends.withColumn("before", F.max("last").over(Window.partitionBy("symbol").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each batch
    return parts.join(before.select("symbol", "batch", "before"), ["symbol", "batch"]).agg(F.coalesce(F.sum(F.when(F.col("ms") < F.col("before"), F.col("volume"))), F.lit(0)).alias("late"))


def summary(ticks: DataFrame, largest_gaps: int = 5) -> DataFrame:
    """What a batch's ticks say of each symbol, in time order, with the runs at its ends; ``merge_summaries`` puts batches together."""
    spread = F.col("ask") - F.col("bid")
    rows = ordered(ticks)
    counts = rows.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count_if(F.col("gap") == 0).alias("duplicate_timestamps"),
        F.count_if(spread < 0).alias("negative_spread"), F.count_if(spread == 0).alias("zero_spread"), (F.count_if(F.col("bid") <= 0) + F.count_if(F.col("ask") <= 0)).alias("bad_price"),
        F.sum(spread).alias("spread_sum"), F.kll_sketch_agg_double(spread, F.lit(SKETCH_K)).alias("sketch"),
    )
    times = ticks.groupBy("symbol", "ms").agg(F.count("*").alias("n"))
    ends = times.groupBy("symbol").agg(F.min_by("n", "ms").alias("head"), F.max_by("n", "ms").alias("tail"), (F.max("n") - 1).alias("max_duplicate_run"))
    counts = counts.join(backward_steps(ticks).withColumnRenamed("n", "out_of_order"), "symbol")
    return counts.join(ends, "symbol").join(largest(rows, ["symbol"], F.col("gap"), largest_gaps).withColumnRenamed("top", "gaps"), "symbol", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<long>")))


def quantile(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def merge_summaries(batches: DataFrame, largest_gaps: int = 5) -> DataFrame:
    """The quality of a stream, one row a symbol, from the ``summary`` of each batch and its number.

    A batch follows the one before: between them there is a gap, a run of equal times that goes on, or time runs
    backwards, which counts as one tick out of order. If no batch goes back in time, counts and gaps are those of
    ``quality_report`` of all ticks; the mean is, too. Quantiles come from the merged sketches: their ranks are off by
    less than RANK_ERROR of the rows.
    """
    w = Window.partitionBy("symbol").orderBy("batch")  # a row for each batch
    joined = batches.withColumn("seam", F.col("first_ms") - F.lag("last_ms").over(w))
    goes_on = F.coalesce(F.col("seam") == 0, F.lit(False))
    # a run that goes on through batches of one time: from the tail of the batch where it begins
    through = goes_on & (F.col("head") == F.col("rows"))
    joined = joined.withColumn("island", F.sum(F.when(through, 0).otherwise(1)).over(w))
    joined = joined.withColumn("reach", F.sum("tail").over(Window.partitionBy("symbol", "island").orderBy("batch")))
    joined = joined.withColumn("before", F.lag("reach").over(w))
    seam_run = F.when(goes_on, F.col("before") + F.col("head") - 1).otherwise(0)
    gaps = F.concat("gaps", F.when(F.col("seam") >= 0, F.array("seam")).otherwise(F.array().cast("array<long>")))
    totals = joined.groupBy("symbol").agg(
        F.sum("rows").alias("rows"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
        (F.sum("out_of_order") + F.count_if(F.col("seam") < 0)).alias("out_of_order"), (F.sum("duplicate_timestamps") + F.count_if(F.col("seam") == 0)).alias("duplicate_timestamps"),
        *(F.sum(c).alias(c) for c in ("negative_spread", "zero_spread", "bad_price")), (F.sum("spread_sum") / F.sum("rows")).alias("spread_mean"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"), F.max(F.greatest("max_duplicate_run", seam_run)).alias("max_duplicate_run"),
        F.slice(F.sort_array(F.flatten(F.collect_list(gaps)), asc=False), 1, largest_gaps).alias("largest_gaps_ms"),
    )
    return totals.withColumns({"spread_p50": quantile(F.col("sketch"), 0.5), "spread_p99": quantile(F.col("sketch"), 0.99)}).drop("sketch")


@dataclass(frozen=True)
class Streamed:
    """What a streamed load has made: bars, quality by symbol (if asked for), number of late ticks, digits after the point, and batches."""

    bars: DataFrame
    quality: DataFrame | None
    late_rows: int
    decimals: int
    batches: int


def typed_stream(spark: SparkSession, path: str, spec: SourceSpec, symbol: str, range_bytes: int, batch_ranges: int, batches: int = 0) -> DataFrame:
    """The ticks of a CSV stream (symbol, seq, ms, bid, ask) and ``digits``, the most that a row's prices have after the point."""
    header = header_of(spark, path)
    columns, kind = resolve_columns(header, spec, path)
    if kind != "tick":
        raise NotImplementedError("only ticks can be streamed")
    scale = None if spec.tick_size is None else scale_of(None, [], spec)[0]
    return layout_of(stream_text(spark, path, header, range_bytes, batch_ranges, separator_of(first_line(spark, path)), batches), columns, spec, symbol, scale)


def load_stream(spark: SparkSession, path: str, tf: str, spec: SourceSpec = SourceSpec(), symbol: str = "", at: str | None = None, range_bytes: int = 16 << 20, batch_ranges: int = 64, progress: Callable[[int, int, int], None] | None = None, with_quality: bool = True, batches: int = 0) -> Streamed:
    """Bars of ``tf`` and quality of a CSV file or folder of ticks, read once as a stream. ``at``: folder for its state and parts.

    With the same ``at`` a load goes on after the last whole batch, and reads what has come since. Bars equal those of the whole
    load in any order of the ticks, since parts of a bar are merged and none is dropped as late. ``progress`` is told of
    each batch: its number, the rows so far and its milliseconds. Without ``with_quality`` bars alone are made. With ``batches``
    the micro-batches grow beyond ``batch_ranges`` if what is there wouldn't be read in so many.
    """
    at = at or shared_path(spark, "stream-load")
    ticks = typed_stream(spark, path, spec, symbol, range_bytes, batch_ranges, batches)

    said = {"rows": 0}

    def each(batch: DataFrame, number: int) -> None:
        began = time.monotonic()
        if with_quality:
            batch.persist()
        try:
            partial_bars(batch, tf).write.mode("overwrite").parquet(f"{at}/bars/batch={number}")
            if with_quality:
                summary(batch.drop("digits")).write.mode("overwrite").parquet(f"{at}/quality/batch={number}")
            if progress is not None:
                said["rows"] += spark.read.schema(PARTS).parquet(f"{at}/bars/batch={number}").agg(F.sum("volume")).first()[0] or 0
                progress(number, said["rows"], round(1000 * (time.monotonic() - began)))
        finally:
            batch.unpersist()

    q = ticks.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    parts = spark.read.schema(f"{PARTS}, batch long").parquet(f"{at}/bars")
    about = parts.agg(F.max("digits").alias("digits"), F.count_distinct("batch").alias("n")).first()
    told = merge_summaries(spark.read.parquet(f"{at}/quality")) if with_quality else None
    return Streamed(merge_bars(parts), told, late_ticks(parts).first().late, about.digits or 0, about.n)
