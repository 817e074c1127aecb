"""Bars and quality counters from a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barograph.functions.columns import bucket
from barograph.functions.timeframes import timeframe_ms
from barograph.operators.bars import BARS, bars_from_ticks
from barograph.sources.ticks import TICKS


def read_ticks(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over the Parquet files of ticks that arrive in a folder."""
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_bars(ticks: DataFrame, tf: str, watermark: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks, for append mode: a bar comes out once the watermark has passed its end.

    Ticks that are late by less than ``watermark`` join their bar; later ones are dropped, and Spark counts them
    (``numRowsDroppedByWatermark``); ``finish`` makes up for them. The batch operator and this one have the same columns.
    """
    width, at, spread = timeframe_ms(tf), F.struct("ms", "seq"), F.col("ask") - F.col("bid")
    if not width:
        raise ValueError("ticks have no bars")
    timed = ticks.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", watermark)
    made = timed.groupBy("symbol", F.window("ts", f"{width} milliseconds").alias("w")).agg(
        F.min_by("bid", at).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", at).alias("close"),
        F.count("*").alias("volume"), F.avg(spread).alias("spread"), F.max(spread).alias("spread_max"),
    )
    return made.select("symbol", F.unix_millis("w.start").alias("ms"), "open", "high", "low", "close", "volume", "spread", "spread_max")


def run_to_end(spark: SparkSession, bars: DataFrame, out: str, checkpoint: str, listener: Any = None) -> None:
    """Write what a stream of bars has now to Parquet files, and stop."""
    if listener is not None:
        spark.streams.addListener(listener)
    try:
        bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if listener is not None:
            spark.streams.removeListener(listener)


def short_bars(ticks: DataFrame, written: DataFrame, tf: str) -> DataFrame:
    """symbol, ms, lacking of the bars that have more ticks than were written for them: held back, or dropped as late."""
    seen = ticks.groupBy("symbol", bucket(F.col("ms"), tf).alias("bar_ms")).agg(F.count("*").alias("n")).withColumnRenamed("bar_ms", "ms")
    lacking = F.col("n") - F.coalesce("volume", F.lit(0))
    return seen.join(written.select("symbol", "ms", "volume"), ["symbol", "ms"], "left").select("symbol", "ms", lacking.alias("lacking")).where("lacking > 0")


def finish(spark: SparkSession, ticks: DataFrame, out: str, tf: str) -> DataFrame:
    """All bars once the source has ended: the same as the batch operator's, however the ticks came in.

    A bar that was written with fewer ticks than there are, or not at all, is made again from its ticks; the others
    stay as they were written.
    """
    written = spark.read.schema(BARS).parquet(out)
    short = short_bars(ticks, written, tf).select("symbol", "ms")
    again = ticks.withColumn("_bar", bucket(F.col("ms"), tf)).join(short.withColumnRenamed("ms", "_bar"), ["symbol", "_bar"], "left_semi").drop("_bar")
    return written.join(short, ["symbol", "ms"], "left_anti").unionByName(bars_from_ticks(again, tf))


QUALITY = "symbol string, rows long, first_ms long, last_ms long, out_of_order long, duplicate_timestamps long, max_duplicate_run long, negative_spread long, zero_spread long, bad_price long"


def stream_quality(ticks: DataFrame) -> DataFrame:
    """Running quality counters of each symbol, for update mode; gaps and runs are measured across batches.

    Each batch is taken in (ms, seq) order. A tick earlier than the last of the batch before counts as out of order.
    A task holds one batch of a symbol, whose size the source's files per trigger bound.
    """
    state = "rows long, first_ms long, last_ms long, prev_ms long, out_of_order long, dup long, best long, run long, negative long, zero long, bad long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows, first, top, last, late, dup, best, run, negative, zero, bad = held.get if held.exists else (0, None, None, None, 0, 0, 0, 0, 0, 0, 0)
        pdf = pd.concat(list(batches)).sort_values(["ms", "seq"])
        if len(pdf):
            seen = pdf["ms"].to_numpy()
            # what the batch goes on from: the last tick before it, at the end of a run of ``run`` repeats
            before = int(seen[0]) - 1 if last is None else last
            starts = np.flatnonzero(np.diff(seen, prepend=before))
            repeats = np.diff(np.append(starts, len(seen))) - 1
            head = int(starts[0]) if len(starts) else len(seen)  # ticks at the very time of the last one before
            late += int(seen[0] < before)  # the rest of the batch is in order
            dup += head + int(repeats.sum())
            best = max([best, run + head if head else 0, *([int(repeats.max())] if len(repeats) else [])])
            run = int(repeats[-1]) if len(repeats) else run + head
            last = int(seen[-1])
            rows, first, top = rows + len(pdf), min([int(seen.min())] + [first] * (first is not None)), max([int(seen.max())] + [top] * (top is not None))
            negative, zero = negative + int((pdf["ask"] < pdf["bid"]).sum()), zero + int((pdf["ask"] == pdf["bid"]).sum())
            bad += int((pdf["bid"] <= 0).sum() + (pdf["ask"] <= 0).sum())
        held.update((rows, first, top, last, late, dup, best, run, negative, zero, bad))
        yield pd.DataFrame([(key[0], rows, first, top, late, dup, best, negative, zero, bad)], columns=[x.split()[0] for x in QUALITY.split(", ")])

    return ticks.groupBy("symbol").applyInPandasWithState(step, QUALITY, state, "update", GroupStateTimeout.NoTimeout)
