"""Fold geometry, masks, and walk-forward as one job over folds and configurations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.functions.columns import finite, walk_forward_verdict
from barograph.operators.intervals import interval_join
from barograph.operators.search import ParamSpec, best, grid, run_all, score
from barograph.sources.shared import written


def _folds(spark: SparkSession, n_bars: int, train: int, test: int, step: int | None, embargo: int, anchored: bool) -> DataFrame:
    step = step or test
    count = max(0, (n_bars - train - embargo - test) // step + 1)
    at = F.col("fold") * step
    begin = F.lit(0).cast("long") if anchored else at
    end = at + train
    return spark.range(count).select(F.col("id").cast("int").alias("fold")).select("fold", *[x.cast("long").alias(c) for c, x in (("train_start", begin), ("train_end", end), ("test_start", end + embargo), ("test_end", end + embargo + test))])


def rolling_folds(spark: SparkSession, n_bars: int, train: int, test: int, step: int | None = None, embargo: int = 0) -> DataFrame:
    """Half-open train and test ranges; the train range slides by ``step`` (the test length). The last test range ends within the bars."""
    return _folds(spark, n_bars, train, test, step, embargo, False)


def anchored_folds(spark: SparkSession, n_bars: int, train: int, test: int, step: int | None = None, embargo: int = 0) -> DataFrame:
    """The same with a train range that always begins at the first bar."""
    return _folds(spark, n_bars, train, test, step, embargo, True)


def purged_kfold(spark: SparkSession, n_bars: int, k: int) -> DataFrame:
    """k test ranges that cover all bars; what may be trained on is told by ``train_mask``."""
    at = np.rint(np.linspace(0, n_bars, k + 1)).astype(int).tolist()
    return spark.createDataFrame([(i, 0, n_bars, at[i], at[i + 1]) for i in range(k)], "fold int, train_start long, train_end long, test_start long, test_end long")


def train_mask(i: Column, n_bars: Column, purge: int, embargo: int = 0) -> Column:
    """Whether bar i may be trained on: not from ``purge`` before the test range to ``embargo`` after it."""
    low = F.greatest(F.lit(0), F.col("test_start") - purge)
    return ~((i >= low) & (i < F.least(n_bars, F.col("test_end") + embargo)))


def attribute(trades: DataFrame, folds: DataFrame, start: str = "test_start", stop: str = "test_end") -> DataFrame:
    """Trades with each fold in whose range they were entered; an equality join on cells of ranges, however many folds there are."""
    return interval_join(trades, folds, "entry_i", start, stop)


def trained_bars(bars: DataFrame, folds: DataFrame, n_bars: int, purge: int, embargo: int = 0) -> DataFrame:
    """fold and bars, how many bars ``train_mask`` leaves to each fold: all but those in its barred range."""
    low, high = F.greatest(F.lit(0).cast("long"), F.col("test_start") - purge), F.least(F.lit(n_bars).cast("long"), F.col("test_end") + embargo)
    barred = folds.select("fold", low.alias("low"), high.alias("high"))
    lost = interval_join(bars.select("i"), barred, "i", "low", "high").groupBy("fold").agg(F.count("*").alias("lost"))
    return folds.select("fold").join(lost, "fold", "left").select("fold", (F.lit(n_bars) - F.coalesce("lost", F.lit(0))).cast("long").alias("bars"))


def purge_width(trades: DataFrame, quantile: float = 0.99) -> DataFrame:
    """One row, purge: the given quantile of trade lengths, rounded up; 0 without trades."""
    return trades.agg(F.coalesce(F.ceil(F.percentile(F.col("exit_i") - F.col("entry_i"), F.lit(quantile))), F.lit(0)).alias("purge"))


def walk_forward(bars: DataFrame, folds: DataFrame, spec: ParamSpec, signal: Callable, tf: str, min_trades: int = 0, most: int = 10, **run: Any) -> DataFrame:
    """Per fold the best configuration of its train range, and what it does once on the test range.

    All folds and configurations are one job. Runs see only the bars of their own range. Columns: fold, ranges,
    ord and parameters, train_score, test_score and the test's metrics.
    """
    bars, params = written(bars, "walk-bars"), grid(bars.sparkSession, spec, most)
    names = params.columns
    train = folds.crossJoin(params).select("fold", F.col("train_start").alias("start"), F.col("train_end").alias("stop"), *names)
    scored = run_all(bars, train, signal, tf, **run).withColumn("score", score(min_trades=min_trades))
    won = best(scored.select("fold", *names, "score"), ("fold",)).withColumnRenamed("score", "train_score")
    test = folds.join(won, "fold").select("fold", F.col("test_start").alias("start"), F.col("test_end").alias("stop"), *names, "train_score")
    out = run_all(bars, test, signal, tf, **run).withColumn("test_score", score())
    return folds.join(out.drop("start", "stop"), "fold")


def summary(per_fold: DataFrame, comparisons: int | None = None) -> DataFrame:
    """One row: folds, mean_oos_score, efficiency, positive_folds, verdict. Means are over finite scores only."""
    train, test = finite(F.col("train_score")), finite(F.col("test_score"))
    out = per_fold.agg(
        F.count("*").alias("folds"), F.avg(test).alias("mean_oos_score"),
        F.try_divide(F.avg(F.when(train != 0, test)), F.avg(F.when(train != 0, train))).alias("efficiency"), F.count_if(test > 0).alias("positive_folds"),
    )
    out = out.withColumn("verdict", walk_forward_verdict(F.col("efficiency"), F.col("positive_folds"), F.col("folds")))
    return out if comparisons is None else out.withColumn("comparisons", F.lit(comparisons).cast("long"))
