"""Control test: the same strategy on bars whose returns are put in another order."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.columns import finite, ln
from barograph.functions.instrument import Instrument
from barograph.operators.fills import simulate
from barograph.operators.metrics import SCHEMA, metrics_of
from barograph.operators.signals import arrays_of, evaluate_signal
from barograph.sources.shared import written


def shuffled_bars(bars: DataFrame, trials: int = 5, seed: int = 0) -> DataFrame:
    """``trials`` versions of each series, by trial: log returns in a hashed order, bars rescaled to the new closes.

    Times and spreads stay. The same seed gives the same order.
    """
    w = Window.partitionBy("symbol").orderBy("i")
    r = bars.withColumn("_r", ln(F.col("close")) - ln(F.lag("close").over(w)))
    made = r.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    drawn = made.where("_r is not null").select("symbol", "trial", F.col("_r").alias("_s"), F.row_number().over(Window.partitionBy("symbol", "trial").orderBy(F.xxhash64(F.lit(seed), "trial", "i"), "i")).cast("long").alias("i"))
    first = bars.groupBy("symbol").agg(F.min_by("close", "i").alias("_first"))
    joined = made.join(drawn, ["symbol", "trial", "i"], "left").join(first, "symbol")
    path = F.coalesce(F.sum("_s").over(Window.partitionBy("symbol", "trial").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    target = F.col("_first") * F.exp(path)
    scale = F.when(F.col("close") == 0, target * float("inf")).otherwise(F.try_divide(target, F.col("close")))
    prices = {c: F.col(c) * F.col("_k") for c in ("open", "high", "low", "close")}
    return joined.withColumn("_k", scale).withColumns(prices).select("trial", *bars.columns)


def control_runs(bars: DataFrame, signal: Callable, params: dict[str, Any], tf: str, trials: int = 5, seed: int = 0, instrument: Instrument = Instrument(), capital: float = 10_000.0, risk_pct: float = 0.01) -> DataFrame:
    """Metrics by symbol and trial; trial -1 is the real order."""
    bars = written(bars, "control-bars")
    real = bars.withColumn("trial", F.lit(-1)).select("trial", *bars.columns)
    rows = real.unionByName(shuffled_bars(bars, max(1, int(trials)), seed))

    def run(key, pdf):
        import pandas as pd

        b = arrays_of(pdf.sort_values("i"))
        return pd.DataFrame([{"symbol": key[0], "trial": key[1]} | metrics_of(simulate(b, evaluate_signal(signal, b, params), instrument, capital, risk_pct), tf, capital)])

    return rows.groupBy("symbol", "trial").applyInPandas(run, f"symbol string, trial int, {SCHEMA}")


def control_test(runs: DataFrame) -> DataFrame:
    """Per symbol: real, mean and best control expectancy, and whether the real one beats all controls."""
    edge = finite(F.col("expectancy_r"))
    real, control = F.max(F.when(F.col("trial") == -1, edge)), F.when(F.col("trial") >= 0, edge)
    out = runs.groupBy("symbol").agg(real.alias("real_expectancy_r"), F.avg(control).alias("control_mean_expectancy_r"), F.max(control).alias("control_max_expectancy_r"))
    return out.withColumn("passed", F.coalesce(F.col("real_expectancy_r") > F.col("control_max_expectancy_r"), F.lit(False)))
