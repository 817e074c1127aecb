"""The sixteen metrics of a run, from its trades and equity: as DataFrames, and as a kernel for sweeps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.columns import ratio
from barograph.functions.timeframes import bars_per_year
from barograph.operators.fills import Result
from barograph.operators.quality import longest_run

METRICS = ["n_trades", "net_profit", "profit_factor", "expectancy_r", "win_rate", "max_drawdown", "max_drawdown_pct", "sharpe", "sortino", "calmar", "sqn", "avg_r", "std_r", "largest_loss", "max_consecutive_losses", "exposure"]
SCHEMA = ", ".join(f"{m} {'long' if m in ('n_trades', 'max_consecutive_losses') else 'double'}" for m in METRICS)


def metrics(trades: DataFrame, equity: DataFrame, tf: str, capital: float = 10_000.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row for each key of ``equity``; all zero for a run without trades. No losses: an infinite profit factor."""
    year, k = bars_per_year(tf), list(keys)
    w = Window.partitionBy(*k).orderBy("i")
    e = equity.withColumns({"peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag("equity").over(w)})
    e = e.withColumns({"dd": F.col("peak") - F.col("equity"), "ret": (F.col("equity") - F.col("before")) / F.greatest("before", F.lit(1e-9))})
    curve = e.groupBy(*k).agg(
        F.count("*").alias("bars"), F.max("dd").alias("max_drawdown"), F.max(F.col("dd") / F.greatest("peak", F.lit(1e-9))).alias("max_drawdown_pct"),
        F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"),
    )
    runs = longest_run(trades, F.col("pnl") < 0, k, ["k"]).withColumnRenamed("n", "max_consecutive_losses")
    win, lose = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    done = trades.groupBy(*k).agg(
        F.count("*").alias("n_trades"), F.sum("pnl").alias("net_profit"), F.coalesce(F.try_divide(F.coalesce(win, F.lit(0.0)), lose), F.lit(float("inf"))).alias("profit_factor"),
        F.avg("r_multiple").alias("avg_r"), F.coalesce(F.stddev_samp("r_multiple"), F.lit(0.0)).alias("std_r"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.min(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0)).alias("largest_loss"), F.sum(F.col("exit_i") - F.col("entry_i")).alias("held"),
    ).join(runs, k)
    out = curve.join(done, k, "left")
    when_sd = lambda sd, x: F.when(sd > 0, x).otherwise(0.0)
    yearly = math.sqrt(year)
    cols = {
        "expectancy_r": F.col("avg_r"), "sharpe": when_sd(F.col("sd"), F.try_divide("mean", "sd") * yearly), "sortino": when_sd(F.col("down"), F.try_divide("mean", "down") * yearly),
        "calmar": when_sd(F.col("max_drawdown_pct"), F.try_divide(F.col("net_profit") / capital / F.greatest(F.col("bars") / year, F.lit(1e-9)), F.col("max_drawdown_pct"))),
        "sqn": when_sd(F.col("std_r"), F.try_divide("avg_r", "std_r") * F.sqrt("n_trades")), "exposure": ratio(F.col("held"), F.col("bars")),
    }
    out = out.withColumns(cols)
    return out.select(*k, *[F.when(F.col("n_trades") > 0, F.col(m)).otherwise(0).cast(t).alias(m) for m, t in (x.split() for x in SCHEMA.split(", "))])


def metrics_of(run: Result, tf: str, capital: float = 10_000.0) -> dict[str, float]:
    """The same for one run in memory."""
    t, eq, year = run.trades, run.equity, bars_per_year(tf)
    n = len(t)
    if not n:
        return dict.fromkeys(METRICS, 0.0) | {"n_trades": 0, "max_consecutive_losses": 0}
    pnl, r = t["pnl"].to_numpy(), t["r_multiple"].to_numpy()
    peak = np.maximum.accumulate(eq)
    dd, ret = peak - eq, np.diff(eq) / np.maximum(eq[:-1], 1e-9)
    spread = lambda x: float(x.std(ddof=1)) if len(x) > 1 else 0.0
    by = lambda a, b: float(a / b) if b > 0 else 0.0
    lost, pct, sd_r = -float(pnl[pnl < 0].sum()), float((dd / np.maximum(peak, 1e-9)).max()), spread(r)
    mean = float(ret.mean()) if len(ret) else 0.0
    worse = pd.Series(pnl < 0)
    streak = int(worse.groupby((~worse).cumsum()).sum().max())
    net, avg = float(pnl.sum()), float(r.mean())
    return {
        "n_trades": n, "net_profit": net, "profit_factor": float(pnl[pnl > 0].sum()) / lost if lost > 0 else math.inf, "expectancy_r": avg, "win_rate": float((pnl > 0).mean()),
        "max_drawdown": float(dd.max()), "max_drawdown_pct": pct, "sharpe": by(mean, spread(ret)) * math.sqrt(year), "sortino": by(mean, spread(ret[ret < 0])) * math.sqrt(year),
        "calmar": by(net / capital / max(len(eq) / year, 1e-9), pct), "sqn": by(avg, sd_r) * math.sqrt(n), "avg_r": avg, "std_r": sd_r,
        "largest_loss": float(pnl[pnl < 0].min()) if lost > 0 else 0.0, "max_consecutive_losses": streak, "exposure": float((t["exit_i"] - t["entry_i"]).sum() / len(eq)),
    }


def rates(counters: DataFrame, trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Share of ambiguous exits among trades, and of resolved ones among those that spanned both levels."""
    n = trades.groupBy(*keys).agg(F.count("*").alias("n"))
    return counters.join(n, list(keys), "left").select(*keys, ratio(F.col("ambiguous"), F.col("n")).alias("ambiguity_rate"), ratio(F.col("resolved"), F.col("ambiguous") + F.col("resolved")).alias("resolution_rate"))


def reconciled(trades: DataFrame, equity: DataFrame, capital: float = 10_000.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Whether the last equity is the capital and the sum of all trades."""
    last, total = equity.groupBy(*keys).agg(F.max_by("equity", "i").alias("last")), trades.groupBy(*keys).agg(F.sum("pnl").alias("total"))
    return last.join(total, list(keys), "left").select(*keys, (F.abs(F.col("last") - capital - F.coalesce("total", F.lit(0.0))) < 1e-6).alias("reconciled"))
