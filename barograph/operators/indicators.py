"""Indicators over bars: windows for what a frame can tell, a kernel for what depends on its own last value.

All are ordered by ``i`` within ``symbol``; what isn't known yet is null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barograph.operators.ordered import BLOCK, rolling, scan

#: Values that one step of the recursion kernel takes at once.
STRIDE = 64


def period(n: float, name: str = "length") -> int:
    """A whole number of at least 1; 14.0 will do, 38.4 raises."""
    if isinstance(n, bool) or float(n) != int(n) or n < 1:
        raise ValueError(f"{name} must be a whole number of at least 1, got {n!r}")
    return int(n)


def by_time() -> "Window":
    return Window.partitionBy("symbol").orderBy("i")


def sma(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    """Mean of the last n values; null until there are n, and while one of them is null."""
    w = (over or by_time()).rowsBetween(1 - period(n), 0)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def true_range(over: WindowSpec | None = None) -> Column:
    """Reach of a bar together with the close before; the first bar has none before."""
    before = F.lag("close").over(over or by_time())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def drawdown(x: Column) -> Column:
    """How far a value is below the highest so far."""
    return F.max(x).over(by_time().rowsBetween(Window.unboundedPreceding, 0)) - x


def per_bar_return(x: Column, over: WindowSpec | None = None) -> Column:
    before = F.lag(x).over(over or by_time())
    return (x - before) / F.greatest(before, F.lit(1e-9))


#: Bars of a block of the functions below, which give a long series to many tasks.
BLOCK_BARS = 4096


def with_sma(bars: DataFrame, n: int, to: str = "sma", x: str = "close", block: int = BLOCK_BARS) -> DataFrame:
    """``sma`` by blocks: each has the n - 1 bars before it, whatever the length of a block."""
    return rolling(bars, ["symbol"], "i", period(n), {to: lambda w: sma(F.col(x), n, w)}, block)


def with_true_range(bars: DataFrame, to: str = "tr", block: int = BLOCK_BARS) -> DataFrame:
    return rolling(bars, ["symbol"], "i", 2, {to: true_range}, block)


def with_returns(bars: DataFrame, to: str = "ret", x: str = "close", block: int = BLOCK_BARS) -> DataFrame:
    return rolling(bars, ["symbol"], "i", 2, {to: lambda w: per_bar_return(F.col(x), w)}, block)


def with_drawdown(bars: DataFrame, to: str = "dd", x: str = "close", block: int = BLOCK_BARS) -> DataFrame:
    """``drawdown`` by blocks: the highest value so far is carried from block to block."""
    return scan(bars, ["symbol"], ["i"], block, {to: ("max", F.col(x), True)}).drop(BLOCK).withColumn(to, F.col(to) - F.col(x))


def seeded(x: np.ndarray, alpha: float, n: int) -> np.ndarray:
    """``y[n-1] = mean(x[:n])``, then ``y[i] = alpha x[i] + (1 - alpha) y[i-1]``; NaN before.

    Taken STRIDE values at a time: within a stride a matrix of powers does the work, and one number is carried on.
    """
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    out[n - 1] = last = x[:n].mean()
    rest = np.asarray(x[n:], float)
    if not len(rest):
        return out
    beta, k = 1.0 - alpha, np.arange(STRIDE)
    power = np.where(k[:, None] >= k, alpha * beta ** np.maximum(k[:, None] - k, 0), 0.0)
    padded = np.concatenate((rest, np.zeros(-len(rest) % STRIDE))).reshape(-1, STRIDE)
    local, fade = padded @ power.T, beta ** (k + 1)
    for row in local:
        row += fade * last
        last = row[-1]
    out[n:] = local.ravel()[: len(rest)]
    return out


def ema_array(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, 2.0 / (period(n) + 1), period(n))


def rma_array(x: np.ndarray, n: int) -> np.ndarray:
    return seeded(x, 1.0 / period(n), period(n))


def sma_array(x: np.ndarray, n: int) -> np.ndarray:
    n, out = period(n), np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).mean(1)
    return out


def rsi_array(x: np.ndarray, n: int) -> np.ndarray:
    """Strength of gains against losses, first known at position n; 100 where nothing was lost, even if nothing was gained."""
    out, change = np.full(len(x), np.nan), np.diff(x)
    gain, loss = rma_array(np.maximum(change, 0.0), n), rma_array(np.maximum(-change, 0.0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(loss == 0, 100.0, np.where(gain == 0, 0.0, 100.0 - 100.0 / (1.0 + gain / loss)))
    out[1:] = np.where(np.isnan(gain), np.nan, value)
    return out


def tr_array(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    out = high - low
    out[1:] = np.maximum(out[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    return out


def atr_array(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    return rma_array(tr_array(high, low, close), n)


#: Kernels by name, as (bars as arrays, length) -> array.
KERNELS: dict[str, Callable[[dict[str, np.ndarray], int], np.ndarray]] = {
    "sma": lambda b, n: sma_array(b["close"], n),
    "ema": lambda b, n: ema_array(b["close"], n),
    "rma": lambda b, n: rma_array(b["close"], n),
    "rsi": lambda b, n: rsi_array(b["close"], n),
    "atr": lambda b, n: atr_array(b["high"], b["low"], b["close"], n),
}


def recursive(bars: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """``bars`` with columns {name: (kernel, length)}; all are computed in one pass over each series.

    A task holds one series; series are spread by symbol. For one series too long for a task use ``seeded_scan``.
    """
    kept = bars.drop(*wanted)
    schema = StructType([*kept.schema.fields, *(StructField(name, DoubleType()) for name in wanted)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        arrays = {c: pdf[c].to_numpy(float) for c in ("high", "low", "close") if c in pdf}
        return pdf.assign(**{name: KERNELS[kind](arrays, n) for name, (kind, n) in wanted.items()})

    out = kept.groupBy("symbol").applyInPandas(run, schema)
    return out.withColumns({name: F.when(~F.isnan(name), F.col(name)) for name in wanted})


def carried(ends: DataFrame, beta: float, fan: int = 64) -> DataFrame:
    """symbol, b, v, k of what comes before each block: a value ``y`` before the first becomes ``v + beta^k y``.

    ``ends``: symbol, b, and v and k of each block alone. Groups of ``fan`` blocks are folded, and so are the groups, level by level.
    """
    pair = lambda v, k: F.struct(v.alias("v"), k.alias("k"))
    then = lambda x, y: pair(y["v"] + F.pow(F.lit(beta), y["k"]) * x["v"], x["k"] + y["k"])
    none = pair(F.lit(0.0), F.lit(0).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("b", "v", "k")))
    step = lambda s, r: F.struct(then(s["all"], r).alias("all"), F.array_append(s["out"], F.struct(r["b"].alias("b"), s["all"].alias("before"))).alias("out"))
    start = F.struct(none.alias("all"), F.array().cast("array<struct<b:bigint,before:struct<v:double,k:bigint>>>").alias("out"))
    folded = ends.groupBy("symbol", F.floor(F.col("b") / fan).alias("g")).agg(rows.alias("rows")).select("symbol", "g", F.aggregate("rows", start, step).alias("f"))
    inner = folded.select("symbol", "g", F.explode("f.out").alias("o")).select("symbol", "g", "o.b", F.col("o.before").alias("inner"))
    if (ends.agg(F.max("b")).first()[0] or 0) < fan:
        return inner.select("symbol", "b", "inner.*")
    above = carried(folded.select("symbol", F.col("g").alias("b"), "f.all.*"), beta, fan).select("symbol", F.col("b").alias("g"), F.struct("v", "k").alias("outer"))
    return inner.join(above, ["symbol", "g"]).select("symbol", "b", then(F.col("outer"), F.col("inner")).alias("x")).select("symbol", "b", "x.*")


def seeded_scan(bars: DataFrame, x: str, alpha: float, n: int, to: str, block: int = 32) -> DataFrame:
    """The recursion of ``seeded`` by joins and windows only, for a series of any length.

    Blocks of ``block`` bars are solved on their own as a sum of fading terms; the blocks' last values are carried on by
    ``carried``; then the carry is added back.
    """
    n, beta = period(n), 1.0 - alpha
    if beta == 0:
        return bars.withColumn(to, F.when(F.col("i") >= n - 1, F.col(x)))
    seed = bars.where(F.col("i") < n).groupBy("symbol").agg(F.avg(x).alias("_seed"), F.count("*").alias("_n")).where(F.col("_n") == n).select("symbol", "_seed")
    after = F.col("i") - n
    b = bars.withColumns({"_b": F.when(after >= 0, F.floor(after / F.lit(block))), "_k": F.pmod(after, F.lit(block)) + 1})
    faded = F.sum(F.lit(alpha) * F.col(x) * F.pow(F.lit(beta), -F.col("_k"))).over(Window.partitionBy("symbol", "_b").orderBy("i"))
    b = b.withColumn("_local", F.when(F.col("_b").isNotNull(), faded * F.pow(F.lit(beta), F.col("_k"))))
    ends = b.where("_b is not null").groupBy("symbol", F.col("_b").alias("b")).agg(F.max_by("_local", "i").alias("v"), F.max("_k").cast("long").alias("k"))
    carry = carried(ends, beta).join(seed, "symbol").select("symbol", F.col("b").alias("_b"), (F.col("v") + F.pow(F.lit(beta), F.col("k")) * F.col("_seed")).alias("_carry"))
    out = b.join(carry, ["symbol", "_b"], "left").join(seed, "symbol", "left")
    value = F.when(F.col("i") == n - 1, F.col("_seed")).when(F.col("_b").isNotNull(), F.col("_local") + F.pow(F.lit(beta), F.col("_k")) * F.col("_carry"))
    return out.select(*bars.columns, value.alias(to))
