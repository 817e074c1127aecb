"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barograph.functions.timeframes import HOUR, timeframe_ms


def bucket(ms: Column, tf: str) -> Column:
    """Start of the bar that holds ``ms``, counted from the epoch; weeks begin on Thursday."""
    width = timeframe_ms(tf)
    if not width:
        raise ValueError("ticks have no bars")
    return ms - F.pmod(ms, F.lit(width))


def in_hours(ms: Column, start: int, end: int) -> Column:
    """Whether the UTC hour is in [start, end), which may cross midnight; equal bounds hold all hours."""
    hour = F.pmod(F.floor(ms / F.lit(HOUR)), F.lit(24))
    if start == end:
        return F.lit(True)
    return (hour >= start) | (hour < end) if start > end else (hour >= start) & (hour < end)


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ln(x: Column) -> Column:
    """Natural logarithm as floating-point arithmetic has it: NaN below 0, minus infinity at 0. Spark's own is null there."""
    return F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation of the pairs without nulls, as an aggregate: null without pairs, NaN where one side doesn't vary."""
    paired = x.isNotNull() & y.isNotNull()
    a, b = F.when(paired, x), F.when(paired, y)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.when(F.count_if(paired) > 0, F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(float("nan"))))


def plain(x: Column, places: int = 6) -> Column:
    """A number fit for JSON: rounded, null where it isn't finite."""
    return F.round(finite(x), places)


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and ``empty`` where b is 0 or null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def span(first_ms: Column, last_ms: Column) -> Column:
    """``2024-01-01 .. 2024-02-01`` in UTC; empty if both are 0."""
    day = lambda x: F.date_format(F.timestamp_millis(x), "yyyy-MM-dd")
    return F.when((first_ms == 0) & (last_ms == 0), F.lit("")).otherwise(F.concat_ws(" .. ", day(first_ms), day(last_ms)))


def plateau_verdict(score: Column, n: Column, robustness: Column) -> Column:
    """In words, how a score holds up among its neighbours."""
    return (
        F.when(score <= 0, "unscored: the peak isn't positive")
        .when(finite(score).isNull() | (n > 0) & finite(robustness).isNull(), "unscored: no finite score")
        .when(n == 0, "can't be judged: no neighbours")
        .when(robustness >= 0.9, "flat")
        .when(robustness >= 0.7, "plateau")
        .when(robustness >= 0.4, "slope")
        .otherwise("spike")
    )


def walk_forward_verdict(efficiency: Column, positive: Column, folds: Column) -> Column:
    """In words, what efficiency and the share of profitable folds say together."""
    share = ratio(positive, folds)
    return (
        F.when(finite(efficiency).isNull(), "no verdict")
        .when((efficiency >= 0.5) & (share >= 0.8), "generalized")
        .when(share >= 0.8, "consistent but decayed")
        .when((efficiency >= 0.4) & (share >= 0.6), "partial")
        .when((efficiency <= 0) | (share < 0.4), "did not generalize")
        .otherwise("weak")
    )
