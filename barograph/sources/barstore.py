"""Stored bars: by symbol, timeframe and time, so that a slice reads the files that it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.functions.timeframes import DAY, normal, timeframe_ms
from barograph.operators.bars import BARS, roll_up

#: Bars of a period, which is a folder: some hundred thousand rows, whatever the timeframe.
PERIOD_BARS = 1 << 18


def period_ms(tf: str) -> int:
    """Milliseconds of a period, whole days."""
    return max(1, timeframe_ms(tf) * PERIOD_BARS // DAY) * DAY


class BarStore:
    """Bars under ``root``/timeframe=.../symbol=.../period=..., sorted by time in their files.

    A timeframe is written whole; coarser ones are derived from the base once and kept. A symbol is any string; a null
    one is kept, too.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, tf: str) -> str:
        return f"{self.root}/timeframe={normal(tf)}"

    def has(self, tf: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._at(tf)}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def put(self, bars: DataFrame, tf: str) -> None:
        """Write all bars of a timeframe, in place of what is there; a task writes a stretch of time of a symbol."""
        period = F.floor(F.col("ms") / F.lit(period_ms(tf)))
        rows = bars.select(*(c.split()[0] for c in BARS.split(", "))).withColumn("period", period)
        rows.repartitionByRange("symbol", "period", "ms").sortWithinPartitions("symbol", "period", "ms").write.mode("overwrite").partitionBy("symbol", "period").parquet(self._at(tf))

    def read(self, tf: str, start: int | None = None, stop: int | None = None, symbols: list[str] | None = None) -> DataFrame:
        """Bars that begin in [start, stop), of some symbols: folders are pruned by both, and files by the times in them."""
        rows = self.spark.read.schema(f"{BARS}, period long").parquet(self._at(tf))
        width, keep = period_ms(tf), []
        if symbols is not None:
            keep.append(F.col("symbol").isin(symbols))
        if start is not None:
            keep += [F.col("period") >= start // width, F.col("ms") >= start]
        if stop is not None:
            keep += [F.col("period") <= (stop - 1) // width, F.col("ms") < stop]
        return (rows.where(_all(keep)) if keep else rows).select(*(c.split()[0] for c in BARS.split(", ")))

    def derived(self, base: str, tf: str) -> None:
        """See to it that ``tf`` is there, rolled up from ``base``."""
        if not self.has(tf):
            self.put(roll_up(self.read(base), tf, base), tf)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
