"""Signals as a table function of SQL: ``SELECT ... FROM strategy_signals(TABLE(bars), 'name or source', '{"parameter": 1}')``."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

NAME = "strategy_signals"
NEED = ("symbol", "i", "ms", "open", "high", "low", "close")


def strategy(text: str):
    """A strategy of the library by its name, or the ``signal`` of a source that passes the validator."""
    from barograph.operators import signals

    known = {"ema_cross": signals.ema_cross_arrays, "stretch": signals.stretch_arrays}
    return known[text] if text in known else signals.compile_source(text)


class StrategySignals:
    """Bars in, a row of signals a bar out. Series are parted by symbol and taken in order of i, whatever the query says; a task holds one series.

    Unknown names, sources that aren't allowed, parameters that aren't JSON and missing columns are refused when the query is analysed.
    """

    def __init__(self) -> None:
        self.columns: dict[str, list] = {}
        self.about: tuple[str, str] | None = None

    @staticmethod
    def analyze(bars: AnalyzeArgument, source: AnalyzeArgument, params: AnalyzeArgument) -> AnalyzeResult:
        if not bars.isTable:
            raise ValueError(f"the first argument of {NAME} is TABLE(bars)")
        if missing := [c for c in NEED if c not in bars.dataType.names]:
            raise ValueError(f"bars lack {', '.join(missing)}")
        if not isinstance(source.value, str) or not isinstance(params.value, str):
            raise ValueError(f"the strategy and the parameters of {NAME} are constant strings")
        strategy(source.value)
        if not isinstance(json.loads(params.value), dict):
            raise ValueError("the parameters are a JSON object")
        schema = StructType().add("symbol", StringType()).add("i", LongType()).add("ms", LongType()).add("long_entry", BooleanType()).add("short_entry", BooleanType()).add("stop_distance", DoubleType()).add("target_distance", DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("i")])

    def eval(self, bars: Row, source: str, params: str) -> None:
        if not self.columns:
            self.about = source, params
            self.columns = {c: [] for c in (*NEED, *(c for c in ("volume", "spread") if c in bars))}
        for c, values in self.columns.items():
            values.append(bars[c])

    def terminate(self) -> Iterator[tuple]:
        if not self.columns:
            return
        from types import SimpleNamespace

        from barograph.operators.signals import SIGNALS, evaluate_signal

        held = self.columns
        series = SimpleNamespace(ms=np.array(held["ms"], np.int64), **{c: np.array(v, float) for c, v in held.items() if c not in ("symbol", "i", "ms")})
        got = evaluate_signal(strategy(self.about[0]), series, json.loads(self.about[1]))
        plain = [[None if x != x else x for x in got[k].tolist()] for k in SIGNALS]  # a NaN is no value
        yield from zip(held["symbol"], held["i"], held["ms"], *plain, strict=True)


def register(spark: SparkSession) -> str:
    """Make the function known to the session's SQL; its name."""
    spark.udtf.register(NAME, udtf(StrategySignals))
    return NAME
