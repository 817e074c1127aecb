"""The verbs of the engine over a catalogue: load, list, backtest, optimise, validate, control, chart, history."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.functions.instrument import Instrument
from barograph.functions.timeframes import TIMEFRAMES, assert_serves, base_for, bars_per_year, name_of, normal, served_by, timeframe_ms
from barograph.operators import bars as B
from barograph.operators import charts, control, fills, folds, plateau, search
from barograph.operators.metrics import METRICS, metrics
from barograph.operators.quality import quality_report
from barograph.operators.signals import SIGNALS, arrays_of, compile_source, evaluate_signal, validate_source
from barograph.sources.artifacts import Artifacts, fingerprint
from barograph.sources.barstore import BarStore
from barograph.sources.catalog import Catalog
from barograph.sources.csv_source import SourceSpec, read_csv
from barograph.streaming.load import load_stream


def number(x: Any) -> Any:
    """Fit for JSON: rounded to six places, None if it isn't finite."""
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else None
    return x


def signals_of(bars: DataFrame, source: str, params: dict[str, Any]) -> DataFrame:
    """``bars`` with the signal columns of a strategy's source; a task holds one series."""
    import pandas as pd

    fn_source = source
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema.fields) + ", " + ", ".join(f"{c} {'boolean' if c.endswith('entry') else 'double'}" for c in SIGNALS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf.assign(**evaluate_signal(compile_source(fn_source), arrays_of(pdf), params))

    return bars.groupBy("symbol").applyInPandas(run, schema)


class Engine:
    """All state is in ``root``: the catalogue, and artifacts that results are stored in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalog, self.artifacts = Catalog(spark, f"{self.root}/catalog"), Artifacts(spark, f"{self.root}/artifacts")

    # data
    def load_data(self, path: str, name: str, timeframe: str = "", base_timeframe: str = "", spec: SourceSpec = SourceSpec(), instrument: Instrument | None = None, stream: bool = False, progress: Callable[[int, int, int], None] | None = None) -> dict[str, Any]:
        """Read a CSV source, store its bars at the base timeframe and register it; the last load of a name counts.

        ``stream``: read the file once, as a stream of byte ranges; ticks only. Bars are the same either way. The streamed quality follows
        the batches, of which ``progress`` is told (number, rows so far, milliseconds): quantiles are those of sketches (see ``streaming.load``), and a batch that goes back in time counts as one step out of order.
        """
        if stream:
            base = base_for(timeframe, base_timeframe)
            # a load of its own each time, so that the last one counts and not what earlier ones have read
            streamed = load_stream(self.spark, path, base, spec, name, f"{self.root}/streams/{uuid.uuid4().hex}", progress=progress)
            kind, tick, late, made, told = "tick", spec.tick_size or 10.0**-streamed.decimals, streamed.late_rows, streamed.bars, streamed.quality
        else:
            source = read_csv(self.spark, path, spec, name)
            base = base_for(timeframe, base_timeframe)
            if source.resolution_ms > timeframe_ms(base):
                if timeframe:
                    assert_serves(source.resolution_ms, timeframe)
                base = normal(name_of(source.resolution_ms))
            kind, tick, late, made, told = source.kind, source.tick_size, None, B.build_bars(source.rows, base, source.resolution_ms), quality_report(source.rows)
        default = normal(timeframe) if timeframe else base
        sha = self.artifacts.put_table(made)
        made = self.artifacts.get_table(sha)
        quality = {k: number(v) for k, v in told.drop("symbol").first().asDict().items()}
        bars = made.count()
        instrument = instrument or Instrument(tick_size=tick)
        self.catalog.put_source(
            name=name, path=path, digest=fingerprint(self.spark, path), kind=kind, base_timeframe=base, default_timeframe=default, utc_offset_hours=float(spec.utc_offset_hours),
            default_bars=bars if default == base else B.roll_up(made, default).count(), rows=quality["rows"], late_rows=late, bars=bars, first_ms=quality["first_ms"], last_ms=quality["last_ms"], tick_size=tick,
            instrument_json=json.dumps(asdict(instrument)), quality_json=json.dumps(quality), bars_sha=sha, ingest="stream" if stream else "whole",
        )
        return self.catalog.source(name) | {"quality": quality, "serves": served_by(base)}

    def list_data(self) -> list[dict[str, Any]]:
        return [r.asDict() | {"serves": served_by(r.base_timeframe)} for r in self.catalog.table("data_source").orderBy(F.desc("created_at")).collect()]

    def bars_for(self, name: str, timeframe: str = "", start: int | None = None, stop: int | None = None) -> tuple[DataFrame, str]:
        """Indexed bars of a source and their timeframe: as asked, or its default. A source without any spread has no spread column.

        A timeframe is rolled up when it is first asked for, and kept. ``start``, ``stop``: milliseconds of the bars that are read.
        """
        row = self.catalog.source(name)
        tf = normal(timeframe or row["default_timeframe"] or row["base_timeframe"])
        store, base = BarStore(self.spark, f"{self.root}/bars/{row['bars_sha']}"), row["base_timeframe"]
        if not store.has(base):
            store.put(self.artifacts.get_table(row["bars_sha"]), base)
        store.derived(base, tf)
        made = store.read(tf, start, stop)
        if not made.where("spread <> 0").head(1):
            made = made.drop("spread")
        return B.with_index(made), tf

    def intrabar_for(self, name: str, signal_tf: str, intrabar: str) -> DataFrame:
        """Finer bars to settle exits with: finer than the signal's, and not finer than what is stored."""
        if timeframe_ms(intrabar) >= timeframe_ms(signal_tf):
            raise ValueError(f"{normal(intrabar)} is not finer than {normal(signal_tf)}")
        return self.bars_for(name, intrabar)[0]

    # strategies
    def save_strategy(self, strategy_id: str, source: str, params: dict[str, Any] | None = None, **about: Any) -> dict[str, Any]:
        verdict = validate_source(source)
        if not verdict.ok:
            raise ValueError("; ".join(verdict.errors))
        sha = hashlib.sha256(source.encode()).hexdigest()
        n = self.catalog.save_version(strategy_id, source, sha, params or {}, warnings=verdict.warnings, **about)
        return {"strategy_id": strategy_id, "version": n, "signal_sha": sha[:12], "warnings": verdict.warnings}

    def list_strategies(self, include_archived: bool = False) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.catalog.strategies(include_archived).collect()]

    def get_strategy(self, strategy_id: str, version: int = 0) -> dict[str, Any]:
        return self.catalog.version(strategy_id, version)

    def archive_strategy(self, strategy_id: str, reason: str = "") -> None:
        self.catalog.archive(strategy_id, reason)

    # runs
    def _run(self, kind: str, strategy_id: str, version: int, data: str, params: dict, timeframe: str, work) -> dict[str, Any]:
        v = self.catalog.version(strategy_id, version)
        bars, tf = self.bars_for(data, timeframe)
        bars_per_year(tf)
        instrument = Instrument(**json.loads(self.catalog.source(data)["instrument_json"]))
        run_id = self.catalog.start_run(v["version_pk"], data, kind, params, tf)
        try:
            out, figures, sha = work(run_id, v, bars, tf, instrument)
        except Exception as e:
            self.catalog.finish_run(run_id, "error", error=f"{type(e).__name__}: {e}")
            raise
        self.catalog.finish_run(run_id, metrics=figures, artifact_sha=sha)
        return {"run_id": run_id, "strategy": f"{strategy_id} v{v['version']}", "data": data, "timeframe": tf} | out

    def backtest(self, strategy_id: str, data: str, version: int = 0, params: dict[str, Any] | None = None, timeframe: str = "", intrabar: str = "", capital: float = 10_000.0, risk_pct: float = 0.01) -> dict[str, Any]:
        def work(run_id, v, bars, tf, instrument):
            p = v["params"] | (params or {})
            finer = self.intrabar_for(data, tf, intrabar) if intrabar else None
            sha = self.artifacts.put_table(fills.backtest(signals_of(bars, v["signal_block"], p), instrument, capital, risk_pct, finer, timeframe_ms(tf)))
            done = self.artifacts.get_table(sha)
            trades, equity = fills.trades(done), fills.equity(done)
            m = {k: number(x) for k, x in metrics(trades, equity, tf, capital).select(*METRICS).first().asDict().items()}
            c = fills.counters(done).drop("symbol").first().asDict()
            total, last = trades.agg(F.sum("pnl")).first()[0] or 0.0, equity.agg(F.max_by("equity", "i")).first()[0]
            return {"metrics": m, **c, "params": p, "intrabar": normal(intrabar) if intrabar else None, "reconciled": abs(last - capital - total) < 1e-6}, m | c, sha

        return self._run("backtest", strategy_id, version, data, params or {}, timeframe, work)

    def optimize(self, strategy_id: str, data: str, ranges: dict[str, list[float]], version: int = 0, timeframe: str = "", objective: str = "return_over_maxdd", min_trades: int = 0, most: int = 10, max_evaluations: int | None = None, top: int = 10, capital: float = 10_000.0) -> dict[str, Any]:
        def work(run_id, v, bars, tf, instrument):
            spec = search.spec_of(ranges, v["params"])
            found = search.grid_search(bars, spec, compile_source(v["signal_block"]), tf, objective, most, min_trades, max_evaluations, instrument=instrument, capital=capital)
            sha = self.artifacts.put_table(found)
            found = self.artifacts.get_table(sha)
            axes = plateau.swept_axes(found, list(ranges))
            judged = plateau.plateau(found, axes)
            win = search.best(judged).first().asDict()
            n = found.count()
            self.catalog.record_optimization(run_id, mode="grid", objective=objective, budget_json=json.dumps({"grid": spec.grid_size(most)}), comparisons=n, results_sha=sha, robustness=number(win["robustness"]), verdict=win["verdict"])
            rows = [{k: number(x) for k, x in r.asDict().items()} for r in search.top_k(found.where(F.col("score") > float("-inf")), top).collect()]
            out = {"comparisons": n, "family_comparisons": self.catalog.comparisons(self.catalog._row("strategy", strategy_id)["family"]), "best": {k: number(x) for k, x in win.items()}, "top": rows}
            return out, {"best_score": number(win["score"])}, sha

        return self._run("optimize", strategy_id, version, data, ranges, timeframe, work)

    def validate(self, strategy_id: str, data: str, ranges: dict[str, list[float]], train: int, test: int, version: int = 0, timeframe: str = "", min_trades: int = 0, anchored: bool = False, capital: float = 10_000.0) -> dict[str, Any]:
        def work(run_id, v, bars, tf, instrument):
            n = bars.count()
            geometry = (folds.anchored_folds if anchored else folds.rolling_folds)(self.spark, n, train, test)
            k = geometry.count()
            if not k:
                raise ValueError(f"{n} bars are too few for train {train} and test {test}")
            spec = search.spec_of(ranges, v["params"])
            sha = self.artifacts.put_table(folds.walk_forward(bars, geometry, spec, compile_source(v["signal_block"]), tf, min_trades, instrument=instrument, capital=capital))
            each = self.artifacts.get_table(sha)
            s = {c: number(x) for c, x in folds.summary(each, k * spec.grid_size()).first().asDict().items()}
            rows = [{c: number(x) for c, x in r.asDict().items()} for r in each.orderBy("fold").collect()]
            self.catalog.record_validation(run_id, mode="walk_forward", folds=k, efficiency=s["efficiency"], comparisons=s["comparisons"], verdict=s["verdict"], folds_json=json.dumps(rows))
            return s | {"per_fold": rows}, s, sha

        return self._run("validate", strategy_id, version, data, ranges, timeframe, work)

    def control_test(self, strategy_id: str, data: str, version: int = 0, params: dict[str, Any] | None = None, timeframe: str = "", trials: int = 5, seed: int = 0) -> dict[str, Any]:
        """Not recorded: it judges the engine and the strategy, and is no result."""
        v, (bars, tf) = self.catalog.version(strategy_id, version), self.bars_for(data, timeframe)
        instrument = Instrument(**json.loads(self.catalog.source(data)["instrument_json"]))
        runs = control.control_runs(bars, compile_source(v["signal_block"]), v["params"] | (params or {}), tf, trials, seed, instrument)
        return {k: number(x) for k, x in control.control_test(runs).drop("symbol").first().asDict().items()} | {"trials": max(1, trials), "timeframe": tf}

    def chart(self, run_id: int, limit: int = 500, offset: int = 0, most_markers: int = 200) -> dict[str, DataFrame]:
        """bars, markers and equity of a stored backtest, so that they are those of the run, finer bars and all."""
        run = self.catalog.run(run_id)
        done = self.artifacts.get_table(run["artifact_sha"])
        bars, _ = self.bars_for(run["data_name"], run["timeframe"])
        start, end = charts.window_range(bars.count(), limit, offset)
        inside = charts.trades_in(fills.trades(done), start, end, most_markers)
        return {"bars": charts.chart_window(bars, start, end), "markers": charts.markers(inside, bars), "equity": charts.thin_equity(fills.equity(done), start, end)}

    def run_history(self, strategy_id: str | None = None, kind: str | None = None, limit: int = 50) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.catalog.runs(strategy_id, kind, limit).collect()]

    def get_run(self, run_id: int) -> dict[str, Any]:
        return self.catalog.run(run_id)

    def stats(self) -> dict[str, Any]:
        files, size = self.artifacts.size()
        return self.catalog.stats() | {"root": self.root, "artifacts": files, "artifact_bytes": size, "timeframes": len(TIMEFRAMES)}
