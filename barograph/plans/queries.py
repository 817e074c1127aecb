"""Registered queries of the engine, each with DuckDB SQL where that can say the same."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.functions import columns as C
from barograph.functions.instrument import REASONS
from barograph.functions.timeframes import HOUR
from barograph.operators import bars as B
from barograph.operators import charts, control, fills, folds, plateau, quality, search, signal_table, signals
from barograph.operators import indicators as I
from barograph.operators.intervals import interval_counts
from barograph.operators.metrics import METRICS, metrics, rates
from barograph.operators.ordered import rolling
from barograph.plans import sql as S
from barograph.sources import catalog
from barograph.sources.barstore import BarStore
from barograph.sources.csv_source import SourceSpec
from barograph.sources.shared import shared_path, written
from barograph.sources.ticks import ticks_raw, ticks_walk
from barograph.streaming.bars import finish, read_ticks, run_to_end, stream_bars
from barograph.streaming.load import RANK_ERROR, load_stream

QUERIES: dict[str, Any] = {}
SQL: dict[str, str] = {}
CROSS = {"fast": 5, "slow": 20, "atr_len": 14, "stop_mult": 2.0, "rr": 1.5}
STRETCH = {"lookback": 24, "atr": 24, "entry_z": 1.5, "stop_mult": 2.0, "capture": 0.8, "min_target": 0.5, "from_hour": 22, "to_hour": 6}
FIXED = {"atr_len": 14, "stop_mult": 2.0, "rr": 1.5}
SPEC = search.spec_of({"fast": [5, 15, 5], "slow": [20, 40, 10]}, FIXED)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def bar_out(df: DataFrame) -> DataFrame:
    return r6(df.select("symbol", "ms", "open", "high", "low", "close", "volume", "spread", "spread_max"), "open", "high", "low", "close", "spread", "spread_max")


def walk_bars(spark: SparkSession, d: str, tf: str = "H1") -> DataFrame:
    return B.with_index(B.bars_from_ticks(ticks_walk(spark, d), tf))


H1 = S.with_(S.WALK, S.bars("h1", "ticks_walk", "H1"))
REC = lambda *parts: S.with_(S.WALK, S.bars("h1", "ticks_walk", "H1"), *parts, recursive=True)


# --- bars
def _bars(tf: str):
    def f(spark, d):
        return bar_out(B.bars_from_ticks(ticks_walk(spark, d), tf))

    f.__name__ = f"bars_{tf.lower()}"
    query(S.with_(S.WALK, S.bars("b", "ticks_walk", tf)) + f"SELECT {S.BAR_OUT} FROM b")(f)


for _tf in ("M1", "M15", "H1", "D1", "W1"):
    _bars(_tf)


@query(S.with_(S.RAW, S.bars("b", "ticks_raw", "H1")) + f"SELECT {S.BAR_OUT} FROM b")
def bars_by_symbol_h1(spark, d):
    return bar_out(B.bars_from_ticks(ticks_raw(spark, d), "H1"))


@query(S.with_(S.WALK, S.bars("m15", "ticks_walk", "M15"), S.rolled("h4", "m15", "H4")) + f"SELECT {S.BAR_OUT} FROM h4")
def rollup_m15_to_h4(spark, d):
    return bar_out(B.roll_up(B.bars_from_ticks(ticks_walk(spark, d), "M15"), "H4", "M15"))


@query(S.with_(S.RAW, S.bars("h4", "ticks_raw", "H4")) + f"SELECT {S.BAR_OUT} FROM h4")
def rollup_equals_direct(spark, d):
    """H4 bars by way of M15 ones, against SQL that makes them from ticks."""
    return bar_out(B.roll_up(B.bars_from_ticks(ticks_raw(spark, d), "M15"), "H4", "M15"))


@query(H1 + "SELECT symbol, i - 100 AS i, ms, round(close, 6) AS close FROM h1 WHERE i >= 100 AND i < 200")
def bar_slice(spark, d):
    return r6(B.slice_bars(walk_bars(spark, d), 100, 200).select("symbol", "i", "ms", "close"), "close")


FROM_MS, TO_MS = 1_704_672_000_000, 1_705_276_800_000


@query(S.with_(S.RAW, S.bars("h1", "ticks_raw", "H1")) + f"SELECT {S.BAR_OUT} FROM h1 WHERE ms >= {FROM_MS} AND ms < {TO_MS} AND symbol <> 'view'")
def stored_bars_slice(spark, d):
    """A week of hourly bars of some symbols, from stored M15 bars and what is derived from them."""
    store, symbols = BarStore(spark, shared_path(spark, "bars")), [r.symbol for r in ticks_raw(spark, d).where("symbol <> 'view'").select("symbol").distinct().collect()]
    store.put(B.bars_from_ticks(ticks_raw(spark, d), "M15"), "M15")
    store.derived("M15", "H1")
    return bar_out(store.read("H1", FROM_MS, TO_MS, symbols))


@query(
    S.with_(S.RAW, "w AS (SELECT DISTINCT symbol, ms // 3600000 * 3600000 AS start_ms FROM ticks_raw)")
    + "SELECT w.symbol, start_ms, count(*) AS ticks FROM w JOIN ticks_raw t ON t.symbol = w.symbol AND t.ms >= start_ms AND t.ms < start_ms + 21600000 + start_ms // 3600000 % 5 * 1000000 GROUP BY ALL"
)
def window_tick_counts(spark, d):
    """Ticks in windows of several lengths that begin at each hour and overlap."""
    t = ticks_raw(spark, d).select("symbol", "ms")
    starts = t.select("symbol", C.bucket(F.col("ms"), "H1").alias("start_ms")).distinct()
    windows = starts.withColumn("stop_ms", F.col("start_ms") + 21_600_000 + F.floor(F.col("start_ms") / 3_600_000) % 5 * 1_000_000)
    return interval_counts(t, windows, "ms", "start_ms", "stop_ms", ["symbol"], HOUR, "ticks").select("symbol", "start_ms", "ticks")


@query(S.with_(S.WALK) + "SELECT max(length(regexp_extract(cast(bid AS varchar), '\\.([^.]*)$', 1)))::int AS decimals FROM ticks_walk")
def detect_decimals(spark, d):
    return quality.decimals(ticks_walk(spark, d), ["bid"])


@query(S.with_(S.RAW) + "SELECT symbol, seq, cast(round_even(bid * 1000, 0) AS bigint) AS bid_units, round(round_even(bid * 1000, 0) / 1000.0, 6) AS bid FROM ticks_raw")
def scaled_prices(spark, d):
    from barograph.sources.csv_source import descaled, scaled

    t = ticks_raw(spark, d).withColumn("bid_units", scaled(F.col("bid"), 1000))
    return t.select("symbol", "seq", "bid_units", F.round(descaled(F.col("bid_units"), 1000), 6).alias("bid"))


# --- quality
GAPS = "g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY symbol ORDER BY ms, seq) AS gap, ms - lag(ms) OVER (PARTITION BY symbol ORDER BY seq) AS step FROM ticks_raw)"
ISLANDS = """isl AS (SELECT symbol, max(n) AS max_duplicate_run FROM (SELECT symbol, k, count(*) FILTER (WHERE gap = 0) AS n
  FROM (SELECT *, sum(CASE WHEN gap = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ms, seq) AS k FROM g) GROUP BY symbol, k) GROUP BY symbol)"""


@query(
    S.with_(S.RAW, GAPS, ISLANDS)
    + """SELECT symbol, count(*) AS rows, min(ms) AS first_ms, max(ms) AS last_ms, count(*) FILTER (WHERE step < 0) AS out_of_order, count(*) FILTER (WHERE gap = 0) AS duplicate_timestamps,
    count(*) FILTER (WHERE ask < bid) AS negative_spread, count(*) FILTER (WHERE ask = bid) AS zero_spread, count(*) FILTER (WHERE bid <= 0) + count(*) FILTER (WHERE ask <= 0) AS bad_price,
    round(avg(ask - bid), 6) AS spread_mean, round(quantile_cont(ask - bid, 0.5), 6) AS spread_p50, round(quantile_cont(ask - bid, 0.99), 6) AS spread_p99, any_value(max_duplicate_run) AS max_duplicate_run
    FROM g JOIN isl USING (symbol) GROUP BY symbol"""
)
def quality_report(spark, d):
    return r6(quality.quality_report(ticks_raw(spark, d)).drop("largest_gaps_ms"), "spread_mean", "spread_p50", "spread_p99")


@query(S.with_(S.RAW.replace("epoch_us(ts) // 1000 AS ms", "epoch_us(ts) // 1000 // 60000 * 60000 AS ms"), GAPS, ISLANDS) + "SELECT * FROM isl")
def duplicate_runs(spark, d):
    t = ticks_raw(spark, d).withColumn("ms", C.bucket(F.col("ms"), "M1"))
    return quality.repeats(t).select("symbol", F.col("n").alias("max_duplicate_run"))


@query(S.with_(S.RAW, GAPS) + "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY gap DESC) AS rank, gap FROM g WHERE gap IS NOT NULL QUALIFY rank <= 5")
def top_gaps(spark, d):
    return quality.top_gaps(ticks_raw(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(
    S.with_(S.RAW.replace("epoch_us(ts) // 1000 AS ms", "epoch_us(ts) // 1000 // 60000 * 60000 AS ms"), GAPS, "n AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL)")
    + "SELECT symbol, first(gap ORDER BY n DESC, gap) AS resolution_ms FROM n GROUP BY symbol"
)
def resolution_mode(spark, d):
    return quality.resolution(ticks_raw(spark, d).withColumn("ms", C.bucket(F.col("ms"), "M1")))


#: A Monday's midnight, and a week, in milliseconds.
MONDAY, WEEK_MS = 4 * 86_400_000, 7 * 86_400_000
PRESSED = S.RAW.replace("epoch_us(ts) // 1000 AS ms", "e - (e - 345600000) % 604800000 + (e - 345600000) % 604800000 * 5 // 7 AS ms").replace("FROM events", "FROM (SELECT *, epoch_us(ts) // 1000 AS e FROM events)")
OFFSET = lambda raw: (
    S.with_(raw, GAPS)
    + """SELECT symbol, round_even((CASE WHEN h > 12 THEN h - 24 WHEN h < -12 THEN h + 24 ELSE h END) * 4, 0) / 4 AS utc_offset_hours
    FROM (SELECT symbol, quantile_cont((ms % 86400000) / 3600000.0::double, 0.5) FILTER (WHERE gap > 86400000) - 22 AS h
          FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY gap DESC, ms DESC) AS p FROM g WHERE gap IS NOT NULL) WHERE p <= 12 GROUP BY symbol)"""
)


@query(OFFSET(PRESSED))
def utc_offset_infer(spark, d):
    """All ticks, with each week pressed into its first five days, so that there are weekend gaps to tell the clock from."""
    t = ticks_raw(spark, d)
    into = F.pmod(F.col("ms") - MONDAY, F.lit(WEEK_MS))
    return quality.utc_offset(t.withColumn("ms", F.col("ms") - into + F.floor(into * 5 / 7)))


@query(OFFSET(S.RAW))
def utc_offset_all(spark, d):
    """The ticks as they are. Null for a symbol that is never still for a day."""
    return quality.utc_offset(ticks_raw(spark, d))


# --- windows and recursions
@query(H1 + "SELECT symbol, i, round(CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END, 6) AS sma FROM h1 WINDOW w AS (ORDER BY i ROWS 19 PRECEDING)")
def sma_20(spark, d):
    return I.with_sma(walk_bars(spark, d), 20).select("symbol", "i", F.round("sma", 6).alias("sma"))


@query(H1 + "SELECT symbol, i, round(greatest(high - low, abs(high - pc), abs(low - pc)), 6) AS tr FROM (SELECT *, lag(close) OVER (ORDER BY i) AS pc FROM h1)")
def true_range(spark, d):
    return I.with_true_range(walk_bars(spark, d)).select("symbol", "i", F.round("tr", 6).alias("tr"))


@query(H1 + "SELECT symbol, i, round(max(close) OVER (ORDER BY i) - close, 6) AS dd FROM h1")
def drawdown(spark, d):
    return I.with_drawdown(walk_bars(spark, d)).select("symbol", "i", F.round("dd", 6).alias("dd"))


@query(H1 + "SELECT symbol, i, round((close - p) / greatest(p, 1e-9), 9) AS ret FROM (SELECT *, lag(close) OVER (ORDER BY i) AS p FROM h1)")
def bar_returns(spark, d):
    return I.with_returns(walk_bars(spark, d)).select("symbol", "i", F.round("ret", 9).alias("ret"))


@query(H1 + "SELECT round(corr(r, p), 6) AS autocorrelation FROM (SELECT r, lag(r) OVER (ORDER BY i) AS p FROM (SELECT i, ln(close) - ln(lag(close) OVER (ORDER BY i)) AS r FROM h1))")
def lag1_autocorr(spark, d):
    change = lambda k: lambda w: C.ln(F.lag("close", k).over(w)) - C.ln(F.lag("close", k + 1).over(w))
    r = rolling(walk_bars(spark, d), ["symbol"], "i", 3, {"r": change(0), "p": change(1)})
    return r.agg(F.round(C.correlation(F.col("r"), F.col("p")), 6).alias("autocorrelation"))


def _indicator(name: str, kind: str, n: int, ctes: tuple[str, ...], value: str, source: str):
    def f(spark, d):
        return I.recursive(walk_bars(spark, d), {"v": (kind, n)}).select("symbol", "i", F.round("v", 6).alias("v"))

    f.__name__ = name
    query(REC(*ctes) + f"SELECT h1.symbol, h1.i, round({value}, 6) AS v FROM h1 LEFT JOIN {source} USING (i)")(f)


_indicator("ema_20", "ema", 20, (S.ema("e", "h1", 20),), "e.v", "e")
_indicator("rma_14", "rma", 14, (S.seeded("e", "h1", "close", "(1.0::double / 14)", 14),), "e.v", "e")
_indicator("atr_14", "atr", 14, (S.TR, S.atr(14)), "atr.v", "atr")
_indicator("rsi_14", "rsi", 14, (S.TR, S.seeded("g", "tr", "gain", "(1.0::double / 14)", 14, 1), S.seeded("l", "tr", "loss", "(1.0::double / 14)", 14, 1), "r AS (SELECT i, CASE WHEN l.v = 0 THEN 100 WHEN g.v = 0 THEN 0 ELSE 100 - 100 / (1 + g.v / l.v) END AS v FROM g JOIN l USING (i))"), "r.v", "r")


@query(REC(S.ema("e", "h1", 20)) + "SELECT h1.symbol, h1.i, round(e.v, 6) AS v FROM h1 LEFT JOIN e USING (i)")
def ema_20_scan(spark, d):
    """By blocks, windows and joins instead of the kernel."""
    return I.seeded_scan(walk_bars(spark, d), "close", 2.0 / 21, 20, "v").select("symbol", "i", F.round("v", 6).alias("v"))


# --- signals
SIG_OUT = "symbol, i, long_entry, short_entry, round(stop_distance, 6) AS stop_distance, round(target_distance, 6) AS target_distance"
CROSS_CTES = (S.TR, S.ema("f", "h1", 5), S.ema("s", "h1", 20), S.atr(14), S.crosses("sig", "f", "s", 2.0, 1.5))


def sig_out(df):
    return r6(df.select("symbol", "i", "long_entry", "short_entry", "stop_distance", "target_distance"), "stop_distance", "target_distance")


@query(REC(*CROSS_CTES) + f"SELECT {SIG_OUT} FROM sig")
def ema_cross_signals(spark, d):
    return sig_out(signals.ema_cross(walk_bars(spark, d), CROSS))


@query(REC(*CROSS_CTES) + f"SELECT {SIG_OUT} FROM sig")
def ema_cross_udtf(spark, d):
    """The same signals from SQL, by a table function over the bars."""
    name = signal_table.register(spark)
    walk_bars(spark, d).createOrReplaceTempView("barograph_bars")
    return sig_out(spark.sql(f"SELECT * FROM {name}(TABLE(barograph_bars), 'ema_cross', '{json.dumps(CROSS)}')"))


@query(
    REC(
        S.TR, S.atr(24),
        """z AS (SELECT symbol, i, ms, coalesce(v > 0 AND basis IS NOT NULL, false) AS good, CASE WHEN v > 0 AND basis IS NOT NULL THEN v ELSE 1.0 END AS safe, close - basis AS away, (ms // 3600000) % 24 AS hr
          FROM (SELECT h1.*, a.v, CASE WHEN count(*) OVER w = 24 THEN avg(close) OVER w END AS basis FROM h1 LEFT JOIN atr a USING (i) WINDOW w AS (ORDER BY h1.i ROWS 23 PRECEDING)))""",
    )
    + """SELECT symbol, i, coalesce(away / safe < -1.5 AND (hr >= 22 OR hr < 6) AND good, false) AS long_entry, coalesce(away / safe > 1.5 AND (hr >= 22 OR hr < 6) AND good, false) AS short_entry,
    round(safe * 2.0, 6) AS stop_distance, round(CASE WHEN away IS NOT NULL THEN greatest(abs(away) * 0.8, safe * 0.5) END, 6) AS target_distance FROM z"""
)
def stretch_signals(spark, d):
    return sig_out(signals.stretch(walk_bars(spark, d), STRETCH))


@query(H1 + "SELECT symbol, i, ((ms // 3600000) % 24 >= 22 OR (ms // 3600000) % 24 < 6) AS night, ((ms // 3600000) % 24 >= 8 AND (ms // 3600000) % 24 < 17) AS day FROM h1")
def session_hours(spark, d):
    return walk_bars(spark, d).select("symbol", "i", C.in_hours(F.col("ms"), 22, 6).alias("night"), C.in_hours(F.col("ms"), 8, 17).alias("day"))


# --- joins
@query(S.with_(S.WALK, S.bars("h1", "ticks_walk", "H1"), S.bars("m15", "ticks_walk", "M15")) + "SELECT h.symbol, h.i, m.ms AS sub_ms, round(m.close, 6) AS close FROM h1 h JOIN m15 m ON m.ms >= h.ms AND m.ms < h.ms + 3600000")
def subbar_alignment(spark, d):
    a = B.align_subbars(walk_bars(spark, d), walk_bars(spark, d, "M15"), 3_600_000)
    return r6(a.select("symbol", "i", F.col("ms").alias("sub_ms"), "close"), "close")


TOUCH = (
    H1
    + """SELECT e.symbol, e.i AS entry_i, e.direction, (SELECT min(b.i) FROM h1 b WHERE b.i > e.i AND (CASE WHEN e.direction > 0 THEN b.low <= e.close - 2 OR b.high >= e.close + 3 ELSE b.high >= e.close + 2 OR b.low <= e.close - 3 END)) AS exit_i
    FROM (SELECT *, CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS direction FROM h1) e"""
)


@query(TOUCH)
def first_touch(spark, d):
    """Every bar as an entry."""
    b = walk_bars(spark, d)
    return touches(b, b)


@query(TOUCH)
def first_touch_all(spark, d):
    """The same under its earlier name, which tests hold against a plain loop, too."""
    return first_touch(spark, d)


def touches(b: DataFrame, at: DataFrame) -> DataFrame:
    """Entries at the close of the bars ``at``, long on even and short on odd ones: stop 2 and target 3 away."""
    side = F.when(F.col("i") % 2 == 0, 1).otherwise(-1)
    e = at.select("symbol", F.col("i").alias("entry_i"), side.alias("direction"), (F.col("close") - 2 * side).alias("stop"), (F.col("close") + 3 * side).alias("target"))
    return fills.first_touch(b, e).select("symbol", "entry_i", "direction", "exit_i")


# --- runs
RUN_SIG = "run AS (SELECT 0 AS run, * FROM sig)"
RUN_CTES = (*CROSS_CTES, RUN_SIG, S.simulation("st", "run"))
TRADE_NUMBERS = "entry_px, exit_px, lots, pnl, r_multiple"


def cross_run(spark, d, sub: str = "", **kw):
    b = walk_bars(spark, d)
    finer = walk_bars(spark, d, sub) if sub else None
    return fills.backtest(signals.ema_cross(b, CROSS), sub=finer, bar_ms=3_600_000, **kw)


@query(REC(*RUN_CTES) + f"SELECT k, entry_i, exit_i, direction, exit_reason, {S.rounded(TRADE_NUMBERS)} FROM trades")
def backtest_trades(spark, d):
    t = fills.trades(cross_run(spark, d))
    return r6(t.select("k", "entry_i", "exit_i", "direction", "exit_reason", *TRADE_NUMBERS.split(", ")), *TRADE_NUMBERS.split(", "))


@query(REC(*RUN_CTES) + "SELECT i, round(equity, 6) AS equity FROM curve")
def backtest_equity(spark, d):
    return r6(fills.equity(cross_run(spark, d)).select("i", "equity"), "equity")


@query(REC(*RUN_CTES) + "SELECT i, round(equity, 6) AS equity FROM curve")
def equity_from_trades(spark, d):
    return r6(fills.equity_of(walk_bars(spark, d), fills.trades(cross_run(spark, d))).select("i", "equity"), "equity")


@query(REC(*RUN_CTES, S.metrics_cte("H1")) + f"SELECT {S.rounded(', '.join(m for m in METRICS if m not in ('n_trades', 'max_consecutive_losses')))}, n_trades, max_consecutive_losses FROM m")
def backtest_metrics(spark, d):
    run = cross_run(spark, d)
    m = metrics(fills.trades(run), fills.equity(run), "H1").select(*METRICS)
    return r6(m, *[c for c in METRICS if c not in ("n_trades", "max_consecutive_losses")])


TIGHT = CROSS | {"stop_mult": 0.15, "rr": 1.0}


@query()
def intrabar_trades(spark, d):
    """Narrow levels on D1 bars, settled by M15 bars; tests hold it against a plain loop."""
    b = walk_bars(spark, d, "H4")
    run = fills.backtest(signals.ema_cross(b, TIGHT), sub=walk_bars(spark, d, "M15"), bar_ms=14_400_000)
    return r6(fills.trades(run).drop("symbol"), *TRADE_NUMBERS.split(", "))


@query()
def intrabar_rates(spark, d):
    b = walk_bars(spark, d, "H4")
    run = fills.backtest(signals.ema_cross(b, TIGHT), sub=walk_bars(spark, d, "M15"), bar_ms=14_400_000)
    return r6(rates(fills.counters(run), fills.trades(run)), "ambiguity_rate", "resolution_rate")


# --- sweeps
@query("SELECT row_number() OVER (ORDER BY f, s) - 1 AS ord, f AS fast, s AS slow, 14 AS atr_len, 2.0::double AS stop_mult, 1.5::double AS rr FROM generate_series(5, 15, 5) a(f), generate_series(20, 40, 10) b(s)")
def grid_params(spark, d):
    return search.grid(spark, SPEC).select("ord", F.col("fast").cast("long"), F.col("slow").cast("long"), "atr_len", "stop_mult", "rr")


@query()
def random_search_params(spark, d):
    return search.sample(spark, search.ParamSpec({"fast": search.IntAxis(5, 30), "z": search.FloatAxis(0.5, 3.0, 0.25), "side": search.ChoiceAxis(("both", "long", "short"))}), 50, 7)


PERIODS = ", ".join(f"SELECT i, v, {n} AS n FROM e{n}" for n in (5, 10, 15, 20, 30, 40)).replace(", SELECT", " UNION ALL SELECT")
GRID_CTES = (
    S.TR, S.atr(14), *[S.ema(f"e{n}", "h1", n) for n in (5, 10, 15, 20, 30, 40)], f"emas AS ({PERIODS})",
    "cfg AS (SELECT row_number() OVER (ORDER BY f, s) - 1 AS run, f, s FROM generate_series(5, 15, 5) a(f), generate_series(20, 40, 10) b(s))",
    """sig AS (SELECT *, coalesce(above AND NOT was AND warm, false) AS long_entry, coalesce(NOT above AND was AND warm, false) AS short_entry, sd AS stop_distance, sd * 1.5 AS target_distance
      FROM (SELECT *, lag(above) OVER (PARTITION BY run ORDER BY i) AS was FROM (
        SELECT h1.*, cfg.run, coalesce(f.v > s.v, false) AS above, f.v IS NOT NULL AND s.v IS NOT NULL AND a.v IS NOT NULL AS warm, coalesce(a.v, 0) * 2.0 AS sd
        FROM h1 CROSS JOIN cfg LEFT JOIN emas f ON f.i = h1.i AND f.n = cfg.f LEFT JOIN emas s ON s.i = h1.i AND s.n = cfg.s LEFT JOIN atr a ON a.i = h1.i)))""",
    S.simulation("st", "sig"), S.metrics_cte("H1"), "ev AS (SELECT run AS ord, f AS fast, s AS slow, m.*, net_profit / max_drawdown AS score FROM m JOIN cfg USING (run))",
)


def evaluations(spark, d):
    return search.grid_search(walk_bars(spark, d), SPEC, signals.ema_cross_arrays, "H1").withColumns({c: F.col(c).cast("long") for c in ("fast", "slow")})


@query(REC(*GRID_CTES) + f"SELECT ord, fast, slow, n_trades, {S.rounded('net_profit, max_drawdown, sharpe, score')} FROM ev")
def grid_search_scores(spark, d):
    return r6(evaluations(spark, d).select("ord", "fast", "slow", "n_trades", "net_profit", "max_drawdown", "sharpe", "score"), "net_profit", "max_drawdown", "sharpe", "score")


@query(REC(*GRID_CTES) + "SELECT ord, round(score, 6) AS score FROM ev ORDER BY ev.score DESC, ord LIMIT 5")
def grid_top_k(spark, d):
    return r6(search.top_k(evaluations(spark, d), 5).select("ord", "score"), "score")


OBJECTIVES = [o for o in search.OBJECTIVES if o != "return_over_maxdd"]


@query(REC(*GRID_CTES) + f"SELECT ord, {S.rounded(', '.join(OBJECTIVES))}, round(score, 6) AS return_over_maxdd FROM ev")
def objectives_all(spark, d):
    e = evaluations(spark, d)
    return e.select("ord", *[C.plain(search.score(o)).alias(o) for o in search.OBJECTIVES])


PLATEAU = """rk AS (SELECT *, dense_rank() OVER (ORDER BY fast) AS a, dense_rank() OVER (ORDER BY slow) AS b FROM ev),
nb AS (SELECT x.ord, count(*) AS n, avg(y.score) AS mean, min(y.score) AS least, coalesce(stddev_samp(y.score), 0) AS sd FROM rk x JOIN rk y ON abs(x.a - y.a) + abs(x.b - y.b) = 1 GROUP BY x.ord),
pl AS (SELECT ev.ord, ev.score, n, mean, least, sd, CASE WHEN ev.score > 0 THEN mean / ev.score END AS robustness FROM ev JOIN nb USING (ord))"""


@query(
    REC(*GRID_CTES, PLATEAU)
    + """SELECT ord, round(score, 6) AS score, n AS n_neighbours, round(mean, 6) AS neighbour_mean, round(least, 6) AS neighbour_min, round(sd, 6) AS neighbour_std, round(robustness, 6) AS robustness,
    CASE WHEN score <= 0 THEN 'unscored: the peak isn''t positive' WHEN robustness >= 0.9 THEN 'flat' WHEN robustness >= 0.7 THEN 'plateau' WHEN robustness >= 0.4 THEN 'slope' ELSE 'spike' END AS verdict FROM pl"""
)
def plateau_report(spark, d):
    p = plateau.plateau(evaluations(spark, d).select("ord", "fast", "slow", "score"), ["fast", "slow"])
    return r6(p.drop("fast", "slow"), "score", "neighbour_mean", "neighbour_min", "neighbour_std", "robustness")


@query(REC(*GRID_CTES, PLATEAU) + "SELECT ord, round(score, 6) AS score, coalesce(robustness >= 0.7, false) AS robust, row_number() OVER (ORDER BY coalesce(robustness >= 0.7, false) DESC, pl.score DESC, ord) AS place FROM (SELECT * FROM pl ORDER BY pl.score DESC, ord LIMIT 5) pl")
def rank_by_robustness(spark, d):
    from pyspark.sql import Window

    r = plateau.rank_by_robustness(evaluations(spark, d).select("ord", "fast", "slow", "score"), ["fast", "slow"], 5)
    place = F.row_number().over(Window.orderBy(F.desc("robust"), F.desc("score"), "ord")).cast("long")  # five rows
    return r.select("ord", F.round("score", 6).alias("score"), "robust", place.alias("place"))


# --- folds
def _folds_sql(anchored: bool) -> str:
    start = "0" if anchored else "k * 100"
    return f"SELECT k::int AS fold, {start}::bigint AS train_start, k * 100 + 300 AS train_end, k * 100 + 310 AS test_start, k * 100 + 410 AS test_end FROM generate_series(0, 100) g(k) WHERE k * 100 + 410 <= (SELECT count(DISTINCT epoch_ms(ts) // 3600000) FROM events)"


@query(_folds_sql(False))
def rolling_folds(spark, d):
    return folds.rolling_folds(spark, walk_bars(spark, d).count(), 300, 100, embargo=10)


@query(_folds_sql(True))
def anchored_folds(spark, d):
    return folds.anchored_folds(spark, walk_bars(spark, d).count(), 300, 100, embargo=10)


@query(
    H1
    + """, n AS (SELECT count(*) AS n FROM h1), f AS (SELECT k::int AS fold, round_even(k * n / 5.0::double, 0)::bigint AS a, round_even((k + 1) * n / 5.0::double, 0)::bigint AS b, n FROM generate_series(0, 4) g(k), n)
    SELECT fold, count(*) AS bars FROM f JOIN h1 ON NOT (i >= greatest(0, a - 30) AND i < least(n, b + 10)) GROUP BY fold"""
)
def purged_mask(spark, d):
    b = written(walk_bars(spark, d), "bars")
    n = b.count()
    return folds.trained_bars(b, folds.purged_kfold(spark, n, 5), n, 30, 10)


@query(REC(*RUN_CTES, "fo AS (SELECT k::int AS fold, k * 100 + 300 AS a, k * 100 + 400 AS b FROM generate_series(0, 100) g(k) WHERE k * 100 + 400 <= (SELECT count(*) FROM h1))") + "SELECT fold, k FROM trades t JOIN fo ON t.entry_i >= fo.a AND t.entry_i < fo.b")
def trade_attribution(spark, d):
    f = folds.rolling_folds(spark, walk_bars(spark, d).count(), 300, 100)
    return folds.attribute(fills.trades(cross_run(spark, d)), f).select("fold", "k")


@query(REC(*RUN_CTES) + "SELECT ceil(quantile_cont(exit_i - entry_i, 0.99))::bigint AS purge FROM trades")
def purge_width(spark, d):
    return folds.purge_width(fills.trades(cross_run(spark, d)))


@query()
def walk_forward(spark, d):
    b = written(walk_bars(spark, d), "bars")
    f = folds.rolling_folds(spark, b.count(), 300, 100)
    out = folds.walk_forward(b, f, SPEC, signals.ema_cross_arrays, "H1")
    return out.select("fold", "ord", C.plain(F.col("train_score")).alias("train_score"), C.plain(F.col("test_score")).alias("test_score"), "n_trades")


@query()
def walk_forward_summary(spark, d):
    b = written(walk_bars(spark, d), "bars")
    f = folds.rolling_folds(spark, b.count(), 300, 100)
    s = folds.summary(folds.walk_forward(b, f, SPEC, signals.ema_cross_arrays, "H1"))
    return s.withColumns({c: C.plain(F.col(c)) for c in ("mean_oos_score", "efficiency")})


@query()
def control_shuffle(spark, d):
    runs = control.control_runs(walk_bars(spark, d), signals.ema_cross_arrays, CROSS, "H1", 5, 0)
    return control.control_test(runs)


# --- catalogue
def lit(spark, name: str) -> DataFrame:
    columns, rows = S.LITERALS[name]
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


LIB = S.with_(*[S.literal(n) for n in S.LITERALS])
LIBR = S.with_(*[S.literal(n) for n in S.LITERALS], "tree AS (SELECT strategy_id, version, parent_version, 0 AS level, version::varchar AS path FROM version WHERE parent_version IS NULL UNION ALL SELECT v.strategy_id, v.version, v.parent_version, t.level + 1, t.path || '/' || v.version FROM tree t JOIN version v ON v.strategy_id = t.strategy_id AND v.parent_version = t.version)", recursive=True)


@query(LIB + "SELECT run_id, strategy_id, version, s.name AS strategy_name, family, data_name, o.kind AS data_kind, r.kind AS kind FROM run r JOIN version v USING (version_pk) JOIN strategy s USING (strategy_id) JOIN source o ON o.name = r.data_name WHERE r.kind = 'backtest' ORDER BY run_id DESC LIMIT 2")
def run_history(spark, d):
    h = catalog.run_history(*(lit(spark, n) for n in ("run", "version", "strategy", "source")))
    return h.where("kind = 'backtest'").orderBy(F.desc("run_id")).limit(2).select("run_id", "strategy_id", "version", "strategy_name", "family", "data_name", "data_kind", "kind")


@query(
    LIB
    + """SELECT strategy_id, (SELECT count(*) FROM version v WHERE v.strategy_id = s.strategy_id) AS versions, (SELECT count(*) FROM run r JOIN version v USING (version_pk) WHERE v.strategy_id = s.strategy_id) AS runs,
    (SELECT max(started_at)::double FROM run r JOIN version v USING (version_pk) WHERE v.strategy_id = s.strategy_id) AS last_run_at FROM strategy s WHERE NOT archived"""
)
def strategy_activity(spark, d):
    a = catalog.strategy_activity(*(lit(spark, n) for n in ("strategy", "version", "run"))).where("not archived")
    return a.select("strategy_id", "versions", "runs", F.col("last_run_at").cast("double").alias("last_run_at"))


@query(LIB + "SELECT family, count(*) AS sweeps, sum(comparisons)::bigint AS comparisons FROM optimization JOIN run USING (run_id) JOIN version USING (version_pk) JOIN strategy USING (strategy_id) GROUP BY family")
def family_comparisons(spark, d):
    return catalog.family_comparisons(*(lit(spark, n) for n in ("strategy", "version", "run", "optimization")))


@query(LIBR + "SELECT * FROM tree")
def version_tree(spark, d):
    return catalog.version_tree(lit(spark, "version"))


@query(
    LIB
    + """SELECT (SELECT count(*) FROM source) AS data_sources, (SELECT count(*) FROM strategy WHERE NOT archived) AS strategies, (SELECT count(*) FROM strategy WHERE archived) AS archived, (SELECT count(*) FROM version) AS versions,
    (SELECT count(*) FROM run) AS runs, (SELECT count(*) FROM run WHERE kind = 'backtest') AS backtests, (SELECT count(*) FROM run WHERE kind = 'optimize') AS optimizations, (SELECT count(*) FROM run WHERE kind = 'validate') AS validations"""
)
def library_stats(spark, d):
    return catalog.library_stats(*(lit(spark, n) for n in ("source", "strategy", "version", "run")))


# --- charts
@query(H1 + ", n AS (SELECT count(*) AS n FROM h1) SELECT symbol, i, ms, round(close, 6) AS close FROM h1, n WHERE i >= n - 50 - 200 AND i < n - 50")
def chart_window(spark, d):
    b = walk_bars(spark, d)
    return r6(charts.chart_window(b, *charts.window_range(b.count(), 200, 50)).select("symbol", "i", "ms", "close"), "close")


LABELS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in REASONS.items())


@query(
    REC(*RUN_CTES)
    + f"""SELECT k, b.ms, 'entry' AS kind, round(entry_px, 6) AS price, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS label FROM trades t JOIN h1 b ON b.i = t.entry_i
    UNION ALL SELECT k, b.ms, 'exit', round(exit_px, 6), CASE exit_reason {LABELS} END FROM trades t JOIN h1 b ON b.i = t.exit_i"""
)
def trade_markers(spark, d):
    return r6(charts.markers(fills.trades(cross_run(spark, d)), walk_bars(spark, d)).select("k", "ms", "kind", "price", "label"), "price")


@query(REC(*RUN_CTES) + "SELECT i, round(equity, 6) AS equity FROM curve WHERE i >= 0 AND i < (SELECT count(*) FROM h1) AND i % greatest(1, (SELECT count(*) FROM h1) // 100) = 0")
def equity_downsample(spark, d):
    e = fills.equity(cross_run(spark, d))
    return r6(charts.thin_equity(e, 0, walk_bars(spark, d).count(), 100).select("i", "equity"), "equity")


# --- streaming
@query(S.with_(S.RAW, S.bars("b", "ticks_raw", "H1")) + f"SELECT {S.BAR_OUT} FROM b")
def stream_bars_h1(spark, d):
    """Ticks as a stream of files, bars in append mode, and what the watermark held back."""
    at = shared_path(spark, "stream")
    ticks_raw(spark, d).repartitionByRange(4, "ms").sortWithinPartitions("ms").write.parquet(f"{at}/ticks")
    run_to_end(spark, stream_bars(read_ticks(spark, f"{at}/ticks"), "H1", "1 hour"), f"{at}/bars", f"{at}/checkpoint")
    return bar_out(finish(spark, spark.read.parquet(f"{at}/ticks"), f"{at}/bars", "H1"))


#: Ticks of a CSV file that is streamed, and micro-batches that all files are read in.
FILE_TICKS, STREAM_BATCHES = 1_000_000, 16


def csv_stream(spark, d, **kw):
    """All ticks as CSV files in time order, loaded as a stream: see ``streaming.load``. Files and batches grow with the ticks."""
    at, t = shared_path(spark, "csv"), ticks_raw(spark, d)
    t = t.repartitionByRange(max(4, t.count() // FILE_TICKS), "ms").sortWithinPartitions("ms", "seq")
    t.select(F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), "symbol", "bid", "ask").write.csv(f"{at}/ticks", header=True)
    return load_stream(spark, f"{at}/ticks", "H1", SourceSpec(symbol_col="symbol"), at=f"{at}/load", range_bytes=1 << 18, batch_ranges=8, batches=STREAM_BATCHES, **kw)


@query(S.with_(S.RAW, S.bars("b", "ticks_raw", "H1")) + f"SELECT {S.BAR_OUT} FROM b")
def stream_csv_bars_h1(spark, d):
    """Bars of a CSV stream whose batches end anywhere in the files."""
    return bar_out(csv_stream(spark, d, with_quality=False).bars)


STREAM_COUNTS = "symbol, rows, first_ms, last_ms, out_of_order, duplicate_timestamps, negative_spread, zero_spread, bad_price, max_duplicate_run"


@query(
    S.with_(S.RAW, "g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY symbol ORDER BY ms, seq) AS gap FROM ticks_raw)", ISLANDS)
    + """SELECT symbol, count(*) AS rows, min(ms) AS first_ms, max(ms) AS last_ms, 0::bigint AS out_of_order, count(*) FILTER (WHERE gap = 0) AS duplicate_timestamps,
    count(*) FILTER (WHERE ask < bid) AS negative_spread, count(*) FILTER (WHERE ask = bid) AS zero_spread, count(*) FILTER (WHERE bid <= 0) + count(*) FILTER (WHERE ask <= 0) AS bad_price,
    any_value(max_duplicate_run) AS max_duplicate_run, round(avg(ask - bid), 6) AS spread_mean, max(gap) AS largest_gap_ms, true AS p50_near, true AS p99_near FROM g JOIN isl USING (symbol) GROUP BY symbol"""
)
def stream_csv_quality(spark, d):
    """Quality of the same stream. The quantiles of its sketches are held against the ranks of all ticks: p50_near, p99_near."""
    told = csv_stream(spark, d).quality
    spreads = ticks_raw(spark, d).select("symbol", (F.col("ask") - F.col("bid")).alias("x"))
    share = lambda c, below: F.avg((F.col("x") < F.col(c) if below else F.col("x") <= F.col(c)).cast("double"))
    near = lambda c, q: (share(c, True) <= q + RANK_ERROR) & (share(c, False) >= q - RANK_ERROR)
    held = spreads.join(told.select("symbol", "spread_p50", "spread_p99"), "symbol").groupBy("symbol").agg(near("spread_p50", 0.5).alias("p50_near"), near("spread_p99", 0.99).alias("p99_near"))
    return r6(told.join(held, "symbol").select(*STREAM_COUNTS.split(", "), "spread_mean", F.get("largest_gaps_ms", F.lit(0)).alias("largest_gap_ms"), "p50_near", "p99_near"), "spread_mean")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """An EMA-cross backtest on hourly bars: its trades, each with the run's metrics."""
    run = cross_run(spark, d)
    m = metrics(fills.trades(run), fills.equity(run), "H1")
    return fills.trades(run).join(m, "symbol").orderBy("k")


