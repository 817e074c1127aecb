"""DuckDB SQL of the registered queries, put together from shared pieces."""

from __future__ import annotations

from barograph.functions.instrument import Instrument
from barograph.functions.timeframes import bars_per_year, timeframe_ms

RAW = """ticks_raw AS (
  SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS ms, value AS bid, value + (event_id % 7 + 1) / 100.0::double AS ask FROM events)"""
WALK = """ticks_walk AS (
  SELECT 'WALK' AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS ms, bid, bid + (event_id % 7 + 1) / 100.0::double AS ask
  FROM (SELECT *, (100000 + sum(cast(round(value * 100) AS bigint) % 41 - 20) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::double / 100.0::double AS bid FROM events))"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def bars(name: str, ticks: str, tf: str) -> str:
    w = timeframe_ms(tf)
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ms) - 1 AS i FROM (
    SELECT symbol, t - t % {w} AS ms, first(bid ORDER BY t, seq) AS open, max(bid) AS high, min(bid) AS low, last(bid ORDER BY t, seq) AS close,
           count(*) AS volume, avg(ask - bid) AS spread, max(ask - bid) AS spread_max
    FROM (SELECT symbol, seq, ms AS t, bid, ask FROM {ticks}) GROUP BY 1, 2))"""


def rolled(name: str, source: str, tf: str) -> str:
    w = timeframe_ms(tf)
    return f"""{name} AS (
  SELECT symbol, t - t % {w} AS ms, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close,
         sum(volume)::bigint AS volume, coalesce(sum(spread * volume) / nullif(sum(volume), 0), 0) AS spread, max(spread_max) AS spread_max
  FROM (SELECT * EXCLUDE (ms, i), ms AS t FROM {source}) GROUP BY 1, 2)"""


BAR_OUT = "symbol, ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, round(spread, 6) AS spread, round(spread_max, 6) AS spread_max"


def seeded(name: str, source: str, x: str, alpha: str, n: int, first: int = 0) -> str:
    """The recursion over column ``x`` of ``source`` from row ``first`` on."""
    return f"""{name}(i, v) AS (
  SELECT {first + n - 1}::bigint, (SELECT avg({x}) FROM {source} WHERE i BETWEEN {first} AND {first + n - 1}) WHERE (SELECT count(*) FROM {source} WHERE i BETWEEN {first} AND {first + n - 1}) = {n}
  UNION ALL SELECT b.i, {alpha} * b.{x} + (1 - {alpha}) * e.v FROM {name} e JOIN {source} b ON b.i = e.i + 1)"""


def ema(name: str, source: str, n: int) -> str:
    return seeded(name, source, "close", f"(2.0::double / ({n} + 1))", n)


TR = """tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS x, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss
  FROM (SELECT *, lag(close) OVER (ORDER BY i) AS pc FROM h1))"""


def atr(n: int) -> str:
    return seeded("atr", "tr", "x", f"(1.0::double / {n})", n)


def crosses(name: str, fast: str, slow: str, stop_mult: float, rr: float, keys: str = "", warm: str = "") -> str:
    return f"""{name} AS (
  SELECT *, coalesce(above AND NOT was AND warm, false) AS long_entry, coalesce(NOT above AND was AND warm, false) AS short_entry, sd AS stop_distance, sd * {rr} AS target_distance
  FROM (SELECT *, lag(above) OVER (ORDER BY i) AS was FROM (
    SELECT h1.*, coalesce(f.v > s.v, false) AS above, f.v IS NOT NULL AND s.v IS NOT NULL AND a.v IS NOT NULL AS warm, coalesce(a.v, 0) * {stop_mult} AS sd
    FROM h1 LEFT JOIN {fast} f USING (i) LEFT JOIN {slow} s USING (i) LEFT JOIN atr a USING (i))))"""


def simulation(name: str, signals: str, capital: float = 10_000.0, risk: float = 0.01, it: Instrument = Instrument(), key: str = "0") -> str:
    """A recursion over bars that carries cash and the open position; x_* tell of a position that ended on the bar.

    ``signals`` has run, i, OHLC, spread and the four signals; prev_* are those of the bar before.
    """
    vpu, fee, last = it.value_per_unit, it.commission, f"(SELECT max(i) FROM {signals})"
    return f"""sg AS (
  SELECT *, lag(long_entry) OVER w AS p_long, lag(short_entry) OVER w AS p_short, lag(stop_distance) OVER w AS p_sd, lag(target_distance) OVER w AS p_td FROM {signals} WINDOW w AS (PARTITION BY run ORDER BY i)),
{name}(run, i, cash, pos, e_i, e_px, sl, tp, lots, risked, x_e, x_dir, x_epx, x_px, x_lots, x_pnl, x_r, x_reason, equity) AS (
  SELECT run, 0::bigint, {capital}::double, 0, 0::bigint, 0::double, 0::double, 0::double, 0::double, 0::double, 0::bigint, 0, 0::double, 0::double, 0::double, 0::double, 0::double, 0, {capital}::double FROM sg WHERE i = 0
  UNION ALL
  SELECT run, i, cash2, pos2, e_i2, e_px2, sl2, tp2, lots2, risked2, x_e, x_dir, x_epx, x_px, x_lots, x_pnl, x_r, x_reason,
         cash2 + CASE WHEN pos2 = 0 THEN 0 ELSE (close - e_px2) * pos2 * {vpu} * lots2 END
  FROM (
    SELECT *, CASE WHEN opens THEN want ELSE pos1 END AS pos2, CASE WHEN opens THEN i ELSE e_i END AS e_i2, CASE WHEN opens THEN fill ELSE e_px END AS e_px2,
      CASE WHEN opens THEN fill - p_sd * want ELSE sl END AS sl2, CASE WHEN opens THEN fill + p_td * want ELSE tp END AS tp2,
      CASE WHEN opens THEN sized ELSE lots END AS lots2, CASE WHEN opens THEN per_lot * sized ELSE risked END AS risked2, CASE WHEN opens THEN cash1 - {fee} * sized ELSE cash1 END AS cash2
    FROM (SELECT *, want <> 0 AND sized >= {it.lot_min} AS opens FROM (
      SELECT *, CASE WHEN want > 0 THEN open + spread ELSE open END AS fill, least(floor(cash1 * {risk} / per_lot / {it.lot_step}) * {it.lot_step}, {it.lot_max}) AS sized
      FROM (SELECT *, CASE WHEN pos1 <> 0 OR p_sd <= 0 OR p_td <= 0 THEN 0 WHEN p_long THEN 1 WHEN p_short THEN -1 ELSE 0 END AS want, p_sd * {vpu} + {fee} * 2.0 AS per_lot
        FROM (SELECT *, CASE WHEN x_reason = 0 THEN pos ELSE 0 END AS pos1, CASE WHEN x_reason = 0 THEN cash ELSE cash + (x_px - e_px) * pos * {vpu} * lots - {fee} * lots END AS cash1,
            e_i AS x_e, pos AS x_dir, e_px AS x_epx, lots AS x_lots, (x_px - e_px) * pos * {vpu} * lots - {fee} * lots * 2.0 AS x_pnl, CASE WHEN risked > 0 THEN ((x_px - e_px) * pos * {vpu} * lots - {fee} * lots * 2.0) / risked ELSE 0 END AS x_r
          FROM (SELECT *, CASE x_reason WHEN 1 THEN sl WHEN 2 THEN tp ELSE 0 END AS x_px FROM (
            SELECT s.cash, s.pos, s.e_i, s.e_px, s.sl, s.tp, s.lots, s.risked, b.*,
              CASE WHEN s.pos = 0 OR b.i <= s.e_i THEN 0 WHEN s.pos > 0 AND b.low <= s.sl OR s.pos < 0 AND b.high >= s.sl THEN 1 WHEN s.pos > 0 AND b.high >= s.tp OR s.pos < 0 AND b.low <= s.tp THEN 2 ELSE 0 END AS x_reason
            FROM {name} s JOIN sg b ON b.run = s.run AND b.i = s.i + 1)))))))),
ended AS (
  SELECT s.run, e_i AS x_e, s.i, pos AS x_dir, e_px AS x_epx, b.close AS x_px, lots AS x_lots, (b.close - e_px) * pos * {vpu} * lots - {fee} * lots * 2.0 AS x_pnl,
         ((b.close - e_px) * pos * {vpu} * lots - {fee} * lots * 2.0) / risked AS x_r, 4 AS x_reason, cash + (b.close - e_px) * pos * {vpu} * lots - {fee} * lots AS equity
  FROM {name} s JOIN sg b USING (run, i) WHERE s.i = {last} AND pos <> 0),
trades AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY exit_i, entry_i) - 1 AS k FROM (
    SELECT run, x_e AS entry_i, i AS exit_i, x_dir AS direction, x_epx AS entry_px, x_px AS exit_px, x_lots AS lots, x_pnl AS pnl, x_r AS r_multiple, x_reason AS exit_reason FROM {name} WHERE x_reason > 0
    UNION ALL SELECT run, x_e, i, x_dir, x_epx, x_px, x_lots, x_pnl, x_r, x_reason FROM ended)),
curve AS (SELECT s.run, s.i, coalesce(e.equity, s.equity) AS equity FROM {name} s LEFT JOIN ended e ON e.run = s.run AND e.i = s.i)"""


def metrics_cte(tf: str, capital: float = 10_000.0) -> str:
    y = bars_per_year(tf)
    return f"""c1 AS (SELECT *, max(equity) OVER (PARTITION BY run ORDER BY i) AS peak, lag(equity) OVER (PARTITION BY run ORDER BY i) AS before FROM curve),
c2 AS (SELECT run, count(*) AS bars, max(peak - equity) AS max_drawdown, max((peak - equity) / greatest(peak, 1e-9)) AS max_drawdown_pct, avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(r) FILTER (WHERE r < 0) AS down
  FROM (SELECT *, (equity - before) / greatest(before, 1e-9) AS r FROM c1) GROUP BY run),
t1 AS (SELECT run, count(*) AS n_trades, sum(pnl) AS net_profit, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / (-sum(pnl) FILTER (WHERE pnl < 0)) AS profit_factor, avg(r_multiple) AS avg_r,
    coalesce(stddev_samp(r_multiple), 0) AS std_r, avg((pnl > 0)::int) AS win_rate, coalesce(min(pnl) FILTER (WHERE pnl < 0), 0) AS largest_loss, sum(exit_i - entry_i) AS held FROM trades GROUP BY run),
t2 AS (SELECT run, max(n) AS max_consecutive_losses FROM (SELECT run, g, sum((pnl < 0)::int) AS n FROM (SELECT *, sum((pnl >= 0)::int) OVER (PARTITION BY run ORDER BY k) AS g FROM trades) GROUP BY run, g) GROUP BY run),
m AS (SELECT run, n_trades, net_profit, profit_factor, avg_r AS expectancy_r, win_rate, max_drawdown, max_drawdown_pct, CASE WHEN sd > 0 THEN mean / sd * sqrt({y}) ELSE 0 END AS sharpe,
    CASE WHEN down > 0 THEN mean / down * sqrt({y}) ELSE 0 END AS sortino, CASE WHEN max_drawdown_pct > 0 THEN net_profit / {capital} / (bars / {y}) / max_drawdown_pct ELSE 0 END AS calmar,
    CASE WHEN std_r > 0 THEN avg_r / std_r * sqrt(n_trades) ELSE 0 END AS sqn, avg_r, std_r, largest_loss, max_consecutive_losses::bigint AS max_consecutive_losses, held / bars AS exposure
  FROM c2 JOIN t1 USING (run) JOIN t2 USING (run))"""


def rounded(columns: str) -> str:
    return ", ".join(f"round({c.strip()}, 6) AS {c.strip()}" for c in columns.split(","))


# A small catalogue, the same rows for both engines.
LITERALS = {
    "strategy": ("strategy_id, name, family, archived, created_at", "('a', 'Alpha', 'cross', false, 1.0), ('b', 'Beta', 'cross', false, 2.0), ('c', 'Gamma', 'mean', true, 3.0), ('d', 'Delta', 'mean', false, 4.0)"),
    "version": ("version_pk, strategy_id, version, parent_version", "('a@1', 'a', 1, NULL), ('a@2', 'a', 2, 1), ('a@3', 'a', 3, 2), ('a@4', 'a', 4, 1), ('b@1', 'b', 1, NULL), ('c@1', 'c', 1, NULL)"),
    "run": ("run_id, version_pk, data_name, kind, status, started_at", "(1, 'a@1', 'x', 'backtest', 'ok', 10.0), (2, 'a@2', 'x', 'optimize', 'ok', 11.0), (3, 'b@1', 'y', 'optimize', 'ok', 12.0), (4, 'a@4', 'y', 'validate', 'error', 13.0), (5, 'a@4', 'x', 'backtest', 'ok', 14.0)"),
    "optimization": ("run_id, comparisons", "(2, 250), (3, 250)"),
    "source": ("name, kind", "('x', 'tick'), ('y', 'bar')"),
}


def literal(name: str) -> str:
    columns, rows = LITERALS[name]
    return f"{name}({columns}) AS (VALUES {rows})"
