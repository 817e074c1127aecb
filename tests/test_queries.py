import glob
import os
import statistics

import duckdb
import pytest

import __spark_entry__ as entry
from barograph.plans.queries import walk_bars
from barograph.sources.ticks import ticks_raw


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return v if v is None or isinstance(v, str | bool | int) else round(float(v), 5) + 0.0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_is_its_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_first_touch_all_judges_every_bar(spark, sf):
    bars = sorted(walk_bars(spark, sf).collect(), key=lambda r: r.i)
    want = {}
    for b in bars:
        side = 1 if b.i % 2 == 0 else -1
        low, high = sorted((b.close - 2 * side, b.close + 3 * side))
        want[b.i] = (side, next((x.i for x in bars if x.i > b.i and (x.low <= low or x.high >= high)), None))
    got = entry.queries()["first_touch_all"](spark, sf).collect()
    assert {r.entry_i: (r.direction, r.exit_i) for r in got} == want and len(got) == len(bars) > 5


def test_utc_offset_all_reads_weekends(spark, sf):
    ticks = {}
    for r in ticks_raw(spark, sf).collect():
        ticks.setdefault(r.symbol, []).append(r.ms)
    want = {}
    for symbol, ms in ticks.items():
        ms.sort()
        longest = sorted(((b - a, b) for a, b in zip(ms, ms[1:], strict=False)), reverse=True)[:12]
        ends = [(b % 86_400_000) / 3_600_000 for gap, b in longest if gap > 86_400_000]
        hour = statistics.median(ends) - 22 if ends else None
        want[symbol] = None if hour is None else round((hour - 24 if hour > 12 else hour + 24 if hour < -12 else hour) * 4) / 4
    got = entry.queries()["utc_offset_all"](spark, sf).collect()
    assert {r.symbol: r.utc_offset_hours for r in got} == want
    assert want != {r.symbol: r.utc_offset_hours for r in entry.queries()["utc_offset_infer"](spark, sf).collect()}
