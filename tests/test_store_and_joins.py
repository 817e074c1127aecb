import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from barograph.operators import folds, signal_table
from barograph.operators.bars import bars_from_ticks, roll_up
from barograph.operators.intervals import cells_of, interval_join
from barograph.plans.queries import CROSS, walk_bars
from barograph.sources import catalog
from barograph.sources.barstore import BarStore
from barograph.sources.ticks import ticks_raw


def test_cells_tile_a_range(spark):
    draw = random.Random(1)
    spans = [(a, a + draw.choice([0, 1, 2, 3, 17, 1000, 10**9])) for a in (draw.randint(-5000, 5000) for _ in range(300))] + [(-(1 << 40), 1 << 40), (5, 3), (0, 1 << 50)]
    for r in spark.createDataFrame(spans, "a long, b long").select("a", "b", cells_of("a", "b").alias("c")).collect():
        at = r.a
        cells = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in r.c)
        for low, high in cells:
            assert low == at
            at = high
        assert at == r.b if r.b > r.a else not cells
        assert max([0, *(sum(x.level == c.level for x in r.c) for c in r.c)]) <= 2


def test_points_in_ranges_of_unequal_lengths(spark):
    draw = random.Random(2)
    points = [(draw.choice("ab"), draw.randint(-300, 3000), k) for k in range(400)] + [("a", None, 999)]
    ranges = [(draw.choice("ab"), a, a + draw.choice([0, 1, 5, 60, 2500]), k) for k, a in enumerate(draw.randint(-300, 3000) for _ in range(200))] + [("a", None, 5, 999)]
    p, r = spark.createDataFrame(points, "s string, at long, p long"), spark.createDataFrame(ranges, "s string, low long, high long, r long")
    want = sorted((x[2], y[3]) for x in points for y in ranges if None not in (x[1], y[1]) and x[0] == y[0] and y[1] <= x[1] < y[2])
    assert sorted((g.p, g.r) for g in interval_join(p, r, "at", "low", "high", ["s"]).collect()) == want
    assert interval_join(p, r.where("low is null"), "at", "low", "high", ["s"]).count() == 0


def test_many_folds_without_a_nested_loop(spark):
    many = folds.rolling_folds(spark, 10_000_400, 300, 100)
    trades = spark.range(0, 10_000_000, 5003).select((F.col("id") + 300).alias("entry_i"), "id")
    got = folds.attribute(trades, many)
    plan = got._jdf.queryExecution().toString()
    assert many.count() > 100_000 and "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.where("entry_i < test_start or entry_i >= test_end").count() == 0 and got.count() == trades.count()


def test_stored_bars_are_pruned(spark, sf, tmp_path, monkeypatch):
    from barograph.sources import barstore

    monkeypatch.setattr(barstore, "PERIOD_BARS", 200)
    ticks, store = ticks_raw(spark, sf), BarStore(spark, f"file://{tmp_path}/bars")
    made = bars_from_ticks(ticks, "M15")
    store.put(made, "M15")
    assert store.has("m15") and not store.has("H1")
    store.derived("M15", "H1")
    low, high = made.agg(F.min("ms") + 5 * 86_400_000, F.min("ms") + 12 * 86_400_000).first()
    got = store.read("H1", low, high, ["click"])
    want = roll_up(made, "H1").where((F.col("ms") >= low) & (F.col("ms") < high) & (F.col("symbol") == "click"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0
    plan = got._jdf.queryExecution().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "period" in filters.split("PushedFilters")[0] and "symbol" in filters.split("PushedFilters")[0] and "GreaterThanOrEqual(ms" in filters
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(got) < files(store.read("H1")) / 4
    odd = spark.createDataFrame([(None, 5, 1.0, 1.0, 1.0, 1.0, 1, 0.0, 0.0), ("a/b=c", -5, 1.0, 1.0, 1.0, 1.0, 1, 0.0, 0.0)], made.select("symbol", "ms", "open", "high", "low", "close", "volume", "spread", "spread_max").schema)
    store.put(odd, "D1")
    assert sorted((str(r.symbol), r.ms) for r in store.read("D1").collect()) == [("None", 5), ("a/b=c", -5)]


def test_signals_from_sql(spark, sf):
    name = signal_table.register(spark)
    bars = walk_bars(spark, sf).withColumn("symbol", F.explode(F.array(F.lit("a"), F.lit("b"))))
    bars.createOrReplaceTempView("two_series")
    source = "def signal(bars, p):\n    up = bars.close > p['level']\n    return {'long_entry': up, 'short_entry': ~up, 'stop_distance': np.where(up, np.nan, 1.0), 'target_distance': bars.spread}"
    got = spark.sql(f"SELECT s.symbol, count(*) n, count_if(long_entry) up, count(stop_distance) stops FROM {name}(TABLE(two_series), :source, :params) s GROUP BY s.symbol", args={"source": source, "params": json.dumps({"level": 1000.0})}).collect()
    n = bars.count() // 2
    assert {r.symbol for r in got} == {"a", "b"} and all(r.n == n and 0 < r.up < n and r.stops == n - r.up for r in got)
    for bad in (f"{name}(TABLE(two_series), 'none', '{{}}')", f"{name}(TABLE(two_series), 'ema_cross', '[]')", f"{name}(TABLE(SELECT 1 AS x), 'ema_cross', '{json.dumps(CROSS)}')"):
        with pytest.raises(Exception, match="(?i)lack|object|line|signal"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_versions_hang_from_long_chains(spark):
    rows = [("s", k, k - 1 or None) for k in range(1, 131)] + [("t", 1, None), ("t", 2, 1), ("t", 3, 1), ("t", 4, 9)]
    got = {(r.strategy_id, r.version): (r.level, r.path) for r in catalog.version_tree(spark.createDataFrame(rows, "strategy_id string, version int, parent_version int")).collect()}
    assert got["s", 130] == (129, "/".join(map(str, range(1, 131)))) and got["t", 3] == (1, "1/3") and ("t", 4) not in got and len(got) == 133
    circle = [("s", 1, 2), ("s", 2, 1), ("s", 3, 1), ("s", 4, None)]
    assert [r.path for r in catalog.version_tree(spark.createDataFrame(circle, "strategy_id string, version int, parent_version int")).collect()] == ["4"]


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "COMPACT_AT", 6)
    lib = catalog.Catalog(spark, f"file://{tmp_path}/lib")
    failed = []

    def work(k):
        try:
            for j in range(6):
                lib.put_source(name=f"{k}-{j % 3}", path=f"{j}", kind="tick")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert {(r.name, r.path) for r in lib.table("data_source").collect()} == {(f"{k}-{j}", f"{j + 3}") for k in range(3) for j in range(3)}
    for _ in range(2):
        lib.compact("data_source")
    assert len(lib._files("data_source")) == 0 and lib.table("data_source").count() == 9
    lib.delete_source("0-0")
    assert lib.table("data_source").count() == 8 and catalog.Catalog(spark, f"file://{tmp_path}/lib").table("data_source").count() == 8
    lib._append("meta", {"key": "schema_version", "value": "2"}, 1 << 62)
    with pytest.raises(ValueError, match="version 2"):
        catalog.Catalog(spark, f"file://{tmp_path}/lib")


def test_schema_steps_run_in_order(spark, tmp_path, monkeypatch):
    root, ran = f"file://{tmp_path}/lib", []
    catalog.Catalog(spark, root)
    monkeypatch.setattr(catalog, "VERSION", 3)
    monkeypatch.setattr(catalog, "STEPS", {1: lambda c: ran.append(1), 2: lambda c: ran.append(2)})
    catalog.Catalog(spark, root)
    catalog.Catalog(spark, root)
    assert ran == [1, 2]
