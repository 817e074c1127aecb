import pytest
from pyspark.sql import functions as F

from barograph.plans.engine import Engine
from barograph.sources.artifacts import Artifacts, content_digest
from barograph.sources.catalog import Catalog

SOURCE = """
def signal(bars, p):
    fast = ema_fast(bars.close, p["fast"])
    slow = ema_fast(bars.close, p["slow"])
    above = fast > slow
    was = np.concatenate(([False], above[:-1]))
    atr = atr_fast(bars.high, bars.low, bars.close, 14)
    warm = ~(np.isnan(slow) | np.isnan(atr))
    stop = np.nan_to_num(atr) * 2.0
    return {"long_entry": above & ~was & warm, "short_entry": ~above & was & warm, "stop_distance": stop, "target_distance": stop * 1.5}
"""


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    import numpy as np

    r = np.random.default_rng(5)
    ms = 1_609_722_000_000 + np.cumsum(r.integers(1, 60_000, 20_000))
    bid = 1900 + np.cumsum(r.normal(0, 0.05, 20_000))
    path = tmp_path_factory.mktemp("csv") / "ticks.csv"
    at = ms.astype("datetime64[ms]").astype(str)
    path.write_text("timestamp,bidPrice,askPrice\n" + "".join(f"{t.replace('T', ' ')},{b:.3f},{b + s:.3f}\n" for t, b, s in zip(at, bid, r.uniform(0.1, 0.4, 20_000), strict=True)))
    return str(path)


def test_verbs(spark, csv, tmp_path):
    e = Engine(spark, str(tmp_path))
    row = e.load_data(csv, "gold", "M15")
    assert (row["base_timeframe"], row["default_timeframe"], row["rows"], row["tick_size"]) == ("M1", "M15", 20_000, 0.001) and "H4" in row["serves"]
    again = e.load_data(csv, "gold2", "M15", stream=True)
    assert (again["bars"], again["default_bars"], again["ingest"]) == (row["bars"], row["default_bars"], "stream")
    assert {d["name"] for d in e.list_data()} == {"gold", "gold2"}
    with pytest.raises(ValueError):
        e.bars_for("gold", "S10")
    with pytest.raises(KeyError, match="gold"):
        e.bars_for("silver")
    assert e.save_strategy("cross", SOURCE, {"fast": 5, "slow": 20}, family="f")["version"] == 1
    with pytest.raises(ValueError):
        e.save_strategy("bad", "import os")
    out = e.backtest("cross", "gold", intrabar="M1")
    assert out["reconciled"] and out["metrics"]["n_trades"] > 3 and out["timeframe"] == "M15"
    assert e.backtest("cross", "gold", intrabar="M1")["metrics"] == out["metrics"]
    with pytest.raises(ValueError):
        e.backtest("cross", "gold", intrabar="H1")
    assert e.get_run(out["run_id"])["status"] == "ok" and {r["status"] for r in e.run_history("cross", "backtest")} == {"ok", "error"}
    chart = e.chart(out["run_id"], limit=100_000)
    assert chart["markers"].count() == 2 * out["metrics"]["n_trades"] and chart["bars"].count() == chart["equity"].count()
    swept = e.optimize("cross", "gold", {"fast": [3, 9, 3], "slow": [20, 40, 10]})
    assert swept["comparisons"] == 9 and swept["family_comparisons"] == 9 and swept["best"]["score"] == swept["top"][0]["score"]
    found = e.validate("cross", "gold", {"fast": [3, 9, 3]}, 200, 60)
    assert found["folds"] == len(found["per_fold"]) and found["comparisons"] == 3 * found["folds"]
    with pytest.raises(ValueError):
        e.validate("cross", "gold", {"fast": [3, 9, 3]}, 10**6, 60)
    assert "passed" in e.control_test("cross", "gold", trials=2)
    e.archive_strategy("cross", "done")
    assert e.list_strategies() == [] and e.list_strategies(True)[0]["runs"] >= 4
    s = e.stats()
    assert (s["data_sources"], s["archived"], s["optimizations"]) == (2, 1, 1) and s["artifacts"] > 3
    assert Engine(spark, str(tmp_path)).get_strategy("cross")["params"] == {"fast": 5, "slow": 20}


def test_catalogue(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    for parent in (None, 1, 2, 1):
        c.save_version("s", "x", "y", {}, parent_version=parent)
    with pytest.raises(ValueError, match="1 to 4"):
        c.save_version("s", "x", "y", {}, parent_version=9)
    assert [c.save_version("t", "x", "y", {}, parent_version=p) for p in (None, None, None, 0)] == [1, 2, 3, 4]
    assert [r.parent_version for r in c.table("strategy_version").where("strategy_id = 't'").orderBy("version").collect()] == [None, 1, 2, None]
    # a writer that saw only three versions adds a row of its own, and no version is lost
    c._put("strategy_version", version_pk="t@other", strategy_id="t", parent_version=3)
    assert [r.version for r in c.table("strategy_version").where("strategy_id = 't'").orderBy("version").collect()] == [1, 2, 3, 4, 5]
    from barograph.sources.catalog import version_tree

    assert {r.version: r.path for r in version_tree(c.table("strategy_version").where("strategy_id = 's'")).collect()} == {1: "1", 2: "1/2", 3: "1/2/3", 4: "1/4"}
    c.put_source(name="d", path="p", digest="x", kind="tick", rows=1)
    first = c.source("d")["created_at"]
    c.put_source(name="d", path="q", digest="x", kind="tick", rows=2)
    assert (c.source("d")["created_at"], c.source("d")["rows"], c.table("data_source").count()) == (first, 2, 1)
    c.delete_source("d")
    with pytest.raises(KeyError):
        c.source("d")
    for n in (1, 2):
        run = c.start_run(c.version("s", n)["version_pk"], "d", "optimize", {}, "H1")
        c.record_optimization(run, mode="grid", objective="sqn", comparisons=250)
    assert c.comparisons("s") == 500 and c.comparisons("none") == 0


def test_artifacts(spark, tmp_path):
    a, df = Artifacts(spark, str(tmp_path)), spark.range(100).withColumn("x", F.col("id") / 3)
    sha = a.put_table(df)
    assert sha == content_digest(df.repartition(7)) == a.put_table(df.orderBy(F.desc("id"))) != content_digest(df.limit(99))
    assert a.get_table(sha).count() == 100 and a.get_json(a.put_json({"b": 1, "a": [2]})) == {"a": [2], "b": 1}
    assert a.size()[0] == 2
    for bad in ("", "xyz", "../a"):
        with pytest.raises(ValueError):
            a.path_for(bad)
