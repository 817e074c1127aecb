import itertools
from datetime import UTC, datetime

from pyspark.sql import functions as F

from barograph.operators.bars import BARS, bars_from_ticks
from barograph.operators.quality import quality_report
from barograph.plans.engine import Engine
from barograph.sources.ticks import ticks_raw
from barograph.streaming.bars import finish, read_ticks, run_to_end, short_bars, stream_bars, stream_quality


def rows(df):
    return sorted((r.symbol, r.ms, r.open, r.high, r.low, r.close, r.volume, round(r.spread, 9)) for r in df.collect())


def test_stream_is_batch_however_it_is_cut(spark, sf, tmp_path):
    t = ticks_raw(spark, sf)
    want = rows(bars_from_ticks(t, "H1"))
    for parts in (1, 5):
        at = str(tmp_path / str(parts))
        t.repartitionByRange(parts, "ms").sortWithinPartitions("ms").write.parquet(f"{at}/ticks")
        run_to_end(spark, stream_bars(read_ticks(spark, f"{at}/ticks", 1), "H1", "30 days"), f"{at}/bars", f"{at}/checkpoint")
        written = spark.read.schema("symbol string, ms long").parquet(f"{at}/bars").count()
        assert written < len(want)
        assert rows(finish(spark, spark.read.parquet(f"{at}/ticks"), f"{at}/bars", "H1")) == want


def test_quality_across_batches(spark, sf, tmp_path):
    t = ticks_raw(spark, sf).withColumn("ms", F.col("ms") - F.pmod("ms", F.lit(3_600_000)))
    t.repartitionByRange(4, "ms").sortWithinPartitions("ms", "seq").write.parquet(str(tmp_path / "ticks"))
    q = stream_quality(read_ticks(spark, str(tmp_path / "ticks"), 1)).writeStream.outputMode("update").format("memory").queryName("quality_seams").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.symbol: r for r in spark.table("quality_seams").orderBy("rows").collect()}
    for r in quality_report(t).collect():
        got = last[r.symbol]
        assert (got.rows, got.first_ms, got.last_ms, got.negative_spread, got.zero_spread) == (r.rows, r.first_ms, r.last_ms, r.negative_spread, r.zero_spread)
        times = [x.ms for x in t.where(F.col("symbol") == r.symbol).orderBy("ms").collect()]
        runs = [len(list(g)) - 1 for _, g in itertools.groupby(times)]
        assert (got.duplicate_timestamps, got.max_duplicate_run) == (sum(runs), max(runs))


def test_late_ticks_are_made_up_for(spark, sf, tmp_path):
    t = ticks_raw(spark, sf)
    want = rows(bars_from_ticks(t, "H1"))
    at = str(tmp_path)
    t.repartition(6, F.xxhash64("seq")).write.parquet(f"{at}/ticks")  # each file spans all of the time
    run_to_end(spark, stream_bars(read_ticks(spark, f"{at}/ticks", 1), "H1"), f"{at}/bars", f"{at}/checkpoint")
    ticks, written = spark.read.parquet(f"{at}/ticks"), spark.read.schema(BARS).parquet(f"{at}/bars")
    lost = t.count() - written.agg(F.sum("volume")).first()[0]
    assert lost > 0 and short_bars(ticks, written, "H1").agg(F.sum("lacking")).first()[0] == lost
    assert rows(finish(spark, ticks, f"{at}/bars", "H1")) == want


def test_streamed_load_is_the_whole_load(spark, tmp_path):
    """Files whose order by name isn't that of time."""
    folder, n = tmp_path / "csv", 4000
    folder.mkdir()
    for k in range(20):
        block = (k + 10) % 20
        lines = [f"{datetime.fromtimestamp(1_700_000_000 + 30 * i, UTC):%Y-%m-%d %H:%M:%S}.000,{1900 + (i * 7 % 50) / 100:.2f},{1900.3 + (i * 7 % 50) / 100:.2f}" for i in range(block * n // 20, (block + 1) * n // 20)]
        (folder / f"{k:02}.csv").write_text("timestamp,bidPrice,askPrice\n" + "\n".join(lines) + "\n")
    made = {}
    for stream in (False, True):
        e = Engine(spark, str(tmp_path / f"engine-{stream}"))
        row = e.load_data(str(folder), "gold", "M1", stream=stream)
        made[stream] = rows(e.artifacts.get_table(row["bars_sha"]))
        assert row["rows"] == n
    assert made[True] == made[False] and sum(r[6] for r in made[True]) == n
