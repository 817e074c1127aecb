import random
from datetime import UTC, datetime

import pytest

from barograph.operators.bars import bars_from_ticks
from barograph.operators.quality import quality_report
from barograph.plans.engine import Engine
from barograph.sources import csv_stream
from barograph.sources.artifacts import file_digest, fingerprint
from barograph.sources.csv_source import SourceSpec, read_csv
from barograph.streaming.load import RANK_ERROR, load_stream

HEADER = "timestamp,bidPrice,askPrice"


def stamp(ms):
    return f"{datetime.fromtimestamp(ms // 1000, UTC):%Y-%m-%d %H:%M:%S}.{ms % 1000:03d}"


def line(ms, bid, ask):
    return f"{stamp(ms)},{bid:.2f},{ask:.3f}"


def ticks(n, seed=1, repeats=0.3):
    draw, ms, out = random.Random(seed), 1_700_000_000_000, []
    for _ in range(n):
        ms += 0 if draw.random() < repeats else draw.randint(1, 40_000)
        bid = 1900 + draw.randint(-500, 500) / 100
        out.append((ms, bid, round(bid + draw.choice([-0.01, 0, 0.1, 0.125, 0.2, 0.31]), 3)))
    return out


def rows(df):
    return sorted((r.ms, r.open, r.high, r.low, r.close, r.volume, round(r.spread, 9), round(r.spread_max, 9)) for r in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("closed", [True, False])
def test_ranges_split_a_file_at_any_byte(tmp_path, end, closed):
    lines = [HEADER, "a,1,2", "", "bb,33,4", "c" * 40 + ",5,6", "d,7,8", "", "", "e,9,0"]
    data = end.join(lines) + (end if closed else "")
    (tmp_path / "x.csv").write_bytes(data.encode())
    want = [s.split(",") for s in lines[1:] if s]
    for size in (1, 2, 3, 7, 16, 29, 1000):
        got, last = [], -1
        for at in range(0, len(data), size):
            b = csv_stream.rows_of(str(tmp_path / "x.csv"), 3, at, min(at + size, len(data)), HEADER.split(","))
            for r in b.to_pylist() if b is not None else []:
                assert r["_seq"] > last and r["_seq"] >> csv_stream.PLACE_BITS == 3
                last = r["_seq"]
                got.append([r[c] for c in HEADER.split(",")])
                assert data.encode()[last & ((1 << csv_stream.PLACE_BITS) - 1) :].startswith(got[-1][0].encode())
        assert got == want, size


def test_quoted_values_and_line_ends_in_them(tmp_path):
    (tmp_path / "x.csv").write_text('h,i\n"a,b","1"\n')
    assert csv_stream.rows_of(str(tmp_path / "x.csv"), 0, 0, 100, ["h", "i"]).to_pylist() == [{"h": "a,b", "i": "1", "_seq": 4}]
    (tmp_path / "x.csv").write_text('h,i\n"a\nb",1\n')
    with pytest.raises(Exception, match="line"):
        csv_stream.rows_of(str(tmp_path / "x.csv"), 0, 0, 100, ["h", "i"])


def test_ranges_go_on_from_an_offset(tmp_path):
    for k, n in enumerate((100, 0, 250)):
        (tmp_path / f"{k}.csv").write_bytes(b"x" * n)
    (tmp_path / "_SUCCESS").write_text("")
    reader = csv_stream.RangeReader(str(tmp_path), 60, 2)
    at, seen, spans = reader.initialOffset(), [], []
    while True:
        found, end = reader.read(at)
        found = list(found)
        if not found:
            break
        assert end != at and list(reader.readBetweenOffsets(at, end)) == found
        spans.append(len(found))
        seen += found
        at = end
    assert [(p[-5:], k, a, b) for p, k, a, b in seen] == [("0.csv", 0, 0, 60), ("0.csv", 0, 60, 100), *(("2.csv", 2, a, min(a + 60, 250)) for a in range(0, 250, 60))]
    assert spans == [2, 2, 2, 1] and reader.read(at)[1] == at
    (tmp_path / "3.csv").write_bytes(b"y")
    assert [r[1:] for r in reader.read(at)[0]] == [(3, 0, 1)]


def test_load_is_the_whole_load_and_goes_on(spark, tmp_path):
    made = ticks(4000)
    folder = tmp_path / "csv"
    folder.mkdir()
    write = lambda k, part: (folder / f"{k:02}.csv").write_text("\n".join([HEADER, *(line(*t) for t in part)]))
    write(0, made[:1500])
    write(1, made[1500:2500])
    at = f"file://{tmp_path}/load"
    first = load_stream(spark, f"file://{folder}", "M15", at=at, range_bytes=16_000, batch_ranges=2)
    assert first.batches > 2 and first.decimals == 3
    write(2, made[2500:])
    whole = load_stream(spark, f"file://{folder}", "M15", at=at, range_bytes=16_000, batch_ranges=3)  # only the new file is read
    assert whole.batches > first.batches
    source = read_csv(spark, f"file://{folder}")
    want = rows(bars_from_ticks(source.rows, "M15"))
    assert rows(whole.bars) == want and sum(r[5] for r in want) == 4000 and whole.late_rows == 0
    got, told = whole.quality.first().asDict(), quality_report(source.rows).first().asDict()
    for c in ("rows", "first_ms", "last_ms", "out_of_order", "duplicate_timestamps", "max_duplicate_run", "negative_spread", "zero_spread", "bad_price", "largest_gaps_ms"):
        assert got[c] == told[c], c
    assert got["spread_mean"] == pytest.approx(told["spread_mean"])
    spreads = sorted(a - b for _, b, a in made)
    for c, q in (("spread_p50", 0.5), ("spread_p99", 0.99)):
        assert sum(s < got[c] - 1e-9 for s in spreads) / 4000 <= q + RANK_ERROR and sum(s <= got[c] + 1e-9 for s in spreads) / 4000 >= q - RANK_ERROR


def test_runs_of_one_time_over_many_batches(spark, tmp_path):
    made = [(1_700_000_000_000 + 1000 * t, 1.0, 1.5) for t, n in ((0, 3), (1, 400), (2, 1), (3, 200)) for _ in range(n)]
    (tmp_path / "x.csv").write_text("\n".join([HEADER, *(line(*t) for t in made)]))
    got = load_stream(spark, f"file://{tmp_path}/x.csv", "M1", range_bytes=3_500, batch_ranges=1)
    q = got.quality.first()
    assert got.batches > 5 and (q.rows, q.duplicate_timestamps, q.max_duplicate_run, q.largest_gaps_ms[:4]) == (604, 600, 399, [1000, 1000, 1000, 0])


def test_batches_out_of_time_order(spark, tmp_path):
    made = ticks(3000, 2, 0.0)
    shuffled = made[1000:2000] + made[:1000] + made[2000:]
    (tmp_path / "x.csv").write_text("\n".join([HEADER, *(line(*t) for t in shuffled)]))
    got = load_stream(spark, f"file://{tmp_path}/x.csv", "M15", range_bytes=20_000, batch_ranges=2)
    assert rows(got.bars) == rows(bars_from_ticks(read_csv(spark, f"file://{tmp_path}/x.csv").rows, "M15"))
    assert got.late_rows > 900 and got.quality.first().out_of_order >= 1


def test_symbols_grid_and_refusals(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name,timestamp,bid,ask\nA,2024-01-01 00:00:00.000,1.2345,1.3\nB,2024-01-01T00:00:01,2.5,2.6\n")
    got = load_stream(spark, f"file://{tmp_path}/x.csv", "M1", SourceSpec(symbol_col="name", tick_size=0.01, utc_offset_hours=1))
    assert sorted((r.symbol, r.ms, r.open) for r in got.bars.collect()) == [("A", 1_704_063_600_000, 1.23), ("B", 1_704_063_600_000, 2.5)]
    (tmp_path / "bad.csv").write_text("timestamp,bid,ask\n2024-01-01 00:00:00.000,oops,1.3\n")
    with pytest.raises(Exception, match="not finite"):
        load_stream(spark, f"file://{tmp_path}/bad.csv", "M1")
    (tmp_path / "bars.csv").write_text("timestamp,open,high,low,close\n2024-01-01 00:00:00.000,1,1,1,1\n")
    with pytest.raises(NotImplementedError, match="ticks"):
        load_stream(spark, f"file://{tmp_path}/bars.csv", "M1")


def test_order_of_a_folder_is_that_of_its_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,bid,ask\n" + "".join(f"{stamp(k)},1,{k + 2}\n" for k in range(10)))
    (tmp_path / "b.csv").write_text("timestamp,bid,ask\n" + "".join(f"{stamp(k)},2,{k + 3}\n" for k in range(50_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        got = [(r.bid, r.ask) for r in read_csv(spark, f"file://{tmp_path}").rows.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(1.0, k + 2.0) for k in range(10)] + [(2.0, k + 3.0) for k in range(50_000)]


def test_fingerprints_of_large_files_and_folders(spark, tmp_path):
    big = tmp_path / "big.bin"
    with big.open("wb") as f:
        f.write(b"start")
        f.seek((2 << 30) + (200 << 20))
        f.write(b"end")
    first = fingerprint(spark, f"file://{big}")
    with big.open("r+b") as f:
        f.seek(-1, 2)
        f.write(b"D")
    assert fingerprint(spark, f"file://{big}") != first
    folder = tmp_path / "folder"
    folder.mkdir()
    for name in "ab":
        (folder / name).write_text(name)
    both = fingerprint(spark, f"file://{folder}")
    (folder / "b").write_text("c")
    assert fingerprint(spark, f"file://{folder}") != both
    import hashlib

    assert file_digest(spark, f"file://{folder}/a") == hashlib.sha256(b"a").hexdigest()


def test_engine_streams_what_it_reads_whole(spark, tmp_path):
    (tmp_path / "gold.csv").write_text("\n".join([HEADER, *(line(*t) for t in ticks(3000, 4))]))
    made = {}
    for stream in (False, True):
        e = Engine(spark, f"file://{tmp_path}/engine-{stream}")
        row = e.load_data(f"file://{tmp_path}/gold.csv", "gold", "M15", stream=stream)
        made[stream] = (rows(e.artifacts.get_table(row["bars_sha"])), row["rows"], row["tick_size"], row["digest"], row["first_ms"], row["default_bars"])
        assert row["quality"]["max_duplicate_run"] > 1
    assert made[True] == made[False] and made[True][2] == 0.001


def test_tabs_and_progress(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("\n".join([HEADER, *(line(*t) for t in ticks(600, 6))]).replace(",", "\t"))
    told = []
    got = load_stream(spark, f"file://{tmp_path}/x.tsv", "M15", range_bytes=9_000, batch_ranges=1, progress=lambda *a: told.append(a), with_quality=False)
    assert got.quality is None and [t[0] for t in told] == list(range(got.batches)) and told[-1][1] == 600 and all(a[1] < b[1] for a, b in zip(told, told[1:], strict=False))
    assert rows(got.bars) == rows(bars_from_ticks(read_csv(spark, f"file://{tmp_path}/x.tsv").rows, "M15"))
