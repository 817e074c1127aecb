from barograph.sources import csv_stream
from barograph.streaming.load import load_stream
from tests.test_csv_stream import HEADER, line, rows, ticks


def read_all(reader):
    at, spans, seen = reader.initialOffset(), [], []
    while True:
        found, end = reader.read(at)
        found = list(found)
        if not found:
            return spans, seen
        assert list(reader.readBetweenOffsets(at, end)) == found
        spans.append(len(found))
        seen += found
        at = end


def test_batches_grow_with_the_folder(tmp_path):
    for k, n in enumerate((1000, 1, 2500)):
        (tmp_path / f"{k}.csv").write_bytes(b"x" * n)
    one, ranges = read_all(csv_stream.RangeReader(str(tmp_path), 10, 2))
    few, same = read_all(csv_stream.RangeReader(str(tmp_path), 10, 2, 16))
    assert len(one) == 176 and len(few) == 16 and same == ranges and max(few) == 22
    assert read_all(csv_stream.RangeReader(str(tmp_path), 1000, 2, 16))[0] == [2, 2, 1]  # a small folder keeps its batches


def test_larger_batches_say_the_same(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n".join([HEADER, *(line(*t) for t in ticks(3000, 8))]))
    load = lambda **kw: load_stream(spark, f"file://{tmp_path}/x.csv", "M15", range_bytes=5_000, batch_ranges=1, **kw)
    few, one = load(batches=3), load(batches=1)
    assert few.batches == 3 and one.batches == 1 and rows(few.bars) == rows(one.bars)
    counts = lambda x: x.quality.drop("spread_mean", "spread_p50", "spread_p99").collect()
    assert counts(few) == counts(one) and counts(one)[0].rows == 3000
