import pytest

from barograph.sources.csv_source import SourceSpec, read_csv, read_tick_csv, resolve_columns
from barograph.sources.discover import discover, sniff


def write(tmp_path, text, name="x.csv"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


TICKS = "timestamp,bidPrice,askPrice\n2021-01-04 01:02:03.100,1904.998,1905.3\n2021-01-04 01:02:03.151,1905.12,1905.5\n2021-01-04 01:02:04,1905,1905.12\n"


def test_ticks(spark, tmp_path):
    s = read_csv(spark, write(tmp_path, TICKS))
    rows = s.rows.orderBy("seq").collect()
    assert (s.kind, s.scale, s.resolution_ms) == ("tick", 1000, 0) and round(rows[2].ask * 1000) == 1905120 and rows[1].ms - rows[0].ms == 51
    shifted = read_csv(spark, write(tmp_path, TICKS), SourceSpec(utc_offset_hours=2.25)).rows.orderBy("seq").collect()
    assert rows[0].ms - shifted[0].ms == 8_100_000
    assert read_csv(spark, write(tmp_path, "﻿" + TICKS.replace(" 01:", "T01:"))).rows.orderBy("seq").first().ms == rows[0].ms


def test_bars(spark, tmp_path):
    text = "Date_Time,O,H,L,C,Vol\n" + "".join(f"2021-01-04 00:0{k}:00,1,2,0.5,1.5,{k}\n" for k in range(4))
    s = read_csv(spark, write(tmp_path, text))
    assert (s.kind, s.resolution_ms, s.columns["close"]) == ("bar", 60000, "C") and s.rows.agg({"volume": "sum"}).first()[0] == 6
    with pytest.raises(ValueError):
        read_tick_csv(spark, write(tmp_path, text))


@pytest.mark.parametrize("header", ["time,foo,baz", "foo,bid,ask", "timestamp,open,high,low,close,bid,ask", "timestamp,open,high,low"])
def test_refused_headers(header):
    with pytest.raises(ValueError, match="timestamp|neither|both"):
        resolve_columns(header.split(","), SourceSpec())


def test_what_is_given_wins(spark, tmp_path):
    both = "timestamp,open,high,low,close,bid,ask".split(",")
    assert resolve_columns(both, SourceSpec(kind="tick"))[1] == "tick"
    with pytest.raises(ValueError, match="nope"):
        resolve_columns(both, SourceSpec(bid_col="nope"))
    assert read_csv(spark, write(tmp_path, TICKS), SourceSpec(tick_size=0.01)).scale == 100
    for bad in (0.03, -1.0):
        with pytest.raises(ValueError):
            read_csv(spark, write(tmp_path, TICKS), SourceSpec(tick_size=bad))
    with pytest.raises(ValueError):
        read_csv(spark, write(tmp_path, ""))
    with pytest.raises(ValueError):
        read_csv(spark, write(tmp_path, "timestamp,bid,ask\n04.01.2021 00:00,1,2\n"))


def test_a_price_that_is_not_a_number_raises(spark, tmp_path):
    with pytest.raises(Exception, match="finite"):
        read_csv(spark, write(tmp_path, TICKS + "2021-01-04 01:02:05,NaN,1\n")).rows.collect()


def test_discovery(tmp_path):
    write(tmp_path, TICKS * 3, "a.csv")
    write(tmp_path, "timestamp,open,high,low,close\n", "b.txt")
    write(tmp_path, "name,age\n", "c.csv")
    assert [x["kind"] for x in discover([str(tmp_path)], least_bytes=1)] == ["tick", "bar"] and sniff(tmp_path / "c.csv") is None
