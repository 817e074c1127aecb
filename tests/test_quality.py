from barograph.operators import quality as Q
from barograph.sources.ticks import TICKS

HOUR, DAY = 3_600_000, 86_400_000


def frame(spark, ms, spreads=None, bids=None):
    n = len(ms)
    return spark.createDataFrame([("X", k, t, (bids or [10.0] * n)[k], (bids or [10.0] * n)[k] + (spreads or [0.5] * n)[k]) for k, t in enumerate(ms)], TICKS)


def test_counts(spark):
    r = Q.quality_report(frame(spark, [100, 100, 100, 200, 150], [-0.1, 0.0, 0.2, 0.3, 0.4], [10.0, 10.0, 10.0, -1.0, 10.0])).first()
    assert (r.rows, r.first_ms, r.last_ms, r.duplicate_timestamps, r.max_duplicate_run, r.out_of_order) == (5, 100, 200, 2, 2, 1)
    assert (r.negative_spread, r.zero_spread, r.bad_price) == (1, 1, 2) and r.largest_gaps_ms == [50, 50, 0, 0]


def test_percentiles_interpolate(spark):
    r = Q.quality_report(frame(spark, [1, 2, 3, 4], [1.0, 2.0, 3.0, 10.0])).first()
    assert (round(r.spread_p50, 9), round(r.spread_p99, 9), r.spread_mean) == (2.5, 9.79, 4.0)


def test_bars_count_their_close_twice(spark):
    bars = spark.createDataFrame([("X", 0, -1.0), ("X", 60000, 5.0)], "symbol string, ms long, close double")
    r = Q.quality_report(bars).first()
    assert (r.bad_price, r.zero_spread, r.negative_spread, r.spread_mean) == (2, 0, 0, 0.0)


def test_resolution(spark):
    assert Q.resolution(frame(spark, [0, 60000, 120000, 120000, 180000, 9000000, 9060000])).first().resolution_ms == 60000
    assert Q.resolution(frame(spark, [7])).first().resolution_ms == 0
    assert Q.resolution(frame(spark, [0, 5, 12, 17, 24])).first().resolution_ms == 5


def test_offset_of_a_weekly_stream(spark):
    for shift in (0, 2, 3, -5):
        ms = [w * 7 * DAY + 2 * DAY + 22 * HOUR + h * HOUR + 60_000 * 0 + shift * HOUR for w in range(8) for h in range(5 * 24)]
        rows = frame(spark, [m + DAY for m in ms])
        assert Q.utc_offset(rows).first().utc_offset_hours == shift
    assert Q.utc_offset(frame(spark, [0, 1, 2])).first().utc_offset_hours is None


def test_decimals(spark):
    df = spark.createDataFrame([("1904.998", "1"), ("1905.12", None), (None, "2.5")], "a string, b string")
    assert Q.decimals(df, ["a", "b"]).first().decimals == 3 and Q.decimals(df, ["b"]).first().decimals == 1
