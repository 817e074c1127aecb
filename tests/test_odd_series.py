"""Series of events that the small tables don't hold: prices at and below zero, and very few bars."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from barograph.operators import control, signals
from barograph.plans.queries import CROSS, walk_bars

START = datetime(2024, 1, 1)


def events_at(spark, folder, values, every=timedelta(hours=1)):
    """An ``events`` table of one event for each value; a value v moves the walk by round(100 v) % 41 - 20 cents."""
    rows = [(k, START + k * every, k % 9, "click", float(v), "{}") for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def by_sql(folder, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con.sql(entry.oracle_sql()[name]).fetchall()


def alike(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize(
    "values",
    [
        [0.0] * 5003,  # falls by 20 cents an hour, through zero
        [0.0] * 5000,  # ends at zero
        [0.2] * 50,  # never moves
        [0.0, 0.4, 0.1],
        [0.0, 0.4],
        [0.0],
        [(k * k % 41) / 100 for k in range(300)],
    ],
)
def test_autocorrelation_is_its_sql(spark, tmp_path, values):
    folder = events_at(spark, tmp_path, values)
    [got], [want] = entry.queries()["lag1_autocorr"](spark, folder).collect(), by_sql(folder, "lag1_autocorr")
    assert alike(got.autocorrelation, want[0]), (got, want)


def test_control_of_prices_below_zero(spark, tmp_path):
    """A return that isn't a number stays among the returns, as in the reference: no fewer are shuffled, and none becomes a price."""
    bars = walk_bars(spark, events_at(spark, tmp_path, [0.0] * 5003))
    made = control.shuffled_bars(bars, 2, 1).orderBy("trial", "i").collect()
    assert len(made) == 2 * 5003 and all(math.isnan(r.close) for r in made if r.i == 5002)
    assert control.control_test(control.control_runs(bars, signals.ema_cross_arrays, CROSS, "H1", 2)).count() == 1
