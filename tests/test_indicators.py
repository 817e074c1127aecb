import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barograph.operators import indicators as I


def loop(x, alpha, n):
    out = [None] * len(x)
    if len(x) >= n:
        out[n - 1] = sum(x[:n]) / n
        for i in range(n, len(x)):
            out[i] = alpha * x[i] + (1 - alpha) * out[i - 1]
    return out


def same(a, b, tol=1e-9):
    a = [None if v is None or v != v else v for v in a]
    b = [None if v is None or v != v else v for v in b]
    assert [v is None for v in a] == [v is None for v in b]
    assert all(abs(x - y) <= tol * max(1, abs(y)) for x, y in zip(a, b, strict=True) if y is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(1, 3000), max_size=300), st.integers(1, 80))
def test_kernel_is_the_recursion(x, n):
    a = np.array(x, float)
    same(I.ema_array(a, n).tolist(), loop(x, 2 / (n + 1), n))
    same(I.rma_array(a, n).tolist(), loop(x, 1 / n, n))


def series(n):
    i = np.arange(n)
    f = np.sin(i * 12.9898) * 43758.5453
    close = np.maximum(1, 2000 + np.cumsum((f - np.floor(f) - 0.5) * 2))
    return close


def bars_of(spark, close):
    rows = [("X", i, float(c), float(c) + 0.5, float(c) - 0.5) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, i long, close double, high double, low double")


def test_forms_agree_and_first_values(spark):
    close = series(500)
    b = bars_of(spark, close)
    out = I.recursive(b, {"ema": ("ema", 20), "rma": ("rma", 14), "rsi": ("rsi", 14), "atr": ("atr", 14), "sma": ("sma", 20)}).withColumn("w", I.sma(F.col("close"), 20)).withColumn("tr", I.true_range())
    rows = out.orderBy("i").collect()
    first = {c: next(r.i for r in rows if r[c] is not None) for c in ("ema", "rma", "rsi", "atr", "sma", "w", "tr")}
    assert first == {"ema": 19, "rma": 13, "rsi": 14, "atr": 13, "sma": 19, "w": 19, "tr": 0}
    same([r.sma for r in rows], [r.w for r in rows])
    for n, alpha, block in ((20, 2 / 21, 32), (14, 1 / 14, 64), (1, 1.0, 32), (600, 0.1, 32), (20, 2 / 21, 2)):
        scan = I.seeded_scan(b, "close", alpha, n, "v", block).orderBy("i").collect()
        same([r.v for r in scan], loop(close.tolist(), alpha, n))


def test_rsi_edges():
    up, flat = np.arange(1.0, 30), np.full(29, 5.0)
    assert I.rsi_array(up, 14)[-1] == 100 and I.rsi_array(-up, 14)[-1] == 0 and I.rsi_array(flat, 14)[-1] == 100
    assert np.isnan(I.rsi_array(up, 40)).all()


def test_lengths():
    assert I.period(14.0) == 14
    for bad in (38.4, 0, -1, True):
        with pytest.raises(ValueError):
            I.period(bad)
