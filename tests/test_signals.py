from types import SimpleNamespace

import numpy as np
import pytest

from barograph.operators import signals as S
from barograph.plans.queries import CROSS, STRETCH, walk_bars

GOOD = """
def signal(bars, p):
    f = ema_fast(bars.close, p["n"])
    up = bars.close > f
    return {"long_entry": up, "short_entry": ~up, "stop_distance": np.abs(bars.high - bars.low) + 1, "target_distance": np.full(len(f), 2.0)}
"""
RETURN = 'return {"long_entry": 0, "short_entry": 0, "stop_distance": 0, "target_distance": 0}'


@pytest.mark.parametrize("line", ["import os", "from sys import path", "open('x')", "eval('1')", "x = bars.close.__class__", "x = bars.close[1:]", "x = bars.close[-1:]", "x = bars.high[i + 1]", "x = bars.close[i + n]", "x = bars.close[-n:]", "x = bars.close[n:]", "x = bars.close[i - -1]", "x = bars.close[-1]", "x = bars.close[::-1]", "c = bars.close; x = c[1:]", "c = bars.close; d, e = c, 1; x = d[i + 1]", "x = np.roll(bars.close, -1)", "x = np.roll(bars.close, shift=n)", "x = np.load('/etc/passwd')", "bars.close.tofile('x')", "os.remove('x')", "getattr(bars, 'x')"])
def test_refused(line):
    assert not S.validate_source(f"def signal(bars, p):\n    {line}\n    {RETURN}").ok


@pytest.mark.parametrize("line", ["x = bars.close[:-1]", "x = bars.close[0]", "x = bars.close[i - 1]", "x = p['n']", "x = np.diff(bars.volume)", "x = np.roll(bars.close, 1)", "c = bars.close; x = c[:-3]", "x = bars.close[::2]"])
def test_accepted(line):
    assert S.validate_source(f"def signal(bars, p):\n    {line}\n    {RETURN}").ok


@pytest.mark.parametrize("line", ["x = b.close[1:]", "x = b.close[i + 1]"])
def test_the_bars_may_have_another_name(line):
    assert not S.validate_source(f"def signal(b, p):\n    {line}\n    {RETURN}").ok


def test_shape_of_the_source():
    assert S.validate_source(GOOD).ok
    for bad in ("def signal(bars):\n    " + RETURN, "def other(bars, p):\n    " + RETURN, "def signal(bars, p):\n    pass", "def signal(bars, p):\n    return {'long_entry': 0}", "def signal("):
        assert not S.validate_source(bad).ok
    assert S.validate_source("def signal(bars, p):\n    out = {}\n    return out").warnings


def test_compiled_source_runs_and_is_checked():
    bars = SimpleNamespace(**{c: np.arange(1.0, 40) for c in ("open", "high", "low", "close", "volume")}, ms=np.arange(39))
    assert len(S.evaluate_signal(S.compile_source(GOOD), bars, {"n": 5})["long_entry"]) == 39
    with pytest.raises(ValueError, match="short_entry"):
        S.evaluate_signal(lambda b, p: {"long_entry": []}, bars, {})
    with pytest.raises(ValueError, match="values for"):
        S.evaluate_signal(lambda b, p: dict.fromkeys(S.SIGNALS, [1.0]), bars, {})
    with pytest.raises(ValueError):
        S.compile_source("import os")


@pytest.mark.parametrize("build, arrays, p", [(S.ema_cross, S.ema_cross_arrays, CROSS), (S.stretch, S.stretch_arrays, STRETCH)])
def test_columns_and_arrays_agree(spark, sf, build, arrays, p):
    b = walk_bars(spark, sf)
    got, want = build(b, p).orderBy("i").toPandas(), arrays(S.arrays_of(b.orderBy("i").toPandas()), p)
    assert got["long_entry"].tolist() == want["long_entry"].tolist() and got["short_entry"].tolist() == want["short_entry"].tolist()
    assert got["long_entry"].any() and got["short_entry"].any()
    ok = got["long_entry"] | got["short_entry"]
    for c in ("stop_distance", "target_distance"):
        assert np.allclose(got[c][ok], want[c][ok.to_numpy()])


def test_errors_and_types_are_known():
    source = 'def signal(bars, p):\n    if not hasattr(bars, "close") or type(p) is not dict:\n        raise TypeError("t")\n    try:\n        return p["none"]\n    except KeyError:\n        raise ValueError("no n") from None\n    except Exception:\n        pass\n    ' + RETURN
    with pytest.raises(ValueError, match="no n"):
        S.compile_source(source)(SimpleNamespace(close=np.zeros(3)), {})
