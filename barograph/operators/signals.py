"""Signals: what a strategy wants at each bar.

A strategy is either a builder of columns (DataFrame, params -> DataFrame) or a function of arrays
(bars, params -> dict of four arrays). Both give long_entry, short_entry, stop_distance, target_distance.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.functions.columns import in_hours
from barograph.functions.timeframes import HOUR
from barograph.operators import indicators as ind

#: What a signal must return, and what its source may not name.
SIGNALS = ("long_entry", "short_entry", "stop_distance", "target_distance")
BARRED_NAMES = {
    "__import__", "breakpoint", "compile", "delattr", "eval", "exec", "getattr", "globals", "input", "locals", "memoryview", "open", "setattr", "vars",
}
BARRED_MODULES = {"builtins", "ctypes", "http", "importlib", "marshal", "os", "pathlib", "pickle", "requests", "shutil", "socket", "subprocess", "sys", "urllib"}
SERIES = {"open", "high", "low", "close", "volume", "spread", "ms"}
#: Names of numpy that reach files or the system.
FILE_NAMES = {"DataSource", "ctypeslib", "dump", "f2py", "fromfile", "fromregex", "genfromtxt", "lib", "load", "loadtxt", "memmap", "open_memmap", "save", "savetxt", "savez", "savez_compressed", "testing", "tofile"}
#: Built-ins that a signal's source sees.
ALLOWED = {
    f.__name__: f
    for f in (
        abs, all, any, bool, dict, divmod, enumerate, filter, float, hasattr, int, isinstance, len, list, map, max, min, pow, print, range, reversed, round, set,
        sorted, str, sum, tuple, type, zip, ArithmeticError, Exception, IndexError, KeyError, TypeError, ValueError, ZeroDivisionError,
    )
} | {"True": True, "False": False, "None": None}


def ema_cross(bars: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Enter when the fast EMA crosses the slow one; stops and targets in ATRs. p: fast, slow, atr_len, stop_mult, rr."""
    b = ind.recursive(bars, {"_fast": ("ema", p["fast"]), "_slow": ("ema", p["slow"]), "_atr": ("atr", p["atr_len"])})
    above = F.coalesce(F.col("_fast") > F.col("_slow"), F.lit(False))
    was = F.lag(above).over(ind.by_time())
    warm = F.col("_fast").isNotNull() & F.col("_slow").isNotNull() & F.col("_atr").isNotNull()
    stop = F.coalesce(F.col("_atr"), F.lit(0.0)) * p["stop_mult"]
    cross = lambda now, before: F.coalesce(now & before & warm, F.lit(False))
    return b.select(*bars.columns, cross(above, ~was).alias("long_entry"), cross(~above, was).alias("short_entry"), stop.alias("stop_distance"), (stop * p["rr"]).alias("target_distance"))


def stretch(bars: DataFrame, p: dict[str, Any]) -> DataFrame:
    """Take the other side when the close is entry_z ATRs from its mean, in given hours; aim back at the mean.

    p: lookback, atr, entry_z, stop_mult, capture, min_target, from_hour, to_hour.
    """
    b = ind.recursive(bars, {"_atr": ("atr", p["atr"])}).withColumn("_basis", ind.sma(F.col("close"), p["lookback"]))
    good = F.coalesce((F.col("_atr") > 0) & F.col("_basis").isNotNull(), F.lit(False))
    safe = F.when(good, F.col("_atr")).otherwise(1.0)
    away = F.col("close") - F.col("_basis")
    z, open_ = away / safe, in_hours(F.col("ms"), p["from_hour"], p["to_hour"])
    target = F.greatest(F.abs(away) * p["capture"], safe * p["min_target"])
    return b.select(
        *bars.columns,
        F.coalesce((z < -p["entry_z"]) & open_ & good, F.lit(False)).alias("long_entry"), F.coalesce((z > p["entry_z"]) & open_ & good, F.lit(False)).alias("short_entry"),
        (safe * p["stop_mult"]).alias("stop_distance"), F.when(F.col("_basis").isNotNull(), target).alias("target_distance"),
    )


def ema_cross_arrays(bars: Any, p: dict[str, Any]) -> dict[str, np.ndarray]:
    """The same as ``ema_cross`` for one series in memory."""
    fast, slow = ind.ema_array(bars.close, p["fast"]), ind.ema_array(bars.close, p["slow"])
    atr = ind.atr_array(bars.high, bars.low, bars.close, p["atr_len"])
    above, ok = fast > slow, ~(np.isnan(fast) | np.isnan(slow) | np.isnan(atr))
    was = np.concatenate(([False], above[:-1]))
    first = np.arange(len(above)) > 0
    stop = np.nan_to_num(atr) * p["stop_mult"]
    return {"long_entry": above & ~was & ok & first, "short_entry": ~above & was & ok, "stop_distance": stop, "target_distance": stop * p["rr"]}


def stretch_arrays(bars: Any, p: dict[str, Any]) -> dict[str, np.ndarray]:
    """The same as ``stretch`` for one series in memory."""
    basis, atr = ind.sma_array(bars.close, p["lookback"]), ind.atr_array(bars.high, bars.low, bars.close, p["atr"])
    good = (atr > 0) & ~np.isnan(basis)
    safe = np.where(good, atr, 1.0)
    hour, a, b = bars.ms // HOUR % 24, p["from_hour"], p["to_hour"]
    open_ = np.ones(len(hour), bool) if a == b else (hour >= a) | (hour < b) if a > b else (hour >= a) & (hour < b)
    away = bars.close - basis
    return {"long_entry": (away / safe < -p["entry_z"]) & open_ & good, "short_entry": (away / safe > p["entry_z"]) & open_ & good, "stop_distance": safe * p["stop_mult"], "target_distance": np.maximum(np.abs(away) * p["capture"], safe * p["min_target"])}


@dataclass
class Verdict:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def validate_source(source: str) -> Verdict:
    """Whether the source of a ``signal(bars, p)`` may run: no imports, no barred names, no look ahead.

    A return that can't be read gives a warning. Nothing of the source is executed.
    """
    out = Verdict()
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return Verdict([f"line {e.lineno}: {e.msg}"])
    series = _series_names(tree)
    for node in ast.walk(tree):
        at = f"line {getattr(node, 'lineno', 0)}"
        if isinstance(node, ast.Import | ast.ImportFrom):
            out.errors.append(f"{at}: imports are not allowed")
        elif isinstance(node, ast.Name) and (node.id in BARRED_NAMES or node.id in BARRED_MODULES):
            out.errors.append(f"{at}: {node.id} is not allowed")
        elif isinstance(node, ast.Attribute) and node.attr.startswith("__"):
            out.errors.append(f"{at}: {node.attr} is not allowed")
        elif isinstance(node, ast.Attribute) and node.attr in FILE_NAMES:
            out.errors.append(f"{at}: {node.attr} reads or writes files")
        elif isinstance(node, ast.Call) and (getattr(node.func, "attr", None) or getattr(node.func, "id", None)) == "roll" and _rolls_ahead(node):
            out.errors.append(f"{at}: {ast.unparse(node)} moves later bars to earlier places")
        elif isinstance(node, ast.Subscript) and (isinstance(node.value, ast.Attribute) and node.value.attr in SERIES or isinstance(node.value, ast.Name) and node.value.id in series):
            if why := _ahead(node.slice):
                out.errors.append(f"{at}: {ast.unparse(node)} {why}")
    found = [n for n in tree.body if isinstance(n, ast.FunctionDef) and n.name == "signal"]
    if not found:
        out.errors.append("there is no function signal(bars, p)")
        return out
    fn = found[-1]
    if len(fn.args.args) != 2 or fn.args.vararg or fn.args.kwonlyargs:
        out.errors.append("signal takes exactly bars and p")
    returned = [n.value for n in ast.walk(fn) if isinstance(n, ast.Return)]
    if not returned:
        out.errors.append("signal returns nothing")
    for value in returned:
        if isinstance(value, ast.Dict) and all(isinstance(k, ast.Constant) for k in value.keys):
            if missing := sorted(set(SIGNALS) - {k.value for k in value.keys}):
                out.errors.append(f"the returned dict lacks {', '.join(missing)}")
        else:
            out.warnings.append(f"line {value.lineno if value else fn.lineno}: the returned keys can't be read")
    return out


def _series_names(tree: ast.AST) -> set[str]:
    """Names that are given a series (``c = bars.close``), straight or by way of another such name."""
    names: set[str] = set()
    is_series = lambda e: isinstance(e, ast.Attribute) and e.attr in SERIES or isinstance(e, ast.Name) and e.id in names
    while True:
        found = set(names)
        for node in ast.walk(tree):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign | ast.NamedExpr) and node.value else []
            for target in targets:
                sides = zip(target.elts, node.value.elts, strict=False) if isinstance(target, ast.Tuple | ast.List) and isinstance(node.value, ast.Tuple | ast.List) else [(target, node.value)]
                found |= {t.id for t, v in sides if isinstance(t, ast.Name) and is_series(v)}
        if found == names:
            return names
        names = found


def _ahead(index: ast.expr) -> str:
    """Why an index into a series may reach past the current bar; empty if it can't. What can't be read as constant counts as reaching."""
    if isinstance(index, ast.Slice):
        if index.lower is not None and not (isinstance(index.lower, ast.Constant) and index.lower.value in (0, None)):
            return "shifts later bars to earlier places, or reads from the end"
        step = index.step
        if step is not None and not (isinstance(step, ast.Constant) and isinstance(step.value, int) and step.value > 0):
            return "reads backwards"
        return ""
    if isinstance(index, ast.Tuple):
        return next((why for e in index.elts if (why := _ahead(e))), "")
    for node in ast.walk(index):
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return "reads a later bar"
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) or isinstance(node, ast.Constant) and isinstance(node.value, int) and node.value < 0:
            return "reads a later bar, or from the end"
    return ""


def _rolls_ahead(call: ast.Call) -> bool:
    """Whether a call of roll moves values to earlier places, or may."""
    shift = call.args[1] if len(call.args) > 1 else next((k.value for k in call.keywords if k.arg == "shift"), None)
    return not (isinstance(shift, ast.Constant) and isinstance(shift.value, int) and shift.value >= 0)


def compile_source(source: str):
    """``signal`` of a source that passes ``validate_source``; it sees numpy, the indicators and plain built-ins."""
    verdict = validate_source(source)
    if not verdict.ok:
        raise ValueError("; ".join(verdict.errors))
    names: dict[str, Any] = {"__builtins__": ALLOWED, "np": np} | {k: getattr(ind, f"{k}_array") for k in ("sma", "ema", "rma", "rsi", "atr")} | {f"{k}_fast": getattr(ind, f"{k}_array") for k in ("sma", "ema", "rma", "rsi", "atr")} | {"true_range": ind.tr_array, "true_range_fast": ind.tr_array}
    exec(compile(source, "<signal>", "exec"), names)  # noqa: S102
    return names["signal"]


def evaluate_signal(fn: Any, bars: SimpleNamespace, p: dict[str, Any]) -> dict[str, np.ndarray]:
    """The four arrays of a signal function, checked for presence and length."""
    got = fn(bars, p)
    if missing := sorted(set(SIGNALS) - set(got)):
        raise ValueError(f"signal did not return {', '.join(missing)}")
    out = {k: np.asarray(got[k], bool if k.endswith("entry") else float) for k in SIGNALS}
    for k, v in out.items():
        if len(v) != len(bars.close):
            raise ValueError(f"{k} has {len(v)} values for {len(bars.close)} bars")
    return out


def arrays_of(pdf: Any) -> SimpleNamespace:
    """Bars as arrays, for signal functions; volume is there too."""
    return SimpleNamespace(ms=pdf["ms"].to_numpy(np.int64), **{c: pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume", "spread") if c in pdf})
