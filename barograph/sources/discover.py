"""Finding files that look like ticks or bars, on the driver's own file system."""

from __future__ import annotations

import os
from pathlib import Path

from barograph.sources.csv_source import BAR, TICK, TIMES

SUFFIXES = (".csv", ".txt", ".tsv")


def sniff(path: str | Path) -> str | None:
    """tick, bar or None, from the first line."""
    with open(path, encoding="utf-8-sig", errors="replace") as f:
        line = f.readline(4096).strip()
    cells = [c.strip().strip('"').lower().replace(" ", "").replace("_", "") for c in line.split("\t" if "\t" in line else ",")]
    if not 2 <= len(cells) <= 24 or not set(cells) & set(TIMES):
        return None
    has = lambda fields: sum(any(n in cells for n in names) for names in fields.values())
    prices = {k: v for k, v in BAR.items() if k in ("open", "high", "low", "close")}
    return "bar" if has(prices) == 4 else "tick" if has(TICK) == 2 else None


def discover(folders: list[str], least_bytes: int = 1 << 20, depth: int = 3, most: int = 40) -> list[dict]:
    """path, bytes, kind of likely files, the largest first."""
    found: dict[str, dict] = {}
    for top in folders:
        base = len(Path(top).resolve().parts)
        for at, dirs, names in os.walk(top):
            if len(Path(at).resolve().parts) - base >= depth:
                dirs.clear()
            for n in names:
                p = Path(at, n).resolve()
                if p.suffix.lower() in SUFFIXES and p.stat().st_size >= least_bytes and (kind := sniff(p)):
                    found[str(p)] = {"path": str(p), "bytes": p.stat().st_size, "kind": kind}
    return sorted(found.values(), key=lambda x: -x["bytes"])[:most]
