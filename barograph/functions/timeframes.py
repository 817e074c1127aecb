"""Names of bar widths, and what follows from a width."""

from __future__ import annotations

SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000

#: The vocabulary of timeframes. TICK has no width.
TIMEFRAMES: dict[str, int] = (
    {"TICK": 0}
    | {f"S{k}": k * SECOND for k in (1, 2, 5, 10, 15, 20, 30)}
    | {f"M{k}": k * MINUTE for k in (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30)}
    | {f"H{k}": k * HOUR for k in (1, 2, 3, 4, 6, 8, 12)}
    | {"D1": DAY, "W1": 7 * DAY}
)
#: Trading days a year, and trading weeks.
TRADING_DAYS, TRADING_WEEKS = 258, 52


def normal(name: str) -> str:
    """The name as the vocabulary has it; an unknown one raises ValueError."""
    key = name.strip().upper()
    if key not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {name!r}; known: {', '.join(TIMEFRAMES)}")
    return key


def timeframe_ms(name: str) -> int:
    return TIMEFRAMES[normal(name)]


def name_of(ms: int) -> str:
    return next((k for k, v in TIMEFRAMES.items() if v == ms), f"{ms}ms")


def bars_per_year(name: str) -> float:
    """Bars that a trading year of 258 days of 24 hours has; a week has no partial year: 52."""
    key = normal(name)
    if key == "TICK":
        raise ValueError("ticks have no yearly count")
    return float(TRADING_WEEKS) if key == "W1" else TRADING_DAYS * DAY / TIMEFRAMES[key]


def base_for(timeframe: str, requested: str = "") -> str:
    """The width that bars are stored at: the requested one, or M1, or the timeframe if that is finer."""
    want = timeframe_ms(timeframe) if timeframe else MINUTE
    if requested:
        if timeframe_ms(requested) > want:
            raise ValueError(f"bars of {normal(requested)} can't make finer ones of {normal(timeframe)}")
        return normal(requested)
    return normal(timeframe) if want < MINUTE else "M1"


def serves(resolution_ms: int, timeframe: str) -> bool:
    """Whether data of this resolution can make bars of the timeframe."""
    return resolution_ms <= timeframe_ms(timeframe)


def assert_serves(resolution_ms: int, timeframe: str) -> None:
    if not serves(resolution_ms, timeframe):
        raise ValueError(f"a source of {name_of(resolution_ms)} bars can't make {normal(timeframe)} bars")


def served_by(base: str) -> list[str]:
    return [k for k, v in TIMEFRAMES.items() if v >= timeframe_ms(base) and v > 0]
