"""What a run needs to know of the traded instrument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Instrument:
    """Defaults are fixed values. ``contract_size`` is informative: P&L comes from tick value and tick size."""

    contract_size: float = 100.0
    tick_size: float = 0.001
    tick_value: float = 0.10
    lot_min: float = 0.01
    lot_step: float = 0.01
    lot_max: float = 100.0
    commission: float = 3.5
    default_spread: float = 0.30
    stops_level: float = 0.0

    @property
    def value_per_unit(self) -> float:
        """Money that one lot makes when the price moves by 1."""
        return self.tick_value / self.tick_size


#: Exit reasons of a trade (fixed values).
STOP, TARGET, SIGNAL, END = 1, 2, 3, 4
REASONS = {STOP: "stop", TARGET: "target", SIGNAL: "signal", END: "end of data"}
