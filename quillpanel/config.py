"""Parameters, passed explicitly; nothing here is read from the environment at run time."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SignalSpec:
    """Surge of dollar volume together with a price move over the recent window."""

    recent: int = 10
    base: int = 30
    separate: bool = True
    volume: float = 1.75
    price: float = 0.07
    gap: int = 10


LIVE = SignalSpec()
LEGACY = SignalSpec(base=63, separate=False, volume=1.5)
#: Lower bars, for studies of persistence on test panels.
LOOSE = SignalSpec(volume=1.2, price=0.03)

HORIZONS = (5, 10, 20, 30)
MOVE = 0.10
MIN_CAP = 0.0
STREAK_DAYS, STREAK_MIN, PRUNE_DAYS, COOLDOWN_DAYS, LOG_CAP = 14, 8, 90, 1, 400
VOLUME_GRID = (1.25, 1.5, 1.75, 2.0, 2.5)
PRICE_GRID = (0.03, 0.05, 0.07, 0.10, 0.15)
#: The window pairs (recent, base) and triggers of the sweep.
WINDOW_GRID = ((10, 63), (5, 63), (3, 63), (2, 63), (10, 30), (10, 20), (5, 30), (5, 20), (3, 30), (3, 20), (2, 20))
TRIGGERS = (1.20, 1.35, 1.50, 1.75)
PREREGISTERED = ((10, 30, 1.75), (10, 20, 1.5), (5, 20, 1.5))
PERIODS = (
    ("1998H2", "1998-07-01", "1998-12-31"), ("1999H1", "1999-01-01", "1999-06-30"), ("1999H2", "1999-07-01", "1999-12-31"),
    ("2000H1", "2000-01-01", "2000-06-30"), ("2000H2", "2000-07-01", "2000-12-31"), ("2001H1", "2001-01-01", "2001-06-30"),
)


def env_flag(value: str | None, default: bool) -> bool:
    """1/true/yes/on and 0/false/no/off in any case; anything else keeps the default."""
    word = (value or "").strip().lower()
    return True if word in ("1", "true", "yes", "on") else False if word in ("0", "false", "no", "off") else default
