"""The alert state machine: streaks, cooldown and the crossing into persistence.

``step`` is the transition of one (ticker, session); ``fold`` replays a ticker's
sessions in a batch, ``quillpanel.streaming.alerts`` keeps the same state in a
stream.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COOLDOWN_DAYS, PRUNE_DAYS, STREAK_DAYS, STREAK_MIN

OUTPUT = "ticker string, session date, streak int, span int, emailed boolean, crossed boolean"


@dataclass
class State:
    dates: list[str] = field(default_factory=list)
    first_seen: str | None = None
    emailed: str | None = None
    notified: bool = False

    def to_dict(self) -> dict:
        return asdict(self)


def _parsed(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text or "")
    except ValueError:
        return None


def prune(dates: list[str], today: date, keep: int = PRUNE_DAYS) -> list[str]:
    """Distinct well-formed dates of the last ``keep`` days, sorted."""
    return sorted({d for d in dates if (p := _parsed(d)) and p >= today - timedelta(days=keep)})


def streak(dates: list[str], today: date, window: int = STREAK_DAYS) -> tuple[int, int]:
    """Qualifying dates in the window (inclusive) and days from the earliest of them."""
    got = [p for d in dates if (p := _parsed(d)) and p >= today - timedelta(days=window)]
    return (len(got), (today - min(got)).days + 1) if got else (0, 0)


def step(state: State, today: date, least: int = STREAK_MIN, cooldown: int = COOLDOWN_DAYS) -> tuple[State, dict]:
    day = today.isoformat()
    dates = prune([*state.dates, day], today)
    count, span = streak(dates, today)
    notified = state.notified and count >= least
    last = _parsed(state.emailed)
    send, crossed = last is None or (today - last).days >= cooldown, False
    if not send and count >= least and not notified:
        send = notified = crossed = True
    after = State(dates, state.first_seen or day, day if send else state.emailed, notified)
    return after, {"session": today, "streak": count, "span": span, "emailed": send, "crossed": crossed}


def fold(sessions: DataFrame, least: int = STREAK_MIN, cooldown: int = COOLDOWN_DAYS) -> DataFrame:
    """sessions: ticker, session.  One row per session in order; a ticker's own history bounds a task."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = State(), []
        for d in sorted(rows["session"]):
            state, row = step(state, d, least, cooldown)
            out.append({"ticker": rows["ticker"].iloc[0], **row})
        return pd.DataFrame(out)

    return sessions.groupBy("ticker").applyInPandas(replay, OUTPUT)


def streaks(sessions: DataFrame, window: int = STREAK_DAYS) -> DataFrame:
    """Streak count and span per (ticker, session) by a range window over days, without state."""
    day = F.datediff("session", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("ticker").orderBy("day").rangeBetween(-window, 0)
    rows = sessions.distinct().withColumn("day", day)
    return rows.select("ticker", "session", F.count("*").over(w).alias("streak"), (F.col("day") - F.min("day").over(w) + 1).alias("span"))
