"""Streams: alert state per ticker, and idempotent archiving of late sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import COOLDOWN_DAYS, STREAK_MIN
from ..operators import archive
from ..operators.alerts import OUTPUT, State, step


def alert_stream(sessions: DataFrame, least: int = STREAK_MIN, cooldown: int = COOLDOWN_DAYS) -> DataFrame:
    """sessions: a stream of (ticker, session).  Emits what the batch fold emits for sessions in order."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = State(**json.loads(kept.get[0])) if kept.exists else State()
        days = sorted({d for f in frames for d in f["session"]})
        rows = []
        for d in days:
            if state.dates and d.isoformat() <= state.dates[-1]:
                continue  # a session seen before, or one that comes after a newer one
            state, row = step(state, d, least, cooldown)
            rows.append({"ticker": key[0], **row})
        kept.update((json.dumps(state.to_dict()),))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return sessions.groupBy("ticker").applyInPandasWithState(update, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def archive_stream(rows: DataFrame, path: str, checkpoint: str, delay: str = "5 days") -> StreamingQuery:
    """Write a stream of (as_of, ticker, ...) by batch and session; a repeated batch overwrites only itself."""
    late = rows.withColumn("at", F.col("as_of").cast("timestamp")).withWatermark("at", delay).dropDuplicates(["ticker", "at"]).drop("at")

    def put(batch: DataFrame, number: int) -> None:
        archive.write(batch, f"{path}/batch={number}")

    return late.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
