"""Run-log monitoring: stale runs, weekly summary, missing sessions, match days, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LOG_CAP, STREAK_DAYS, STREAK_MIN
from ..functions.labels import health


def stale(log: DataFrame, cap: int = LOG_CAP) -> DataFrame:
    """An ok run dated no later than the entry before it (of any status) is stale; the newest ``cap`` entries stay."""
    newest = log.orderBy(F.col("position").desc()).limit(cap + 1)
    before = F.lag("date").over(Window.orderBy("position"))  # over cap + 1 rows at most
    out = newest.withColumn("status", F.when((F.col("status") == "ok") & F.coalesce(F.col("date") <= before, F.lit(False)), "stale").otherwise(F.col("status")))
    return out.orderBy(F.col("position").desc()).limit(cap)


def session_date(text: Column, clock: Column | None = None) -> Column:
    """The session that a run describes: its bar date where that is a date, else the clock."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.current_date() if clock is None else clock)


def anchor(log: DataFrame, clock: Column | None = None) -> DataFrame:
    """The newest date of the log; of an empty log, the clock."""
    newest = F.max(F.to_date("date"))
    return log.agg((newest if clock is None else F.coalesce(newest, clock)).alias("anchor"))


def _window(log: DataFrame, days: int, clock: Column | None = None) -> DataFrame:
    rows = log.crossJoin(F.broadcast(anchor(log, clock)))
    return rows.where(F.col("date").between(F.date_sub("anchor", days - 1), F.col("anchor")) & (F.weekday("date") < 5))


def missing_sessions(log: DataFrame, days: int = 7) -> DataFrame:
    """Weekdays of the window without any run."""
    wanted = anchor(log).select(F.explode(F.sequence(F.date_sub("anchor", days - 1), F.col("anchor"))).alias("date")).where(F.weekday("date") < 5)
    return wanted.join(log.select("date"), "date", "left_anti")


def weekly_summary(log: DataFrame, clock: Column, days: int = 7) -> DataFrame:
    """One row: expected and actual runs, counts by status, lag of the newest bar (against the clock), health."""
    rows = _window(log, days, clock)
    is_ = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_runs")
    out = rows.agg(F.count_distinct("date").alias("actual_runs"), is_("ok"), is_("error"), is_("stale"))
    base = anchor(log, clock).select("anchor", F.datediff(clock, "anchor").alias("lag_days"), F.size(F.filter(F.sequence(F.date_sub("anchor", days - 1), F.col("anchor")), lambda d: F.weekday(d) < 5)).alias("expected_runs"))
    out = base.crossJoin(out).withColumn("missing_runs", F.col("expected_runs") - F.col("actual_runs"))
    return out.withColumn("health", health(F.col("error_runs"), F.col("lag_days"), F.col("missing_runs")))


def match_days(log: DataFrame, matches: DataFrame, days: int = 7) -> DataFrame:
    """Distinct dates of ok runs in the window on which each ticker matched (matches: date, ticker)."""
    ok = _window(log, days).where("status = 'ok'").select("date").distinct()
    return matches.join(ok, "date", "left_semi").groupBy("ticker").agg(F.count_distinct("date").alias("days"))


def persistent_names(sessions: DataFrame, days: int = STREAK_DAYS, least: int = STREAK_MIN) -> DataFrame:
    """Tickers with enough qualifying dates since the newest session less ``days``."""
    newest = F.broadcast(sessions.agg(F.max("session").alias("anchor")))
    rows = sessions.crossJoin(newest).where(F.col("session") >= F.date_sub("anchor", days))
    return rows.groupBy("ticker").agg(F.count_distinct("session").alias("days")).where(F.col("days") >= least)
