"""Buckets, labels and verdicts as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_bucket(cap: Column) -> Column:
    """By market capitalisation in billions."""
    return F.when(cap.isNull(), "unknown").when(cap < 2, "small (<2B)").when(cap < 10, "mid (2-10B)").when(cap < 50, "large (10-50B)").otherwise("mega (50B+)")


def persistence_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= 2, "1-2 days").when(days <= 5, "3-5 days").when(days <= 9, "6-9 days").otherwise("10+ days")


def streak_label(count: Column, span: Column, least: int) -> tuple[Column, Column]:
    text = F.format_string("%d qualifying days in %d", count, span)
    level = F.when(count <= 1, "new").when(count >= least, "strong").otherwise("building")
    return F.when(count <= 1, F.lit("first qualifying day")).otherwise(text), level


def regime_label(score: Column) -> Column:
    return F.when(score.isNull(), "?").when(score >= 8, "strong risk-on").when(score >= 2, "risk-on").when(score > -2, "mixed").when(score > -8, "risk-off").otherwise("strong risk-off")


def health(errors: Column, lag: Column, missing: Column, most_lag: int = 3) -> Column:
    return F.when(errors > 0, "ERRORS").when(lag > most_lag, "STALLED").when(missing > 0, "GAPS").otherwise("OK")


def interval_verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "above zero").when(high < 0, "below zero").otherwise("includes zero")


def formatted(x: Column, spec: str, prefix: str = "", suffix: str = "") -> Column:
    return F.coalesce(F.when(x.isNotNull(), F.format_string(f"{prefix}{spec}{suffix}", x)), F.lit("n/a"))


def resolved_cap(info: Column) -> Column:
    """First usable of the capitalisation keys of a quote map; zero counts as missing."""
    key = lambda k: F.nullif(F.try_element_at(info, F.lit(k)), F.lit(0.0))
    return F.coalesce(key("marketCap"), key("market_cap"), key("shares") * key("lastPrice"))


def outcome(move: Column, bar: float) -> Column:
    return F.when(move >= bar, "rise").when(move <= -bar, "fall").when(move.isNotNull(), "flat")
