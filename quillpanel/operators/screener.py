"""The daily screen: newest-bar metrics, trailing cash flow, four gates, near misses, quality guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MIN_CAP, SignalSpec
from ..functions import rolling as R
from ..sources.tables import with_history


def newest(bars: DataFrame, spec: SignalSpec) -> DataFrame:
    """Metrics of the newest bar of each ticker with enough history and a positive baseline."""
    rows = with_history(bars, spec.recent + spec.base + 1).withColumn("dv", F.col("close") * F.col("volume"))
    base = R.lagged_mean("dv", spec.recent, spec.base) if spec.separate else R.mean("dv", spec.base)
    rows = rows.withColumns({"recent_dv": R.mean("dv", spec.recent), "base_dv": base, "price_change": R.change("close", spec.recent)})
    return rows.where("rn = n_bars and base_dv > 0").withColumn("volume_ratio", R.divide(F.col("recent_dv"), F.col("base_dv")))


def trailing_cash(statements: DataFrame, labels: list[str], quarters: int = 4) -> DataFrame:
    """Per ticker the sum of the newest quarters of the first label with any; NULL if that label has too few."""
    order = F.create_map(*(F.lit(x) for k, name in enumerate(labels) for x in (name, k)))
    rows = statements.where(F.col("value").isNotNull() & F.col("label").isin(*labels)).withColumn("priority", order[F.col("label")])
    newest_first = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("quarter", "value")))), 1, quarters)
    by_label = rows.groupBy("ticker", "priority").agg(newest_first.alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x["value"])
    first = by_label.groupBy("ticker").agg(F.min_by(F.when(F.size("q") >= quarters, total), "priority").alias("cash"))
    return first


def screen(bars: DataFrame, universe: DataFrame, cash: DataFrame, spec: SignalSpec, cash_required: bool = True, min_cap: float = MIN_CAP) -> DataFrame:
    """One row per screened ticker with its four gates (on unrounded values) and MATCH."""
    rows = newest(bars, spec).join(universe, "ticker", "left").join(cash, "ticker", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    gates = {
        "pass_volume": no(F.col("volume_ratio") >= spec.volume), "pass_price": no(F.col("price_change") >= spec.price),
        "pass_cfo": no(F.col("cash") > 0) if cash_required else F.lit(True), "pass_cap": F.coalesce("cap_busd", F.lit(0.0)) >= min_cap,
    }
    rows = rows.withColumns(gates)
    return rows.select(
        "ticker", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("exchange", F.lit("")).alias("exchange"), R.cents("close").alias("price"), F.round(F.col("price_change") * 100, 1).alias("price_change_pct"),
        F.round("volume_ratio", 2).alias("volume_ratio"), F.round(F.col("recent_dv") / 1e6, 1).alias("recent_dollar_vol_musd"), F.round(F.col("cash") / 1e6, 1).alias("ttm_cfo_musd"),
        F.round("cap_busd", 2).alias("market_cap_busd"), *gates, F.expr("pass_volume and pass_price and pass_cfo and pass_cap").alias("is_match"), F.col("session").alias("bar_date"),
    )


def near_misses(results: DataFrame, spec: SignalSpec, n: int = 3) -> DataFrame:
    """Closest non-matches that pass the cash gate, by distance in rounded values; ties by ticker."""
    gap = lambda bar, x: F.greatest((F.lit(bar) - x) / bar, F.lit(0.0))
    rows = results.where("not is_match and pass_cfo and price_change_pct is not null")
    rows = rows.withColumn("distance", F.round(gap(spec.volume, F.col("volume_ratio")) + gap(spec.price * 100, F.col("price_change_pct")), 6))
    return rows.orderBy("distance", "ticker").limit(n).select("ticker", "volume_ratio", "price_change_pct", "distance")


def quality_guard(results: DataFrame, most: float = 0.10) -> DataFrame:
    """Rows, missing price changes and whether the share is acceptable."""
    missing = F.count_if(F.col("price_change_pct").isNull())
    return results.agg(F.count("*").alias("n"), missing.alias("missing"), (missing <= F.count("*") * most).alias("acceptable"))


def modal_session(results: DataFrame) -> DataFrame:
    """The most common bar date; ties go to the earliest."""
    return results.groupBy("bar_date").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "bar_date").limit(1)


def fresh_or_new(wanted: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cached fundamentals younger than ``days`` stay; the others take the new values and ``now``."""
    old = cache.select("ticker", F.col("cash").alias("old_cash"), F.col("cap_busd").alias("old_cap"), "fetched_at")
    fresh = F.coalesce(F.col("fetched_at") > now - F.make_dt_interval(F.lit(days)), F.lit(False))
    return wanted.join(old, "ticker", "left").select(
        "ticker", F.when(fresh, F.col("old_cash")).otherwise(F.col("cash")).alias("cash"), F.when(fresh, F.col("old_cap")).otherwise(F.col("cap_busd")).alias("cap_busd"),
        F.when(fresh, F.col("fetched_at")).otherwise(now).alias("fetched_at"), fresh.alias("reused"),
    )


def matches(results: DataFrame) -> DataFrame:
    """The matching rows, the largest (rounded) volume ratio first."""
    return results.where("is_match").orderBy(F.col("volume_ratio").desc(), "ticker")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache after a run: rows of ``fresh`` replace those of their ticker, the others stay."""
    return fresh.select(*cache.columns).unionByName(cache.join(fresh.select("ticker"), "ticker", "left_anti").select(*cache.columns))
