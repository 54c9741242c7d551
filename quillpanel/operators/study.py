"""Summaries of backtests: horizons, categories, thresholds, sizes, persistence, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HORIZONS, PRICE_GRID, VOLUME_GRID, SignalSpec
from ..functions import labels
from . import signals


def r6(x: Column) -> Column:
    return F.round(x, 6) + 0.0


def share(cond: Column) -> Column:
    """Percent of rows where cond holds; NULL counts as no."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double")) * 100


def horizon_summary(trades: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Each measure over its own non-null subset."""
    parts = ", ".join(f"{h}, fwd_{h}d_pct, base_{h}d_pct, excess_{h}d_pct" for h in horizons)
    long = trades.selectExpr(f"stack({len(horizons)}, {parts}) as (horizon, fwd, base, excess)")
    hit = lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double"))) * 100
    return long.groupBy("horizon").agg(
        F.count("fwd").alias("n"), r6(F.avg("fwd")).alias("mean_pct"), r6(F.median("fwd")).alias("median_pct"), r6(F.avg("base")).alias("base_pct"),
        r6(F.avg("excess")).alias("excess_pct"), r6(hit("fwd")).alias("hit_pct"), r6(hit("excess")).alias("beat_pct"), F.max("fwd").alias("max_pct"), F.min("fwd").alias("min_pct"),
    )


def by_category(trades: DataFrame, h: int = 20) -> DataFrame:
    """A null outcome counts as a miss here."""
    return trades.groupBy("category").agg(F.count("*").alias("n"), r6(F.avg(f"fwd_{h}d_pct")).alias("mean_pct"), r6(F.avg(f"excess_{h}d_pct")).alias("excess_pct"), r6(share(F.col(f"fwd_{h}d_pct") > 0)).alias("hit_pct"))


def grid(spark: SparkSession, volumes: tuple[float, ...], prices: tuple[float, ...]) -> DataFrame:
    return spark.createDataFrame([(float(v), float(p)) for v in volumes for p in prices], "vol_thr double, price_thr double")


def sweep_thresholds(rows: DataFrame, spec: SignalSpec, volumes: tuple[float, ...] = VOLUME_GRID, prices: tuple[float, ...] = PRICE_GRID, h: int = 20, least: int = 10) -> DataFrame:
    """Spacing is redone per grid cell; candidates are cut by the laxest cell before the grid is joined."""
    cells = F.broadcast(grid(rows.sparkSession, volumes, prices))
    base = signals.baseline(rows, (h,))
    lax = rows.where((F.col("volume_ratio") >= min(volumes)) & (F.col("price_change") >= min(prices)))
    hits = lax.join(cells, (F.col("volume_ratio") >= F.col("vol_thr")) & (F.col("price_change") >= F.col("price_thr")))
    kept = signals.spaced(hits, spec.gap, ["ticker", "vol_thr", "price_thr"]).join(base, "session", "left")
    kept = kept.withColumn("fwd", F.round(F.col(f"fwd_{h}d") * 100, 2)).withColumn("excess", F.round((F.col(f"fwd_{h}d") - F.col(f"base_{h}d")) * 100, 2))
    return kept.where("excess is not null").groupBy("vol_thr", "price_thr").agg(
        F.count("*").alias("n"), r6(F.avg("fwd")).alias("mean_pct"), r6(F.avg("excess")).alias("excess_pct"), r6(share(F.col("excess") > 0)).alias("beat_pct")
    ).where(F.col("n") >= least)


def _bucketed(trades: DataFrame, bucket: Column, h: int, extremes: bool) -> DataFrame:
    rows = trades.where(f"excess_{h}d_pct is not null").withColumn("bucket", bucket)
    fwd, excess = F.col(f"fwd_{h}d_pct"), F.col(f"excess_{h}d_pct")
    more = [F.max(fwd).alias("max_pct"), F.min(fwd).alias("min_pct"), r6(F.median(excess)).alias("median_excess_pct")] if extremes else []
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg(fwd)).alias("mean_pct"), r6(F.median(fwd)).alias("median_pct"), r6(F.avg(excess)).alias("excess_pct"), r6(share(excess > 0)).alias("beat_pct"), *more)


def by_size(trades: DataFrame, h: int = 20) -> DataFrame:
    return _bucketed(trades, labels.size_bucket(F.col("cap_busd")), h, True)


def by_persistence(trades: DataFrame, h: int = 20) -> DataFrame:
    return _bucketed(trades, labels.persistence_bucket(F.col("days")), h, False)


def size_by_persistence(trades: DataFrame, h: int = 20) -> DataFrame:
    rows = trades.where(f"excess_{h}d_pct is not null").select(labels.size_bucket(F.col("cap_busd")).alias("size"), labels.persistence_bucket(F.col("days")).alias("persistence"), F.col(f"excess_{h}d_pct").alias("x"))
    names = {"1-2 days": "d1_2", "3-5 days": "d3_5", "6-9 days": "d6_9", "10+ days": "d10"}
    wide = rows.groupBy("size").pivot("persistence", list(names)).agg(r6(F.avg("x")).alias("mean"), F.count("x").alias("n"))
    return wide.select("size", *(F.col(f"{k}_mean").alias(f"{v}_mean") for k, v in names.items()), *(F.coalesce(F.col(f"{k}_n"), F.lit(0)).alias(f"{v}_n") for k, v in names.items()))


def without_top(trades: DataFrame, k: int = 3, h: int = 20) -> DataFrame:
    """Excess without the k tickers that contribute most of it."""
    rows = trades.where(f"excess_{h}d_pct is not null").withColumn("x", F.col(f"excess_{h}d_pct"))
    top = rows.groupBy("ticker").agg(F.sum("x").alias("s")).orderBy(F.round("s", 6).desc(), "ticker").limit(k)
    left = rows.join(F.broadcast(top), "ticker", "left_anti")
    measure = lambda d, name: d.agg(F.lit(name).alias("subset"), F.count("*").alias("n"), r6(F.avg("x")).alias("excess_pct"), r6(share(F.col("x") > 0)).alias("beat_pct"))
    return measure(rows, "all").unionByName(measure(left, f"without_top_{k}"))


def persistence_sweep(trades: DataFrame, ks: range = range(2, 15), least: int = 25, h: int = 20) -> DataFrame:
    rows = trades.where(f"excess_{h}d_pct is not null").select("days", F.col(f"excess_{h}d_pct").alias("x"))
    cells = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in ks], "k int"))
    above = F.col("days") >= F.col("k")
    a, b = F.when(above, F.col("x")), F.when(~above, F.col("x"))
    out = rows.join(cells).groupBy("k").agg(
        F.count(a).alias("n_above"), F.count(b).alias("n_below"), r6(F.avg(a)).alias("mean_above"), r6(F.avg(b)).alias("mean_below"), r6(F.avg(a) - F.avg(b)).alias("gap"),
        r6(F.avg(F.when(above, (F.col("x") > 0).cast("double"))) * 100).alias("beat_above"), r6(F.median(a)).alias("median_above"),
    )
    return out.where((F.col("n_above") >= least) & (F.col("n_below") >= least))


def groups(trades: DataFrame) -> DataFrame:
    """Rows once per overlapping group: all, and original or added."""
    return trades.withColumn("grp", F.explode(F.array(F.lit("all"), F.when(F.col("in_original"), "original").otherwise("added"))))


def universe_bias(trades: DataFrame, h: int = 20, k: int = 8, least: int = 10) -> DataFrame:
    rows = groups(trades.where(f"excess_{h}d_pct is not null")).withColumn("x", F.col(f"excess_{h}d_pct"))
    long, brief = F.when(F.col("days") >= k, F.col("x")), F.when(F.col("days") < k, F.col("x"))
    gap = F.when((F.count(long) >= least) & (F.count(brief) >= least), r6(F.avg(long) - F.avg(brief)))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), r6(F.avg("x")).alias("mean"), r6(F.median("x")).alias("median"), r6(share(F.col("x") > 0)).alias("beat_pct"), gap.alias("persistent_gap"))




def ranked(table: DataFrame, measure: str, *ties: str, n: int | None = None) -> DataFrame:
    """A summary table by a measure, largest first, and of it the first n rows."""
    out = table.orderBy(F.col(measure).desc_nulls_last(), *ties)
    return out.limit(n) if n else out


def estimated_cap(trades: DataFrame, shares: DataFrame) -> DataFrame:
    """Adds est_cap_busd, price times current shares in billions; zero shares count as missing."""
    own = shares.select("ticker", F.nullif("shares", F.lit(0)).alias("shares"))
    return trades.join(own, "ticker", "left").withColumn("est_cap_busd", F.col("price") * F.col("shares") / 1e9).drop("shares")


def best_gap(swept: DataFrame) -> DataFrame:
    """The persistence threshold with the largest gap; ties go to the smaller one."""
    return swept.orderBy(F.col("gap").desc_nulls_last(), "k").limit(1)
