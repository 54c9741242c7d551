"""Asset returns per period, risk regime scores and their correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import regime_label
from .separation import MIN_ROWS, periods

RISK_ON, RISK_OFF, OTHER = ("Brand#1", "Brand#2", "Brand#3"), ("Brand#4", "Brand#5", "Brand#6"), ("Brand#7",)


def period_returns(prices: DataFrame, key: str = "asset") -> DataFrame:
    """First to last non-null close in each period, percent with 2 decimals."""
    rows = prices.where("close is not null").join(periods(prices.sparkSession), F.col("session").between(F.col("first"), F.col("last")))
    out = rows.groupBy("period", key).agg(F.count("*").alias("n"), F.min_by("close", "session").alias("a"), F.max_by("close", "session").alias("b")).where(F.col("n") >= MIN_ROWS)
    return out.select("period", key, F.round((F.try_divide("b", "a") - 1) * 100, 2).alias("return_pct"))


def scores(returns: DataFrame, on: tuple[str, ...], off: tuple[str, ...], key: str = "asset") -> DataFrame:
    """Mean of the risk-on assets less that of the defensive ones; NULL if a side is empty."""
    side = lambda names: F.avg(F.when(F.col(key).isin(*names), F.col("return_pct")))
    out = returns.groupBy("period").agg(F.round(side(on) - side(off), 2).alias("score"))
    return out.withColumn("regime", regime_label(F.col("score"))).withColumn("rotation", F.coalesce(F.col("score") < 0, F.lit(False)))


def correlations(rows: DataFrame, pairs: list[tuple[str, str]], least: int = 4) -> DataFrame:
    """Pearson correlations over complete pairs; NULL below ``least`` of them."""
    cells = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        cells.append(F.when(F.count_if(both) >= least, F.round(F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))), 6)).alias(f"corr_{a}_{b}"))
    return rows.agg(*cells)


def against(scored: DataFrame, constants: DataFrame) -> DataFrame:
    """Regime rows with a table of constants by period; periods without constants go."""
    return scored.join(F.broadcast(constants), "period").orderBy("period")
