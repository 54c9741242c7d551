"""Sources: bars, dimensions, statements, and small state files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(rows: DataFrame) -> DataFrame:
    """rows, read from a checkpoint where the session has a folder for them; for what several branches of a plan read."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows


def ticker(key: str) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 6, "0"))


def bars_from_lines(lines: DataFrame) -> DataFrame:
    """Daily bars (ticker, session, close, high, low, volume); incomplete bars are dropped.

    Prices are added up as decimals, so a mean does not depend on how the lines are dealt out.
    """
    cents = F.col("l_extendedprice").try_cast("decimal(15,2)")
    # dealt out by ticker once: bars and all windows of a ticker come of this exchange
    dealt = lines.select(ticker("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("session"), "l_extendedprice", "l_quantity").repartition("ticker")
    bars = dealt.groupBy("ticker", "session").agg(
        (F.sum(cents).cast("double") / F.count(cents)).alias("close"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.sum("l_quantity").alias("volume")
    )
    return clean(bars)


def clean(bars: DataFrame) -> DataFrame:
    """NaN becomes NULL; rows without close or volume go."""
    for c in ("close", "high", "low", "volume"):
        bars = bars.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return bars.na.drop(subset=["close", "volume"])


def with_history(bars: DataFrame, least: int) -> DataFrame:
    """Row numbers and bar counts; tickers with fewer bars go."""
    own = Window.partitionBy("ticker")
    out = bars.withColumn("rn", F.row_number().over(own.orderBy("session")).cast("bigint")).withColumn("n_bars", F.count("*").over(own))
    return out.where(F.col("n_bars") >= least)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_lines(read(spark, sf_dir, "lineitem"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, category, exchange, in_original, cap_busd, position."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    out = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return out.select(
        ticker("s_suppkey").alias("ticker"), F.col("r_name").alias("category"), F.when(F.col("s_suppkey") % 2 == 0, "NASDAQ").otherwise("NYSE").alias("exchange"),
        (F.col("s_suppkey") % 3 == 0).alias("in_original"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 100).alias("cap_busd"), F.col("s_suppkey").alias("position"),
    )


def pick(universe_rows: DataFrame, exchanges: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Membership filter, then the first rows in file order."""
    out = universe_rows.where(F.col("exchange").isin(exchanges)) if exchanges else universe_rows
    return out.orderBy("position").limit(limit) if limit else out


def universe_csv(spark: SparkSession, path: str) -> DataFrame:
    names = ("ticker", "company_name", "category", "exchange", "in_original", "note")
    return spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in names]))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly values (ticker, label, quarter, value), signed by the label."""
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    value = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * sign)
    return read(spark, sf_dir, "lineitem").groupBy(
        ticker("l_suppkey").alias("ticker"), F.col("l_returnflag").alias("label"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("quarter")
    ).agg(value.alias("value"))


NEAR = "array<struct<ticker: string, volume_ratio: double, price_change_pct: double>>"
RUN_LOG = f"timestamp string, date string, status string, tickers_screened int, match_count int, matches array<string>, near_misses {NEAR}, error string"
HISTORY = "map<string, struct<qualifying_dates: array<string>, first_seen: string, last_emailed: string, last_emailed_date: string, persistence_notified: boolean>>"


def _text(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path, wholetext=True)


def run_log_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON list in file order; a missing or corrupt file is empty."""
    rows = _text(spark, path).select(F.from_json("value", f"array<struct<{RUN_LOG}>>").alias("x"))
    return rows.select(F.posexplode("x").alias("position", "e")).select("position", "e.*")


def history_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per ticker of a JSON map; a missing or corrupt file is empty."""
    return _text(spark, path).select(F.explode(F.from_json("value", HISTORY)).alias("ticker", "e")).select("ticker", "e.*")


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log made of events: (position, date, status, ticker)."""
    e = read(spark, sf_dir, "events")
    order = Window.orderBy("day")
    daily = e.groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum((F.col("event_type") == "error").cast("int")).alias("errors"), F.count("*").alias("n"))
    return daily.select(F.row_number().over(order).cast("bigint").alias("position"), F.col("day").alias("date"), F.when(F.col("errors") * 5 > F.col("n"), "error").otherwise("ok").alias("status"))
