"""The metric archive: one partition per session, idempotent increments, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def coverage(archive: DataFrame, expected: int, share: float = 0.9) -> DataFrame:
    """Rows per archived session and whether the session is complete."""
    return archive.groupBy("as_of").agg(F.count("*").alias("n")).withColumn("complete", F.col("n") >= expected * share)


def increment(library: DataFrame, archived: DataFrame, sessions: int = 5, share: float = 0.9) -> DataFrame:
    """The newest sessions per ticker that the archive does not cover; older ones are marked backfilled."""
    expected = library.agg(F.count_distinct("ticker").alias("expected"), F.max("session").alias("newest"))
    order = Window.partitionBy("ticker").orderBy(F.col("session").desc())
    recent = library.withColumn("back", F.row_number().over(order)).where(F.col("back") <= sessions).drop("back")
    counts = archived.groupBy("as_of").agg(F.count("*").alias("n")).crossJoin(F.broadcast(expected.select("expected")))
    done = counts.where(F.col("n") >= F.col("expected") * share).select("as_of")
    rows = recent.withColumnRenamed("session", "as_of").join(done, "as_of", "left_anti").crossJoin(F.broadcast(expected.select("newest")))
    return rows.withColumn("backfilled", F.col("as_of") != F.col("newest")).drop("newest")


def write(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite only the sessions that rows holds; fmt csv writes gzip files."""
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of")
    (out.option("header", True).option("compression", "gzip").csv(path) if fmt == "csv" else out.parquet(path))


def scan(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Archived rows between two sessions (inclusive), pruned to their partitions."""
    rows = spark.read.parquet(path)
    if start:
        rows = rows.where(F.col("as_of") >= F.to_date(F.lit(start)))
    if end:
        rows = rows.where(F.col("as_of") <= F.to_date(F.lit(end)))
    return rows.orderBy("as_of", "ticker")


def report(rows: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)
