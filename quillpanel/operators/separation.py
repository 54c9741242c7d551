"""Cross-sections of periods and the standardised separation of labelled groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime
from ..config import MOVE, PERIODS
from ..sources.tables import kept
from . import histories, md5, metrics
from .histories import Panel, divide
from .metrics import METRICS

MIN_ROWS, MIN_GROUP, BAR = 20, 8, 0.30
#: Groups of replicates, each a task; rows and replicates of which a product is taken at a time.
GROUPS, ROWS_AT_ONCE, REPS_AT_ONCE = 24, 16_000, 50


def periods(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([list(p) for p in PERIODS], "period string, first string, last string")
    return F.broadcast(rows.select("period", F.to_date("first").alias("first"), F.to_date("last").alias("last")))


def days_of_periods() -> list[tuple[str, int, int]]:
    """Periods with their first and last day since 1970."""
    return [(name, *((date.fromisoformat(x) - date(1970, 1, 1)).days for x in ends)) for name, *ends in PERIODS]


def cross_section(bars: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """Metrics of the first session of each period with the period's return, rose, fell."""
    spans = days_of_periods()

    def kernel(p: Panel) -> dict:
        day, parts = p["session"], []
        for k, (_, first, last) in enumerate(spans):
            n = np.add.reduceat((day >= first) & (day <= last), p.starts, dtype=np.int64)
            at = p.starts + np.add.reduceat(day < first, p.starts, dtype=np.int64)
            parts.append(np.stack([np.full(len(n), k), at, at + n - 1])[:, n >= MIN_ROWS])
        k, at, end = np.concatenate(parts, 1)
        period = pa.array([name for name, *_ in spans], pa.string()).take(pa.array(k))
        ticker = p.table["ticker"].take(pa.array(at))
        return {"period": period, "ticker": ticker, "move": divide(p["close"][end], p["close"][at]) - 1, **metrics.values(p, names, at)}

    schema = "period string, ticker string, move double" + "".join(f", {m} double" for m in names)
    out, move = histories.apply(bars, metrics.BARS, kernel, schema, metrics.MIN_BARS), F.col("move")
    return out.select("period", "ticker", (F.round(move * 100, 2) + 0.0).alias("period_return_pct"), (move >= MOVE).alias("rose"), (move <= -MOVE).alias("fell"), *names)


def unpivoted(section: DataFrame, *keys: str) -> DataFrame:
    return section.unpivot([*keys], [m for m in METRICS if m in section.columns], "metric", "value")


def _separation(label: Column) -> Column:
    x = F.col("value")
    a, b = F.when(label, x), F.when(~label, x)
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    enough = (F.count(a) >= MIN_GROUP) & (F.count(b) >= MIN_GROUP)
    return F.when(enough, F.when(pooled > 0, (F.avg(a) - F.avg(b)) / pooled).otherwise(0.0))


def separations(long: DataFrame, label: str, *keys: str) -> DataFrame:
    """keys, metric, sep; groups below MIN_GROUP on either side are dropped."""
    yes = F.col(label)
    out = long.groupBy(*keys, "metric").agg(_separation(yes).alias("sep"), F.count(F.when(yes, 1)).alias("n1"), F.count(F.when(~yes, 1)).alias("n0"))
    return out.where((F.col("n1") >= MIN_GROUP) & (F.col("n0") >= MIN_GROUP)).drop("n1", "n0")


def passes(seps: DataFrame, *keys: str, bar: float = BAR) -> DataFrame:
    """Same sign everywhere and at least ``bar`` everywhere."""
    return seps.groupBy(*keys, "metric").agg(
        F.count("*").alias("n"), F.min(F.abs("sep")).alias("min_abs"), F.coalesce((F.count_distinct(F.signum("sep")) == 1) & (F.count("sep") == F.count("*")) & (F.min(F.abs("sep")) >= bar), F.lit(False)).alias("passes")
    )


def score(seps: DataFrame, n_periods: int, bar: float = BAR) -> DataFrame:
    least = max(2, -(-2 * n_periods // 3))
    out = seps.groupBy("metric").agg(
        (F.count_distinct(F.signum("sep")) == 1).alias("same_direction"), F.count(F.when(F.abs("sep") >= bar, 1)).alias("n_meaningful"),
        (F.round(F.avg("sep"), 6) + 0.0).alias("mean_sep"), F.round(F.min(F.abs("sep")), 6).alias("worst_abs"),
    )
    return out.withColumn("passes", F.col("same_direction") & (F.col("n_meaningful") >= least))


def seasonality(seps: DataFrame, chosen: list[str]) -> DataFrame:
    """Chosen periods against the others, judged on rounded means."""
    here = F.col("period").isin(chosen)
    out = seps.groupBy("metric").agg((F.round(F.avg(F.when(here, F.col("sep"))), 2) + 0.0).alias("chosen"), (F.round(F.avg(F.when(~here, F.col("sep"))), 2) + 0.0).alias("other"))
    return out.withColumn("gap", F.round(F.col("chosen") - F.col("other"), 2) + 0.0).withColumn("chosen_only", F.coalesce((F.abs("chosen") >= 0.3) & (F.abs("other") < 0.15), F.lit(False)))


def mirror(section: DataFrame, bar: float = 0.2) -> DataFrame:
    """Separation of risers against that of fallers: the same sign means size of move, not direction."""
    long, labels = unpivoted(section, "period", "ticker", "rose", "fell"), {"up": F.col("rose"), "down": F.col("fell")}
    enough = lambda c: (F.count(F.when(c, 1)) >= MIN_GROUP) & (F.count(F.when(~c, 1)) >= MIN_GROUP)
    per = long.groupBy("period", "metric").agg(*(x for k, c in labels.items() for x in (_separation(c).alias(k), enough(c).alias(f"{k}_there"))))
    both = per.groupBy("metric").agg(*(x for k in labels for x in (F.avg(F.when(F.col(f"{k}_there"), F.col(k))).alias(k), F.bool_or(f"{k}_there").alias(f"{k}_there")))).where("up_there and down_there")
    same = (F.signum("up") == F.signum("down")) & (F.abs("down") >= bar)
    return both.select("metric", F.round("up", 6).alias("up"), F.round("down", 6).alias("down"), F.when(same, "MAGNITUDE").otherwise("direction").alias("kind"))


def _thresholds(reps: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rep, period, and the draw and the ticker of the last one that gets the label; a task's rows are of one group of replicates, in any order."""

    def of_period(period: str, names: np.ndarray, n1: int, mine: range) -> pa.RecordBatch:
        names = np.sort(names)
        tails, n, out = md5.Tails(names), len(names), []
        for rep in mine if 0 < n1 < n else ():
            d = tails.draws(f"{rep}:{period}:".encode())
            last = np.partition(d, n1 - 1)[n1 - 1]
            out.append((int(last), names[np.flatnonzero(d == last)[n1 - 1 - (d < last).sum()]].decode()))
        draw, ticker = zip(*(out or [(2**28 if n1 else -1, "")] * len(mine)))
        more = (pa.array([x] * len(mine)) for x in (min(n1, n), n - min(n1, n)))
        return pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), pa.array([period] * len(mine)), pa.array(draw, pa.int64()), pa.array(ticker, pa.string()), *more], names=["rep", "period", "draw", "last", "n1", "n0"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, risen, g = {}, {}, 0
        for batch in batches:
            g = batch["g"][0].as_py() if batch.num_rows else g
            for period in batch["period"].unique().to_pylist():
                rows = batch.filter(pa.compute.equal(batch["period"], period))
                names.setdefault(period, []).append(_bytes(rows["ticker"].drop_null()))
                risen[period] = risen.get(period, 0) + (pa.compute.sum(rows["r"]).as_py() or 0)
        mine = range(g * reps // groups, (g + 1) * reps // groups)
        for period, parts in names.items():
            yield of_period(period, np.concatenate(parts), risen[period], mine)

    return task


def _bytes(texts: pa.Array) -> np.ndarray:
    return np.array([x.encode() for x in texts.to_pylist()] or [b""])[: len(texts)]


def _dealt_sums(names: list[str], centers: dict, marks: dict, reps: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rep, period, metric, and count, sum and sum of squares (about the period's mean) of either side, over the rows of a task."""
    size = len(names)

    def add(sums: dict, table: pa.Table) -> None:
        for period in set(table["period"].to_pylist()):
            rows = table.filter(pa.compute.equal(table["period"], period))
            tickers = _bytes(rows["ticker"])
            x = np.stack([rows[m].cast(pa.float64()).fill_null(np.nan).to_numpy() for m in names], 1) - centers[period]
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            cells, tails, (draw, last) = np.concatenate([there, x, x * x], 1), md5.Tails(tickers), marks[period]
            own = sums.setdefault(period, np.zeros((2, reps, 3 * size)))
            for first in range(0, reps, REPS_AT_ONCE):
                some = range(first, min(first + REPS_AT_ONCE, reps))
                lucky = np.empty((len(some), len(tickers)))
                for k, rep in enumerate(some):
                    d = tails.draws(f"{rep}:{period}:".encode()).astype(np.int64)
                    lucky[k] = (d < draw[rep]) | ((d == draw[rep]) & (tickers <= last[rep]))
                own[0, some] += lucky @ cells
                own[1, some] += (1 - lucky) @ cells

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, n = {}, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                add(sums, pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            add(sums, pa.Table.from_batches(held))
        for period, own in sums.items():
            cells = own.reshape(2, reps, 3, size).transpose(0, 2, 1, 3).reshape(6, reps * size)
            head = [pa.array(np.repeat(np.arange(reps, dtype=np.int32), size)), pa.array([period] * (reps * size)), pa.array(names * reps)]
            yield pa.RecordBatch.from_arrays([*head, *map(pa.array, cells)], names=["rep", "period", "metric", "ca", "sa", "qa", "cb", "sb", "qb"])

    return task


def _shuffled(section: DataFrame, reps: int) -> DataFrame:
    """Separations per replicate of shuffled labels: the n1 first tickers of a period in md5 order get the label.

    The order is that of ``resample.draw(rep, period, ticker)``, then the ticker.  First, the
    tickers alone say for each replicate and period who is the last one with the label (one
    task for a group of replicates; the answers are reps x periods rows).  Then every part of
    the section adds up either side of all replicates by a product of matrices.
    """
    spark, groups = runtime.ship(section.sparkSession), min(GROUPS, reps)
    names = [m for m in METRICS if m in section.columns]
    tickers = section.select("period", "ticker", F.col("rose").cast("int").alias("r")).repartition(1)
    dealt = spark.range(0, groups, 1, groups).withColumnRenamed("id", "g").crossJoin(tickers.hint("shuffle_replicate_nl"))
    found = dealt.mapInArrow(_thresholds(reps, groups), "rep int, period string, draw bigint, last string, n1 bigint, n0 bigint").toArrow().to_pylist()
    marks = {p: (np.full(reps, -1, np.int64), np.full(reps, b"", object)) for p in {r["period"] for r in found}}
    for r in found:
        marks[r["period"]][0][r["rep"]], marks[r["period"]][1][r["rep"]] = r["draw"], r["last"].encode()
    marks = {p: (draw, np.array(list(last))) for p, (draw, last) in marks.items()}
    means = section.groupBy("period").agg(*(F.avg(m).alias(m) for m in names)).collect()
    centers = {r.period: np.array([r[m] or 0.0 for m in names]) for r in means}
    sums = section.select("period", "ticker", *names).where("ticker is not null").mapInArrow(_dealt_sums(names, centers, marks, reps), "rep int, period string, metric string, ca double, sa double, qa double, cb double, sb double, qb double")
    sums = sums.groupBy("rep", "period", "metric").agg(*(F.sum(k).alias(k) for k in ("ca", "sa", "qa", "cb", "sb", "qb")))
    large = [p for p in marks if any(r["period"] == p and r["n1"] >= MIN_GROUP and r["n0"] >= MIN_GROUP for r in found)]
    # of equal values the sum of squares about the mean is zero up to rounding
    spread = lambda k: F.expr(f"if(q{k} - s{k} * s{k} / c{k} <= 1e-12 * q{k}, 0, (q{k} - s{k} * s{k} / c{k}) / (c{k} - 1))")
    pooled = F.sqrt((spread("a") + spread("b")) / 2)
    sep = F.when(pooled > 0, (F.expr("sa / ca") - F.expr("sb / cb")) / pooled).otherwise(0.0)
    return sums.where(F.col("period").isin(large)).select("rep", "period", "metric", F.when((F.col("ca") >= MIN_GROUP) & (F.col("cb") >= MIN_GROUP), sep).alias("sep"))


def permutation(section: DataFrame, reps: int, bar: float = BAR) -> DataFrame:
    """Passing metrics per replicate under the rule of ``passes``; a replicate in which a period is too small for a metric drops it."""
    section = kept(section)
    per = section.agg(F.count_distinct("period").alias("per"))
    full = passes(_shuffled(section, reps), "rep", bar=bar).crossJoin(F.broadcast(per)).where("n = per")
    return full.groupBy("rep").agg(F.count(F.when(F.col("passes"), 1)).alias("hits"))


def permutation_by_score(section: DataFrame, reps: int, n_periods: int, bar: float = BAR) -> DataFrame:
    """Passing metrics per replicate under the rule of ``score``."""
    seps = _shuffled(kept(section), reps)
    least = max(2, -(-2 * n_periods // 3))
    per = seps.groupBy("rep", "metric").agg((F.count_distinct(F.signum("sep")) == 1).alias("same"), F.count(F.when(F.abs("sep") >= bar, 1)).alias("n"))
    return per.groupBy("rep").agg(F.count(F.when(F.col("same") & (F.col("n") >= least), 1)).alias("hits"))


def against_null(null: DataFrame, passing: DataFrame) -> DataFrame:
    """One row: metrics found, mean and 95th percentile of the null, share of replicates with at least as many."""
    found = passing.agg(F.count(F.when(F.col("passes"), 1)).alias("observed"))
    both = null.crossJoin(F.broadcast(found))
    return both.groupBy("observed").agg(
        F.count("*").alias("reps"), F.round(F.avg("hits"), 6).alias("null_mean"), F.round(F.percentile("hits", 0.95), 6).alias("null_p95"),
        F.round(F.avg((F.col("hits") >= F.col("observed")).cast("double")), 6).alias("p_value"),
    )


def survivors(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The metrics that passed before, and whether they pass now (absent ones do not)."""
    return earlier.where("passes").select("metric").join(later.select("metric", F.col("passes").alias("survived")), "metric", "left").withColumn("survived", F.coalesce("survived", F.lit(False)))


def ranked(scores: DataFrame) -> DataFrame:
    """Scores in order of passing, number of meaningful periods and worst period."""
    return scores.orderBy(F.col("passes").desc(), F.col("n_meaningful").desc(), F.col("worst_abs").desc_nulls_last(), "metric")
