"""Window and trigger sweeps, two-sided validation, stability over periods: one pass each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MOVE, PREREGISTERED, TRIGGERS, WINDOW_GRID
from . import histories
from .histories import Panel
from .separation import days_of_periods

MIN_BARS, OUTCOMES = 150, ("rise", "fall", "flat")


def counts(bars: DataFrame, cells: list[tuple[int, int, bool, float]], *keys: str) -> DataFrame:
    """Rows by outcome, and those that fire, of each cell (recent, base, separate, trigger), by some of these and the period.

    Each part of the panel counts for itself, so a row is not spelled out once for each cell.
    """
    spans = days_of_periods()

    def kernel(p: Panel) -> dict:
        dv, day, move = p["close"] * p["volume"], p["session"], p.ahead(p["close"], 10)
        rows = np.flatnonzero(~np.isnan(move))
        # 0 rise, 1 fall, 2 flat
        kind, out = np.where(move >= MOVE, 0, np.where(move <= -MOVE, 1, 2))[rows], []
        known = {(r, b, sep): p.ratio(dv, r, b, sep)[rows] for r, b, sep, _ in dict.fromkeys(cells)}
        for name, first, last in spans:
            here = (day[rows] >= first) & (day[rows] <= last)
            for r, b, sep, trigger in cells:
                ratio = known[r, b, sep]
                some = here & ~np.isnan(ratio)
                n, fired = np.bincount(kind[some], minlength=3), np.bincount(kind[some & (ratio >= trigger)], minlength=3)
                if n.any():
                    out.append((name, r, b, sep, trigger, *n.tolist(), *fired.tolist()))
        return dict(zip(schema.names, (pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * len(schema), schema))))

    schema = pa.schema([("period", pa.string()), ("recent", pa.int32()), ("base", pa.int32()), ("separate", pa.bool_()), ("trigger", pa.float64()), *((f"{a}_{k}", pa.int64()) for a in ("n", "fired") for k in OUTCOMES)])
    text = "period string, recent int, base int, separate boolean, trigger double, " + ", ".join(f"{a}_{k} bigint" for a in ("n", "fired") for k in OUTCOMES)
    parts = histories.apply(bars, ["close", "volume"], kernel, text, MIN_BARS)
    return parts.groupBy(*keys).agg(*(F.sum(f"{a}_{k}").alias(f"{a}_{k}") for a in ("n", "fired") for k in OUTCOMES))


def _pct(a: Column, b: Column) -> Column:
    return F.try_divide(a * 100.0, b)


def _total() -> Column:
    return F.expr("n_rise + n_fall + n_flat")


def _fired() -> Column:
    return F.expr("fired_rise + fired_fall + fired_flat")


def window_sweep(bars: DataFrame, grid=WINDOW_GRID, triggers=TRIGGERS) -> DataFrame:
    """Fire rates by outcome, precision, base rate and edge for each window pair and trigger."""
    c = counts(bars, [(r, b, True, float(t)) for r, b in grid for t in triggers], "recent", "base", "trigger").where("n_rise > 0 and n_fall > 0")
    r = lambda x, n: F.round(x, 6).alias(n)
    precision, base = _pct(F.col("fired_rise"), _fired()), _pct(F.col("n_rise"), _total())
    return c.select("recent", "base", "trigger", _fired().alias("n_fired"), *(r(_pct(F.col(f"fired_{k}"), F.col(f"n_{k}")), f"rate_{k}") for k in ("rise", "fall", "flat")), r(_pct(_fired(), _total()), "fire_rate"), r(precision, "precision"), r(base, "base_rate"), r(precision - base, "edge"))


def sweep_pivot(swept: DataFrame, triggers=TRIGGERS) -> DataFrame:
    wide = swept.groupBy("recent", "base").pivot("trigger", [float(t) for t in triggers]).agg(F.first("fire_rate"))
    return wide.select("recent", "base", *(F.col(f"`{float(t)}`").alias(f"t{int(round(t * 100))}") for t in triggers))


def best(swept: DataFrame) -> DataFrame:
    """The cell with the largest edge; ties go to the smaller windows."""
    return swept.orderBy(F.col("edge").desc(), "recent", "base", "trigger").limit(1)


def both_sided(c: DataFrame, *keys: str) -> DataFrame:
    c = c.where(_fired() > 0)
    r2 = lambda x: F.round(x, 2)
    rp, rb, fp, fb = _pct(F.col("fired_rise"), _fired()), _pct(F.col("n_rise"), _total()), _pct(F.col("fired_fall"), _fired()), _pct(F.col("n_fall"), _total())
    cf, ca = _pct(F.col("fired_rise"), F.expr("fired_rise + fired_fall")), _pct(F.col("n_rise"), F.expr("n_rise + n_fall"))
    return c.select(
        *keys, _fired().alias("n_fired"), r2(_pct(_fired(), _total())).alias("fire_rate_pct"), r2(rp).alias("rise_prec_pct"), r2(rb).alias("rise_base_pct"), r2(rp - rb).alias("rise_edge_pp"),
        r2(fp).alias("fall_prec_pct"), r2(fb).alias("fall_base_pct"), r2(fp - fb).alias("fall_edge_pp"), r2(cf).alias("cond_rise_share_pct"), r2(ca).alias("cond_base_share_pct"), r2(cf - ca).alias("direction_edge_pp"),
    )


def _configured(separate: list[bool]) -> list[tuple[int, int, bool, float]]:
    return [(r, b, s, float(t)) for r, b, t in PREREGISTERED for s in separate]


def validation(bars: DataFrame) -> DataFrame:
    """Overlapping against separate baselines for the registered configurations."""
    keys = ("recent", "base", "trigger", "separate")
    out = both_sided(counts(bars, _configured([False, True]), *keys), *keys)
    return out.withColumn("ceiling", F.when(~F.col("separate"), F.round(F.col("base") / F.col("recent"), 6)))


def stability(bars: DataFrame, least: int = 5) -> DataFrame:
    """Registered configurations pass with enough positive periods and no negative one."""
    keys = ("recent", "base", "trigger", "period")
    per = both_sided(counts(bars, _configured([True]), *keys), *keys)
    out = per.groupBy("recent", "base", "trigger").agg(F.count_if(F.col("rise_edge_pp") > 0).alias("positive"), F.count("rise_edge_pp").alias("n"), F.min("rise_edge_pp").alias("worst"))
    return out.withColumn("passes", (F.col("positive") >= least) & (F.col("worst") > 0))
