"""Event-aligned curves of relative volume around large moves, with a random-day control."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MOVE
from . import histories, md5
from .histories import Panel

GAP, BEFORE, AFTER, BASE_FROM, BASE_TO, MIN_BARS = 30, 20, 20, 40, 22, 200


def curves(bars: DataFrame) -> DataFrame:
    """Mean relative volume and mean rolling ratio per kind (up, down, random) and day -20..20.

    Edges are cut after the spacing, and random draws of one ticker may coincide.  Each part
    of the panel adds up its own events, so the rows around an event are never spelled out.
    """
    days = np.arange(-BASE_FROM, AFTER + 1)
    shown, base = days >= -BEFORE, (days >= -BASE_FROM) & (days <= -BASE_TO)

    def kernel(p: Panel) -> dict:
        dv, fwd, n = p["close"] * p["volume"], p.ahead(p["close"], 10), p.counts.repeat(p.counts)
        ratio = p.ratio(dv, 10, 63, False)
        names = [x.encode() for x in p.table["ticker"].take(pa.array(p.starts)).to_pylist()]
        room = p.counts - BASE_FROM - AFTER - 10
        lots = [p.starts + BASE_FROM + md5.Tails(np.array([b"%b:%d" % (t, slot) for t in names])).draws(b"") % np.maximum(room, 1) for slot in range(3)]
        at = {"up": p.spaced(fwd >= MOVE, GAP), "down": p.spaced(fwd <= -MOVE, GAP)}
        at = {k: x[(p.rn[x] > BASE_FROM) & (p.rn[x] - 1 + AFTER + 10 < n[x])] for k, x in at.items()} | {"random": np.concatenate([x[room > 0] for x in lots])}
        out = []
        for kind, x in at.items():
            cells = x[:, None] + days
            own = dv[cells[:, base]].mean(1) if len(x) else np.empty(0)
            cells, own = cells[own > 0][:, shown], own[own > 0]
            if len(cells):
                rel, r = dv[cells] / own[:, None], ratio[cells]
                there = ~np.isnan(r)
                out.append((np.full(shown.sum(), kind), days[shown], rel.sum(0), np.full(shown.sum(), len(cells)), np.where(there, r, 0.0).sum(0), there.sum(0)))
        return dict(zip(("kind", "day", "rel", "n", "ratio", "n_ratio"), (np.concatenate(x) for x in zip(*out)))) if out else None

    parts = histories.apply(bars, ["close", "volume"], kernel, "kind string, day bigint, rel double, n bigint, ratio double, n_ratio bigint", MIN_BARS)
    mean = lambda x, n, name: F.round(F.try_divide(F.sum(x), F.sum(n)), 6).alias(name)
    return parts.groupBy("kind", "day").agg(mean("rel", "n", "rel_volume"), mean("ratio", "n_ratio", "ratio"), F.sum("n").alias("n"))


def windows(curve: DataFrame) -> DataFrame:
    """Means of the curve before, at and after the event, net of the random control."""
    part = lambda a, b: F.avg(F.when(F.col("day").between(a, b), F.col("rel_volume")))
    rows = curve.groupBy("kind").agg(part(-10, -1).alias("before"), part(0, 2).alias("at"), part(3, 12).alias("after"))
    control = rows.where("kind = 'random'").select(F.col("before").alias("b"), F.col("at").alias("a"), F.col("after").alias("f"))
    out = rows.where("kind <> 'random'").crossJoin(F.broadcast(control))
    r6 = lambda x, n: F.round(x, 6).alias(n)
    verdict = F.when(F.col("before") - F.col("b") > F.col("after") - F.col("f"), "leads").otherwise("lags").alias("verdict")
    return out.select("kind", r6(F.col("before"), "before"), r6(F.col("at"), "at"), r6(F.col("after"), "after"), r6(F.col("before") - F.col("b"), "net_before"), r6(F.col("at") - F.col("a"), "net_at"), r6(F.col("after") - F.col("f"), "net_after"), verdict)


def aligned(curve: DataFrame, kinds: tuple[str, ...] = ("up", "down", "random")) -> DataFrame:
    """One row per day with the kinds side by side."""
    return curve.groupBy("day").pivot("kind", list(kinds)).agg(F.first("rel_volume")).select("day", *kinds)


def drawn(curve: DataFrame, levels: int = 8) -> DataFrame:
    """kind and its curve as digits by day: 1 for the lowest of ``levels`` quantile groups, a dot for a missing value."""
    rank = F.ntile(levels).over(Window.partitionBy("kind", F.col("rel_volume").isNull()).orderBy("rel_volume", "day"))
    rows = curve.withColumn("mark", F.when(F.col("rel_volume").isNull(), ".").otherwise(rank.cast("string")))
    marks = F.transform(F.array_sort(F.collect_list(F.struct("day", "mark"))), lambda x: x["mark"])
    return rows.groupBy("kind").agg(F.array_join(marks, "").alias("curve"))
