"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds: each round links every node to
the least neighbour that it knows, so chains shorten geometrically.  A round is
a partial aggregate (least neighbour per node, combined before the shuffle) and
an equi-join that adaptive execution can split, so a hub with a third of all
edges is never gathered in one task.  Rounds are cut by written tables; nothing
but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component): component is the least id reachable over the edges.

    Ids are bigint.  Self-loops and null ends are ignored; ids without an edge
    to another id have no row.  An empty edge list gives an empty table.
    """
    now = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    now = now.where("u is not null and v is not null and u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = [F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))]
    now = scratch.table(now, "edges")
    was = tuple(now.agg(*mark).first())
    while was[0]:
        after = scratch.table(_star(_star(now, True), False), "edges")
        mark_now = tuple(after.agg(*mark).first())
        scratch.drop(now)
        now = after
        if mark_now == was:
            break
        was = mark_now
    lows = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(lows).distinct()
