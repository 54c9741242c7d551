"""Operator 2: embedding near-duplicates by int8 tile products with error bounds.

Vectors with one label (and one length) are compared all with all, in tiles of
two blocks of at most ``BLOCK`` vectors.  Each unit vector x is stored as
``s * q + r`` with int8 q; the norm of the residual r is known exactly.  For two
vectors

    |x.y - s_x s_y (q_x.q_y)|  <=  |r_x| + |r_y| + |r_x| |r_y|

since unit vectors have norm 1 and |s q| <= 1 + |r|.  The integer products of a
tile are one matrix product (exact in float32 while length * 127**2 < 2**24, in
float64 beyond); only pairs whose product plus bound reaches the threshold are
computed again from the given components in double precision.

Equal vectors of a label collapse to one first, with their number, so a group of
copies is never expanded.  A tile returns the number of links per vector and a
spanning forest of its links; components follow from the forests.

Cases: components of any magnitude are scaled by powers of two first; null labels, null, empty, zero or non-finite vectors and vectors with
null components link with nothing and are their own component; an empty table
gives an empty result; null or repeated ids are handled row by row (``kept`` is
then true for the first row of a component); cosines that tie with the threshold
link; vectors of another length are other groups; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from . import graph, keys, scratch

#: Vectors in one side of a tile.
BLOCK = 2048
#: Covers the rounding of the bound itself.
_SLACK = 1e-6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, residual norms) of unit vectors."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((x - scale[:, None] * q) ** 2).sum(1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two (exact) that bring the largest component near 1, so that no square leaves the range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine at or above the threshold; with same only i < j."""
    x, y = _scaled(x), _scaled(y)
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    (qx, sx, rx), (qy, sy, ry) = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left, right = qx.astype(kind), qy.astype(kind).T
    out = []
    for a in range(0, len(x), 512):
        near = (left[a : a + 512] @ right).astype(np.float64) * sx[a : a + 512, None] * sy[None]
        bound = rx[a : a + 512, None] + ry[None] + rx[a : a + 512, None] * ry[None] + _SLACK
        i, j = np.nonzero(near + bound >= threshold)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
            out.append((p[ok], q[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        p, q = top(u), top(v)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def _tile(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        block, low, high = (np.asarray(t.column(c).combine_chunks()) for c in ("block", "low", "high"))
        ids, copies = np.asarray(t.column("rep").combine_chunks()), np.asarray(t.column("copies").combine_chunks())
        v = np.asarray(t.column("v").combine_chunks().flatten()).astype(np.float64).reshape(len(ids), -1)
        same = bool(low[0] == high[0])
        i = np.flatnonzero(block == low[0])
        j = i if same else np.flatnonzero(block == high[0])
        p, q = tile_links(v[i], v[j], threshold, same)
        p, q = i[p], j[q]
        links = np.bincount(p, copies[q], len(ids)) + np.bincount(q, copies[p], len(ids))
        hit = np.flatnonzero(links)
        forest = _forest(ids[p], ids[q])
        return pa.table({
            "a": pa.array(ids[hit].tolist() + [a for a, _ in forest], pa.int64()),
            "b": pa.array([None] * len(hit) + [b for _, b in forest], pa.int64()),
            "links": pa.array(links[hit].astype(np.int64).tolist() + [0] * len(forest), pa.int64()),
        })

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    runtime.ship(embeddings.sparkSession)
    source, key, plain = keys.keyed(embeddings, id_col)
    rows = source.select(F.col(key).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    reps = scratch.table(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors")
    sized = reps.withColumn("size", F.size("v"))
    blocks = sized.groupBy("label", "size").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = sized.join(blocks, ["label", "size"]).withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("label", "size", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "v")
    found = tiles.groupBy("label", "size", "low", "high").applyInArrow(_tile(threshold), "a bigint, b bigint, links bigint")
    found = scratch.table(found, "tile-links")
    labels = graph.components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = reps.join(links, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(known, ["label", "v"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    out = out.withColumn("kept", F.col("id") == F.col("component_id"))
    if not plain:
        ids = source.select(F.col(key).alias("id"), F.col(id_col).cast("bigint").alias("own"))
        out = out.join(ids, "id")
        least = out.groupBy("component_id").agg(F.min("own").alias("least"))
        out = out.join(least, "component_id").select(F.col("own").alias("id"), "n_links", F.col("least").alias("component_id"), "kept")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", "kept")
