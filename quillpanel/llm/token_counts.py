"""Operator 3: token counts from an exact length histogram.

Each document is encoded once and leaves only its length.  Documents are then
aggregated by (group, length): a partial count before the shuffle, so a hot
group costs no more than its distinct lengths.  Suffix sums over the lengths
answer every question about context limits without another pass:

* documents and tokens at or above a limit,
* the total when every document is cut to the limit,
* quantiles of the length.

``histogram`` has one row per (group, length) with these sums; ``truncated_total``
and ``quantiles`` read it for limits and ranks that need not be lengths, and
``report`` adds both to it for given limits and ranks.

Cases: null and empty texts have length 0; a null group is a group of its own;
an empty table gives an empty histogram; null and repeated ids and repeated rows
count each time; equal lengths (ties) are one row; a very long text is one chunk
of its task; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from . import scratch, wordbpe
from .vectext import chunks, released


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = wordbpe.coder(path)
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1), wordbpe.CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(coder.count(data, offs).astype(np.int64))], ["grp", "n_tokens"])
        coder.clear()

    return run


def histogram(documents: DataFrame, group_col: str = "lang", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Rows (group, n_tokens, n_docs, docs_ge, tokens_ge, truncated_total, docs_le, group_docs, group_tokens)."""
    runtime.ship(documents.sparkSession)
    rows = documents.select(F.col(group_col).cast("string").alias("grp"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(released(_lengths(tokenizer or wordbpe.default_path())), "grp string, n_tokens bigint")
    counts = rows.groupBy("grp", "n_tokens").agg(F.count("*").alias("n_docs"))
    mass = F.col("n_docs") * F.col("n_tokens")
    down = Window.partitionBy("grp").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("grp").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.select(
        "grp", "n_tokens", "n_docs",
        F.sum("n_docs").over(down).alias("docs_ge"), F.sum(mass).over(down).alias("tokens_ge"),
        F.sum("n_docs").over(up).alias("docs_le"), F.sum(mass).over(up).alias("tokens_le"),
    )
    return out.select(
        F.col("grp").alias(group_col), "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        (F.col("tokens_le") - mass + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        "docs_le",
        (F.col("docs_ge") + F.col("docs_le") - F.col("n_docs")).alias("group_docs"),
        (F.col("tokens_ge") + F.col("tokens_le") - mass).alias("group_tokens"),
    )


def truncated_total(hist: DataFrame, limit: int, group_col: str = "lang") -> DataFrame:
    """Total tokens per group when every document is cut to ``limit`` tokens."""
    cut = F.least(F.col("n_tokens"), F.lit(limit).cast("bigint")) * F.col("n_docs")
    return hist.groupBy(group_col).agg(F.sum(cut).alias("tokens"))


def quantiles(hist: DataFrame, ranks: list[float], group_col: str = "lang") -> DataFrame:
    """Least length whose share of documents at or below it reaches each rank, per group."""
    least = [F.min(F.when(F.col("docs_le") >= F.lit(r) * F.col("group_docs"), F.col("n_tokens"))).alias(f"q{i}") for i, r in enumerate(ranks)]
    return hist.groupBy(group_col).agg(*least)


def report(documents: DataFrame, limits: tuple[int, ...] = (512, 2048, 8192), ranks: tuple[float, ...] = (0.5, 0.9, 0.99), group_col: str = "lang", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The histogram with its group's truncated totals (cut_<limit>) and quantiles (q0 ...), from one encoding of the texts."""
    hist = scratch.table(histogram(documents, group_col, text_col, tokenizer), "length-histogram")
    cuts = [F.sum(F.least(F.col("n_tokens"), F.lit(n).cast("bigint")) * F.col("n_docs")).alias(f"cut_{n}") for n in limits]
    least = [F.min(F.when(F.col("docs_le") >= F.lit(r) * F.col("group_docs"), F.col("n_tokens"))).alias(f"q{i}") for i, r in enumerate(ranks)]
    own = hist.groupBy(F.col(group_col).alias("own")).agg(*cuts, *least)
    return hist.join(own, F.col(group_col).eqNullSafe(F.col("own"))).drop("own")
