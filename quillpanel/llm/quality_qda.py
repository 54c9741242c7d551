"""Operator 4: a regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics (logarithms and
logits of counts and ratios).  Both classes are normal with their own mean and
covariance; covariances are shrunk towards the pooled covariance and its
diagonal, more so for classes with few rows.  A score is the logistic of the
difference of Mahalanobis log densities and log priors, computed with Cholesky
factors that are made once and sent to the tasks.

Fitting reads every labelled training row: tasks send class sums and sums of
products (a fixed number of rows per task), Spark adds them, the driver sees one
vector and matrix per class.  Labels, language, source and ids are never inputs.

Cases: null and empty texts have the statistics of an empty text and get a
score; several labels of a document count one by one, null labels not at all;
without training rows of both classes the score is the prior (0.5 without any);
repeated rows get equal scores; null and repeated ids are rows of their own (a
null id is in no fold and has no label); a score that ties with 0.5 is predicted
1; a very long text is one chunk of its task; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from . import scratch, textstats
from .vectext import chunks, released

#: Names of the statistics, in the order of the vector.
STATS = (
    "log_words", "word_length", "word_spread", "symbols", "dup_lines", "repeats", "capitals", "digits", "shouts",
    "stops", "wide", "distinct", "short", "long", "capital_words", "ended", "log_line_words",
)
D = len(STATS)


def vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, one row per text."""
    c = {k: v.astype(float) for k, v in c.items()}
    n = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["n_chars"], 1)
    mean = c["word_chars"] / n
    logit = lambda k, m: np.log((k + 0.5) / (np.maximum(m - k, 0) + 0.5))
    rate = lambda k, m: np.log((k + 0.5) / (m + 1.0))
    ratio = lambda k, m: np.sqrt(k / np.maximum(m, 1))
    columns = (
        np.log1p(c["n_words"]), mean, np.sqrt(np.maximum(c["sum_squares"] / n - mean**2, 0)), ratio(c["n_symbols"], n), ratio(c["n_dup_lines"], c["n_lines"]),
        ratio(c["n_repeat_words"], n), ratio(c["n_upper"], c["n_upper"] + c["n_lower"]), ratio(c["n_digits"], chars), ratio(c["n_shouts"], n),
        ratio(c["n_stops"], n), ratio(c["n_wide"], chars), logit(c["n_distinct"], n), ratio(c["n_short"], n), ratio(c["n_long"], n),
        ratio(c["n_capital"], n), ratio(c["n_ended"], n), rate(c["n_lines"], n),
    )
    return np.stack(columns, 1)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in chunks(batch.column(1)):
            x = vectors(textstats.counts(data, offs, more=True))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), D).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], ["doc", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, D)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, slot, value): count, sums and sums of products of a task's rows."""
    total = np.zeros((2, 1 + D + D * D))
    for batch in batches:
        x, y = _matrix(batch.column(0)), np.asarray(batch.column(1))
        for k in (0, 1):
            z = x[y == k]
            total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    for k in (0, 1):
        if total[k, 0]:
            yield pa.RecordBatch.from_arrays([pa.array([k] * total.shape[1], pa.int32()), pa.array(np.arange(total.shape[1], dtype=np.int32)), pa.array(total[k])], ["label", "slot", "value"])


class Discriminant:
    """Class densities with cached Cholesky factors."""

    def __init__(self, sums: dict[int, np.ndarray], shrink: float):
        self.counts = [float(sums[k][0]) if k in sums else 0.0 for k in (0, 1)]
        self.parts = []
        if min(self.counts) < 2:
            return
        means, scatter = [], []
        for k in (0, 1):
            n, s, q = sums[k][0], sums[k][1 : 1 + D], sums[k][1 + D :].reshape(D, D)
            means.append(s / n)
            scatter.append(q - np.outer(s, s) / n)
        total = sum(self.counts)
        pooled = (scatter[0] + scatter[1]) / total
        scale = np.maximum(np.diag(pooled), 1e-6)
        for k in (0, 1):
            own = scatter[k] / self.counts[k]
            a = max(shrink, D / (self.counts[k] + D))
            sigma = (1 - a) * own + a * (0.5 * pooled + 0.5 * np.diag(scale)) + 1e-4 * np.diag(scale)
            low = np.linalg.cholesky(sigma)
            bias = np.log(self.counts[k] / total) - np.log(np.diag(low)).sum()
            self.parts.append((means[k], np.linalg.inv(low), bias))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            total = sum(self.counts)
            return np.full(len(x), self.counts[1] / total if total else 0.5)
        d = [b - 0.5 * (((x - m) @ inv.T) ** 2).sum(1) for m, inv, b in self.parts]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -500, 500)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc", "held_out", "score", "predicted"])

    return run


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, shrink: float) -> Discriminant:
    """stats: doc, x; only labelled rows outside the held-out fold are read."""
    train = labels.where(f"{label_col} in (0, 1)").select(F.col(id_col).cast("bigint").alias("doc"), F.col(label_col).cast("int").alias("label")).where(~held_out("doc"))
    rows = stats.join(train, "doc").select("x", "label").mapInArrow(_sums, "label int, slot int, value double")
    sums: dict[int, np.ndarray] = {}
    for r in rows.groupBy("label", "slot").agg(F.sum("value").alias("value")).collect():
        sums.setdefault(r.label, np.zeros(1 + D + D * D))[r.slot] = r.value
    return Discriminant(sums, shrink)


def classify(documents: DataFrame, labels: DataFrame, shrink: float = 0.05, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    runtime.ship(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    stats = scratch.table(rows.mapInArrow(released(_emit), "doc bigint, x array<double>"), "statistics")
    model = documents.sparkSession.sparkContext.broadcast(fit(stats, labels, id_col, label_col, shrink))
    out = stats.select("doc", F.coalesce(held_out("doc"), F.lit(False)).alias("held_out"), "x").mapInArrow(_score(model), "doc bigint, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("doc", id_col)
