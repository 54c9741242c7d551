"""Operator 9: quality rules with risk-controlled thresholds.

Base rules are fixed: too few words, or too many words in repeated 5-word
windows.  Each further rule rejects a document whose ratio exceeds a cutoff,
and the cutoff is chosen per stratum (language) from labelled documents so that
good documents are rejected rarely, with a guarantee:

* for a rule and cutoff, k of the n labelled good documents of the stratum
  exceed the cutoff; the hypothesis "the rate is at least e" is rejected if
  P(Bin(n, e) <= k) <= d, the exact (Clopper-Pearson) bound;
* cutoffs are tried from the laxest to the strictest and the first failure
  ends the rule (fixed sequence, no further correction within a rule);
* d = ``delta`` / (strata * rules) (Bonferroni) and e = ``risk`` / rules, so
  with probability 1 - delta the rules together falsely reject at most a
  ``risk`` share of good documents in every stratum.

A stratum with too few labels gets no cutoff and keeps its documents.  All
labelled documents count, through one row of sums per stratum; cutoffs are
chosen on those rows where they are, so any number of strata will do.

Cases: null or empty texts have no words and fail the base rules; a null
stratum is a stratum of its own; documents with several labels count as good
only if every label is 1; null labels are ignored; an empty or missing label
set leaves the base rules; null and repeated ids are rows of their own (a label
counts for each row of its id, none for a null id); repeated rows get the same
verdict; a ratio that ties with a cutoff stays; a very long text is one chunk of
its task; an empty table stays empty; other columns, whatever their names, are
ignored (``keep_good`` passes them on).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from . import keys, scratch, textstats
from .vectext import chunks, released

#: rule -> (ratio of the counts, cutoffs from lax to strict)
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1)),
    "capitals": ("n_upper / greatest(n_upper + n_lower, 1)", (0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), the regularised incomplete beta function I(1 - p; n - k, k + 1), as a continued fraction."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b = n - k, k + 1
    front = math.exp(math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-p) + b * math.log(p))
    if 1 - p < (a + 1) / (n + 3):
        return min(1.0, front * _fraction(a, b, 1 - p) / a)
    return max(0.0, 1 - front * _fraction(b, a, p) / b)


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz rule."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d or tiny), 1 + step / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            return out


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in chunks(batch.column(1)):
            got = textstats.counts(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(got[c], pa.int64()) for c in _COUNTS)], ["doc", "stratum", *_COUNTS])


def count_texts(documents: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(stratum_col).cast("string").alias("stratum"))
    return rows.mapInArrow(released(_emit), "doc bigint, stratum string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def choose(exceed: dict[str, list[int]], good: int, strata: int, risk: float, delta: float) -> dict[str, float]:
    """Cutoffs by rule for one stratum of ``good`` good documents; exceed has, per cutoff, those beyond it."""
    d = delta / max(1, strata * len(RULES))
    out = {}
    for rule, over in exceed.items():
        for cutoff, k in zip(RULES[rule][1], over):
            if binomial_tail(k, good, risk / len(RULES)) > d:
                break
            out[rule] = cutoff
    return out


def _choose(strata: int, risk: float, delta: float):
    """One row of sums per stratum to one row of cutoffs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [choose({rule: [r[f"{rule}_{i}"] for i in range(len(cuts))] for rule, (_, cuts) in RULES.items()}, r["n"], strata, risk, delta) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(rule) for r in rows], pa.float64()) for rule in RULES)], ["s", *(f"cut_{rule}" for rule in RULES)])

    return run


def thresholds(counted: DataFrame, labels: DataFrame, risk: float, delta: float, id_col: str, label_col: str) -> DataFrame:
    """Rows (s, cut_<rule> ...), one per stratum with good labels, null where no cutoff is safe; written."""
    labelled = labels.where(f"{label_col} is not null").groupBy(F.col(id_col).cast("bigint").alias("doc")).agg(F.min(label_col).alias("label"))
    good = counted.join(labelled.where("label = 1"), "doc")
    sums = [F.sum((F.expr(f"cast({ratio} as double)") > F.lit(c)).cast("bigint")).alias(f"{rule}_{i}") for rule, (ratio, cuts) in RULES.items() for i, c in enumerate(cuts)]
    sums = scratch.table(good.groupBy("stratum").agg(F.count("*").alias("n"), *sums), "stratum-sums")
    schema = "s string, " + ", ".join(f"cut_{rule} double" for rule in RULES)
    return scratch.table(sums.mapInArrow(_choose(sums.count(), risk, delta), schema), "cutoffs")


def judge(
    documents: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, min_words: int = 10, repeat_percent: int = 20,
    id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality",
) -> DataFrame:
    """One row per document: its counts, base_failed, kept."""
    runtime.ship(documents.sparkSession)
    counted = scratch.table(count_texts(documents, id_col, text_col, stratum_col), "text-counts")
    cuts = thresholds(counted, labels, risk, delta, id_col, label_col)
    over = " or ".join(f"coalesce(cast({ratio} as double) > cut_{rule}, false)" for rule, (ratio, _) in RULES.items())
    base = f"n_words < {min_words} or 100 * n_repeat_words > {repeat_percent} * n_words"
    out = counted.join(cuts, F.col("stratum").eqNullSafe(F.col("s")), "left")
    return out.select(
        F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(base).alias("base_failed"), F.expr(f"not ({base}) and not ({over})").alias("kept"),
    )


def _filter(text_at: int, min_words: int, repeat_percent: int):
    """Rows with a last column of cutoffs to those that stay, without it."""
    ratios = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_upper", None)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(range(batch.num_columns - 1))
            for a, b, data, offs in chunks(batch.column(text_at).cast(pa.string())):
                c = textstats.counts(data, offs)
                keep = (c["n_words"] >= min_words) & (100 * c["n_repeat_words"] <= repeat_percent * c["n_words"])
                cuts = batch.column(batch.num_columns - 1).slice(a, b - a).flatten()
                for (top, bottom), cut in zip(ratios.values(), cuts):
                    under = c[bottom] if bottom else c["n_upper"] + c["n_lower"]
                    keep &= ~(c[top] / np.maximum(under, 1) > np.asarray(cut.fill_null(np.inf)))
                yield rows.slice(a, b - a).filter(pa.array(keep))

    return run


def keep_good(
    documents: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, min_words: int = 10, repeat_percent: int = 20,
    id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality",
) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns; their texts are not shuffled while the cutoffs (one row per stratum) fit a broadcast."""
    runtime.ship(documents.sparkSession)
    counted = scratch.table(count_texts(documents, id_col, text_col, stratum_col), "text-counts")
    cuts = thresholds(counted, labels, risk, delta, id_col, label_col)
    scratch.drop(counted)
    s, c = keys.fresh(documents.columns, "_stratum"), keys.fresh(documents.columns, "_cuts")
    cuts = cuts.select(F.col("s").alias(s), F.struct(*(f"cut_{rule}" for rule in RULES)).alias(c))
    rows = documents.join(cuts, F.col(stratum_col).cast("string").eqNullSafe(F.col(s)), "left").select(*documents.columns, c)
    return rows.mapInArrow(released(_filter(documents.columns.index(text_col), min_words, repeat_percent)), documents.schema)
