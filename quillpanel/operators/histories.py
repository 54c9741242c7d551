"""Whole histories of tickers as arrays: partitions in the order of (ticker, session) handed to numpy.

A kernel gets the rows of some whole tickers as a ``Panel`` and returns columns.  The
panel has the trailing windows of ``functions.rolling``: missing values are NaN here and
NULL outside, a window has a value only where it lies within its ticker and holds no
missing value, and division by zero is missing.  Each window is added up afresh, so
no error is carried along a history, and costs a fraction of a nanosecond a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions.rolling import ordered

#: Rows handed to a kernel at a time unless one ticker has more, and cells of windows held at a time.
ROWS, CELLS = 60_000, 2**20
#: The day of a missing session, which sorts first.
MISSING = -(2**31)


def divide(a, b) -> np.ndarray:
    return np.where(b == 0, np.nan, a / b)


class Panel:
    """Rows of whole tickers with at least ``least`` rows each, ordered by ticker and session; rn counts from 1."""

    def __init__(self, table: pa.Table, least: int = 1):
        rn = table["rn"].to_numpy()
        starts = np.flatnonzero(rn == 1)
        counts = np.diff(np.append(starts, len(rn)))
        if (counts < least).any():
            table = table.filter(pa.array(np.repeat(counts >= least, counts)))
            rn, counts = table["rn"].to_numpy(), counts[counts >= least]
        self.table, self.rn, self.counts = table, rn, counts
        self.starts, self.known = np.cumsum(counts) - counts, {}

    def __len__(self) -> int:
        return len(self.rn)

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            kind = self.table.schema.field(name).type
            values = self.table[name]
            values = values.cast(pa.int32()).fill_null(MISSING) if pa.types.is_date(kind) else values.cast(pa.float64()).fill_null(np.nan)
            self.known[name] = values.to_numpy()
        return self.known[name]

    def once(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self.known:
            self.known[name] = make()
        return self.known[name]

    def _rows(self, rows: np.ndarray | None) -> np.ndarray:
        return np.arange(len(self)) if rows is None else rows

    def shift(self, x: np.ndarray, k: int, rows: np.ndarray | None = None) -> np.ndarray:
        """x of k rows before (k < 0: after) within the ticker."""
        rows = self._rows(rows)
        here = self.rn[rows] > k if k >= 0 else self.rn[rows] - k <= np.repeat(self.counts, self.counts)[rows]
        return np.where(here, x[np.clip(rows - k, 0, len(self) - 1)], np.nan) if len(self) else np.empty(0)

    def windows(self, x: np.ndarray, n: int, reduce: Callable[[np.ndarray], np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
        """reduce(cells of shape (rows, n)) where the n rows up to a row lie within its ticker."""
        at = self._rows(rows)
        view = sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)
        out, step = np.empty(len(at)), max(1, CELLS // n)
        for a in range(0, len(at), step):
            out[a : a + step] = reduce(view[a : a + step] if rows is None else view[at[a : a + step]])
        out[self.rn[at] < n] = np.nan
        return out

    def mean(self, x, n, rows=None) -> np.ndarray:
        return self.windows(x, n, lambda w: w.mean(1), rows)

    def total(self, x, n, rows=None) -> np.ndarray:
        return self.windows(x, n, lambda w: w.sum(1), rows)

    def highest(self, x, n, rows=None) -> np.ndarray:
        return self.windows(x, n, lambda w: w.max(1), rows)

    def lowest(self, x, n, rows=None) -> np.ndarray:
        return self.windows(x, n, lambda w: w.min(1), rows)

    def deviation(self, x, n, rows=None) -> np.ndarray:
        return self.windows(x, n, lambda w: np.sqrt(_squares(w)[1] / (n - 1)), rows)

    def ratio(self, x, recent: int, base: int, separate: bool, rows=None) -> np.ndarray:
        """Mean of the recent rows by the mean of the base rows, which end where the recent ones begin or with them."""
        if not separate:
            return divide(self.mean(x, recent, rows), self.mean(x, base, rows))
        if rows is None:
            return divide(self.mean(x, recent), self.shift(self.mean(x, base), recent))
        before = np.where(self.rn[rows] > recent, self.mean(x, base, np.maximum(rows - recent, 0)), np.nan)
        return divide(self.mean(x, recent, rows), before)

    def change(self, x, n, rows=None) -> np.ndarray:
        return divide(x[self._rows(rows)], self.shift(x, n, rows)) - 1

    def ahead(self, x, n) -> np.ndarray:
        return divide(self.shift(x, -n), x) - 1

    def extreme(self, x, n: int, least: int, ufunc: np.ufunc, rows=None) -> np.ndarray:
        """Highest or lowest of up to n rows, where there are at least ``least`` of them."""
        rows = self._rows(rows)
        out = self.windows(x, n, lambda w: ufunc.reduce(w, axis=1), rows)
        young = np.empty(len(self))
        for s, c in zip(self.starts, np.minimum(self.counts, n)):
            ufunc.accumulate(x[s : s + c], out=young[s : s + c])
        rn = self.rn[rows]
        return np.where(rn >= n, out, np.where(rn >= least, young[rows], np.nan))

    def spaced(self, hits: np.ndarray, gap: int) -> np.ndarray:
        """Rows of the first hit of each ticker and then of each hit at least ``gap`` rows after the last one taken."""
        n = len(self)
        following = np.append(np.where(hits, np.arange(n), n), n)
        following = np.minimum.accumulate(following[::-1])[::-1].tolist()
        end, out, i = np.repeat(self.starts + self.counts, self.counts).tolist(), [], following[0]
        while i < n:
            out.append(i)
            i = following[min(i + gap, end[i])]
        return np.array(out, np.int64)

    def smooth(self, x: np.ndarray, n: int) -> np.ndarray:
        """An exponential mean with weight 1/n started at row 2, in closed form restarted every 100 * n rows."""
        q, stretch = 1 - 1 / n, 100 * n
        out, power = np.full(len(self), np.nan), q ** np.arange(stretch + 1.0)
        for s, c in zip(self.starts + 1, self.counts - 1):
            carried = None
            for a in range(s, s + c, stretch):
                own = x[a : min(a + stretch, s + c)] / n
                if carried is None:
                    own[0] *= n
                w = power[: len(own)]
                y = w * np.cumsum(own / w)
                if carried is not None:
                    y += power[1 : len(own) + 1] * carried
                out[a : a + len(own)], carried = y, y[-1]
        return out


def _squares(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences from the mean of each row, and their sum of squares, exactly zero where all are equal."""
    d = w - w.mean(1)[:, None]
    d[w.max(1) == w.min(1)] = 0.0
    return d, np.einsum("ij,ij->i", d, d)


def skew(w: np.ndarray) -> np.ndarray:
    """Bias-corrected skewness; missing on a flat window."""
    n = w.shape[1]
    d, m2 = _squares(w)
    return divide(np.sqrt(n) * np.einsum("ij,ij,ij->i", d, d, d), m2**1.5) * ((n * (n - 1)) ** 0.5 / (n - 2))


def fit(w: np.ndarray) -> np.ndarray:
    """R squared of a straight line through the rows; missing on a flat window."""
    t = np.arange(w.shape[1]) - (w.shape[1] - 1) / 2
    d, m2 = _squares(w)
    return divide((d @ t) ** 2, m2 * (t @ t))


def apply(rows: DataFrame, columns: list[str], kernel: Callable[[Panel], dict | None], schema: str, least: int = 1, rows_at_once: int | None = None) -> DataFrame:
    """ticker, session and further columns through a kernel, by tickers with at least ``least`` rows.

    The window of the row numbers deals the rows out by ticker, unless they are so already, and sorts them.
    """
    runtime.ship(rows.sparkSession)
    numbered = rows.select("ticker", "session", *columns).withColumn("rn", F.row_number().over(ordered()))
    return numbered.mapInArrow(_task(kernel, least, rows_at_once or ROWS), schema)


def _task(kernel: Callable[[Panel], dict | None], least: int, at_once: int):
    def out(held: list[pa.RecordBatch] | pa.Table) -> Iterator[pa.RecordBatch]:
        panel = Panel(held, least)
        with np.errstate(all="ignore"):
            columns = kernel(panel) if len(panel) else None
        if columns is not None:
            arrays = [pa.array(v, from_pandas=True) if isinstance(v, np.ndarray) else v for v in columns.values()]
            yield from pa.table(arrays, names=list(columns)).combine_chunks().to_batches(max_chunksize=2_000)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= at_once:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.flatnonzero(table["rn"].to_numpy() == 1)[-1])
                if cut:
                    yield from out(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), len(table) - cut
        if size:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    return task
