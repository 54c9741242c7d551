"""Trailing windows over (ticker, session) panels as built-in window expressions.

A window of n rows has a value only once it holds n non-null values (or
``least`` of them).  Missing values are NULL, never NaN, and division by zero
is NULL.  All expressions share one partitioning and ordering, so a select of
many plans as one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: str = "ticker", order: str = "session") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def span(first: int, last: int = 0) -> WindowSpec:
    return ordered().rowsBetween(first, last)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def trailing(agg, x: Column | str, n: int, least: int | None = None) -> Column:
    x, w = col(x), span(1 - n)
    return F.when(F.count(x).over(w) >= (least or n), agg(x).over(w))


def mean(x: Column | str, n: int) -> Column:
    return trailing(F.avg, x, n)


def total(x: Column | str, n: int) -> Column:
    return trailing(F.sum, x, n)


def deviation(x: Column | str, n: int) -> Column:
    return trailing(F.stddev_samp, x, n)


def highest(x: Column | str, n: int, least: int | None = None) -> Column:
    return trailing(F.max, x, n, least)


def lowest(x: Column | str, n: int, least: int | None = None) -> Column:
    return trailing(F.min, x, n, least)


def skew(x: Column | str, n: int) -> Column:
    """Bias-corrected skewness."""
    return trailing(F.skewness, x, n) * ((n * (n - 1)) ** 0.5 / (n - 2))


def cents(x: Column | str) -> Column:
    """Two decimals; an exact half rounds up, whatever the last bit of a mean of cents is."""
    return F.round(col(x) + 1e-7, 2)


def fit(x: Column | str, n: int) -> Column:
    """R squared of a straight line through n values; NULL on a flat window."""
    x, w = col(x), span(1 - n)
    return F.when((F.count(x).over(w) == n) & (F.var_pop(x).over(w) > 0), F.regr_r2(x, F.col("rn")).over(w))


def lagged_mean(x: Column | str, recent: int, base: int) -> Column:
    """Mean of the base rows that end where the recent rows begin."""
    x, w = col(x), span(1 - recent - base, -recent)
    return F.when(F.count(x).over(w) == base, F.avg(x).over(w))


def ratio(x: Column | str, recent: int, base: int, separate: bool) -> Column:
    return divide(mean(x, recent), lagged_mean(x, recent, base) if separate else mean(x, base))


def change(x: Column | str, n: int) -> Column:
    return divide(col(x), F.lag(col(x), n).over(ordered())) - 1


def ahead(x: Column | str, n: int) -> Column:
    return divide(F.lead(col(x), n).over(ordered()), col(x)) - 1


def running(x: Column | str) -> Column:
    return F.sum(col(x)).over(span(Window.unboundedPreceding))


def smooth(x: Column, first: int, n: int, names: tuple[str, str]) -> tuple[dict[str, Column], Column]:
    """An exponential mean with weight 1/n started at row ``first``, for histories of any length.

    (columns to add, the mean in terms of them).  The closed form
    ``q**t * sum(w * x * q**-t)`` is restarted every 100 * n rows, where q**-t is
    still finite; of the rows before, the value at the last restart remains,
    and what is older than one stretch weighs less than q**(100 * n), about 1e-43.
    """
    q, stretch = 1 - 1 / n, 100 * n
    t = (F.col("rn") - first).cast("double")
    here = t - F.floor(t / stretch) * stretch
    weight = F.when(F.col("rn") == first, 1.0).otherwise(1.0 / n)
    chunk = Window.partitionBy("ticker", F.floor(t / stretch)).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(t >= 0, F.pow(F.lit(q), here) * F.sum(F.when(t >= 0, weight * x * F.pow(F.lit(q), -here))).over(chunk))
    carried = F.last(F.when(here == stretch - 1, F.col(names[0])), ignorenulls=True).over(span(Window.unboundedPreceding, -1))
    return {names[0]: own, names[1]: carried}, F.col(names[0]) + F.coalesce(F.pow(F.lit(q), here + 1) * F.col(names[1]), F.lit(0.0))
