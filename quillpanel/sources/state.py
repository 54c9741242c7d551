"""State and caches: small JSON files that are read and written whole, and tables that are made once."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LOG_CAP
from .tables import _text

CACHE = "map<string, struct<cash: double, cap_busd: double, fetched_at: string>>"


def plain(x: object) -> object:
    """NaN and infinities anywhere in lists and maps become null, so that the text is JSON."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def write_json(value: object, path: str) -> None:
    """Sorted keys, no NaN; the file changes as a whole or not at all."""
    text = json.dumps(plain(value), indent=2, sort_keys=True, allow_nan=False, default=str)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)


def append_run(log: list[dict], entry: dict, path: str, cap: int = LOG_CAP) -> list[dict]:
    """Write the run log with its new entry, the newest ``cap`` entries only."""
    kept = [*log, entry][-cap:]
    write_json(kept, path)
    return kept


def cache_json(spark: SparkSession, path: str) -> DataFrame:
    """The fundamentals cache (ticker, cash, cap_busd, fetched_at); a missing or corrupt file is empty."""
    rows = _text(spark, path).select(F.explode(F.from_json("value", CACHE)).alias("ticker", "e"))
    return rows.select("ticker", "e.cash", "e.cap_busd", F.try_to_timestamp("e.fetched_at").alias("fetched_at"))


def write_cache(cache: DataFrame, path: str) -> None:
    """The cache as a JSON map by ticker; one entry per ticker of the universe, so it is small."""
    rows = cache.select("ticker", "cash", "cap_busd", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"))
    write_json({r["ticker"]: {k: r[k] for k in ("cash", "cap_busd", "fetched_at")} for r in rows.toLocalIterator()}, path)


def made_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where there is none it is made first, and never refreshed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def long_bars(wide: DataFrame, session: str = "session", mark: str = "|") -> DataFrame:
    """Bars in long form from one column per field and ticker, named field|ticker; empty bars go."""
    cells = [c for c in wide.columns if c != session]
    fields = sorted({c.split(mark)[0] for c in cells})
    tickers = sorted({c.split(mark, 1)[1] for c in cells})
    value = lambda f, t: f"cast(`{f}{mark}{t}` as double)" if f"{f}{mark}{t}" in cells else "cast(null as double)"
    rows = ", ".join("'" + t.replace("'", "\\'") + "', " + ", ".join(value(f, t) for f in fields) for t in tickers)
    out = wide.selectExpr(f"`{session}` as session", f"stack({len(tickers)}, {rows}) as (ticker, {', '.join(f.lower() for f in fields)})")
    return out.where(" or ".join(f"{f.lower()} is not null" for f in fields))


def without_nan(x: Column, kind: T.DataType) -> Column:
    """NaN becomes NULL in doubles, arrays, structs and map values, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x), x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: without_nan(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: without_nan(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(without_nan(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return x


def cleansed(rows: DataFrame) -> DataFrame:
    """All columns without NaN."""
    return rows.select(*(without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields))
