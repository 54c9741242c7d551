"""Row keys for operators that bring results back to rows.

Where ids are unique and present (one partial count over the id column tells),
the id is the key.  Otherwise rows are written once with a generated key, so
that null and repeated ids are handled row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(rows: DataFrame, id_col: str) -> tuple[DataFrame, str, bool]:
    """(rows with a key column, the key's name, whether the key is the id)."""
    name = fresh(rows.columns, "_key")
    odd = rows.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null")
    if odd.isEmpty():
        return rows.withColumn(name, F.col(id_col).cast("bigint")), name, True
    return scratch.table(rows.withColumn(name, F.monotonically_increasing_id()), "keyed-rows"), name, False


def named(out: DataFrame, rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Replace the column ``doc`` (a key) by the id of its row."""
    ids = rows.select(F.col(key).alias("doc"), F.col(id_col))
    return out.join(ids, "doc").select(id_col, *(c for c in out.columns if c != "doc"))
