"""What a session needs before the library's Python code runs on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch unless the session says otherwise: with whole texts, Spark's own 10,000
#: make batches of tens of MB, several times over in each task, outside the heap.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Give the workers of this application the library's modules, once.

    Where the library is installed on every node this changes nothing; where
    only the driver's path holds it (a checkout), workers could not unpickle
    its functions.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="quillpanel-")) / "quillpanel.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, os.fspath(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(os.fspath(path))
        _shipped.add(app)
    return spark
