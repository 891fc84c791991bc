"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes of the batches that go to Python, unless the session sets its own.
BATCH_ROWS, BATCH_BYTES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of the executors, once for each application, and bounds batches."""
    for key, default, ours in (BATCH_ROWS, BATCH_BYTES):
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
