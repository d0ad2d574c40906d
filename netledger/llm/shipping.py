"""Set up a session for the operators whose tasks run Python."""

from __future__ import annotations

import os
import zipfile
from functools import lru_cache
from tempfile import mkdtemp

from pyspark.sql import SparkSession

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Text of an Arrow batch. A batch stands in memory whole, on both sides of the pipe, and 10,000 rows of text can be a partition.
BATCH_BYTES = 4 << 20


@lru_cache(maxsize=8)
def _ship(application: str) -> str:
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(mkdtemp(prefix="llm-package-"), "netledger_llm.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    SparkSession.active().sparkContext.addPyFile(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Send the package to all executors, once per application (addPyFile serves it from the driver).

    Arrow batches are limited to BATCH_BYTES unless the session names a limit of its own.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    _ship(spark.sparkContext.applicationId)
