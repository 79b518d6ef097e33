"""Settings that the Python workers of these operators need."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20  # a task holds some of them on both sides of the pipe, for each Python step of its stage
ROOT = str(Path(__file__).resolve().parent.parent.parent)


def importable(spark: SparkSession) -> None:
    """Adds the folder of the package to the workers' search path and bounds their batches.

    The path is enough where the executors see the same folder, as in tests; elsewhere the
    package is installed or shipped with ``--py-files``, and the entry does no harm. Batches
    are bounded by bytes, for a number of rows says nothing about the size of their texts;
    a setting of the session's own stays.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
