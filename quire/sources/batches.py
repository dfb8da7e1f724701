"""Bounds of what a Python worker holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes that travel to a Python worker at once: both sides hold a batch, some as long as the worker lives.
BATCH = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has another bound than Spark's own; rows are bounded by Spark.

    The setting is the session's, as results are computed after an operator has returned.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m") in ("67108864b", "64MB", "64m"):
        spark.conf.set(name, f"{BATCH}b")
