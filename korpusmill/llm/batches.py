"""Arrow batches of few rows for steps that hand whole texts to Python."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While this is open, jobs of the session pass at most ``rows`` rows at a time to Python, or as many as the session says if that is fewer.

    A task holds a batch twice, in the JVM and in Python, so this bounds what texts of some KB take of both. Results do not
    depend on it; tables that are made later are not covered.
    """
    before = spark.conf.get(ROWS, "10000")
    spark.conf.set(ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)
