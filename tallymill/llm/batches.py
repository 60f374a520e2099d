"""Bounds on what a Python worker holds at once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

RECORDS, BYTES = 256, 8 << 20
_KEYS = (("spark.sql.execution.arrow.maxRecordsPerBatch", RECORDS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES))


def bound_batches(spark: SparkSession) -> None:
    """Set the bounds for a session of one's own, where a plan with texts in Python is run later, by others."""
    for key, most in _KEYS:
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends texts to Python in Arrow batches of at most so many rows and bytes.

    By default a batch is 10,000 rows, whose texts, words and results would
    together take gigabytes where documents are long. A session with smaller
    batches keeps them, and its settings are as they were afterwards.
    """
    before = {key: spark.conf.get(key) for key, _ in _KEYS}
    try:
        bound_batches(spark)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
