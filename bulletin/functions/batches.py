"""Limits of the Arrow batches in which Spark hands rows to Python."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def size_of(setting: str) -> int:
    """Bytes or rows of a Spark size setting such as ``64MB``, ``8m`` or ``10000``."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def bounded_batches(df: DataFrame, rows: int = 1000, most_bytes: int = 8 << 20) -> DataFrame:
    """Whole texts go to Python in Arrow batches of at most so many rows and, about, bytes.

    Lowers the session's limits (10,000 rows by default) and never raises them.
    """
    conf = df.sparkSession.conf
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        if not 0 < size_of(conf.get(key)) <= value:
            conf.set(key, str(value))
    return df
