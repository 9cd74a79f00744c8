"""Scans by ranges of ids that go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = "first_id long, last_id long"


def finished_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The ranges (``first_id``, ``last_id``) that a scan into ``path`` has finished; none if it never ran."""
    try:
        return spark.read.schema(DONE).parquet(f"{path}/done")
    except AnalysisException:
        return spark.createDataFrame([], DONE)


def resumable_scan(rows: DataFrame, path: str, step: Callable[[DataFrame], DataFrame], id_col: str = "id", width: int = 1_000_000, skip_to: int | None = None) -> DataFrame:
    """``step`` of all ``rows``, one range of ``width`` ids after the other, with a table of the ranges that are finished.

    A range is written to a folder of its own, overwriting what a broken run left there, and
    then noted in ``path/done``; a later call with the same path leaves noted ranges out, so after
    a failure nothing is done twice or lost.  ``skip_to`` leaves smaller ids out.  The result is what
    all finished ranges hold, read again.  ``step`` sees one range and keeps its own columns; rows
    with a null id are left out.  The widths of calls on one path must agree.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(id_col), F.max(id_col)).first()
    done = {r["first_id"]: r["last_id"] for r in finished_ranges(spark, path).collect()}
    if any(last - first + 1 != width for first, last in done.items()):
        raise ValueError(f"the scan in {path} was begun with ranges of another width")
    if low is not None:
        start = (low if skip_to is None else max(low, skip_to)) // width * width
        for first in range(start, high + 1, width):
            if first in done:
                continue
            least = first if skip_to is None else max(first, skip_to)
            part = step(rows.where(F.col(id_col).between(least, first + width - 1)))
            part.write.mode("overwrite").parquet(f"{path}/rows/first_id={first}")
            spark.createDataFrame([(first, first + width - 1)], DONE).coalesce(1).write.mode("append").parquet(f"{path}/done")
            done[first] = first + width - 1
    schema = step(rows.limit(0)).schema
    if not done:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema.add("first_id", "long")).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/first_id={f}" for f in sorted(done)])
    return found.drop("first_id")
