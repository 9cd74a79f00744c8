"""Catalogue queries: optional filters, search, dynamic order, pages with totals, group counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared_folder

#: Columns that a list may be ordered by; the publication date stands for the effective date.
SORTABLE = {"published_at": "effective_at", "title": "title", "scraped_at": "scraped_at", "id": "id"}


def contains_any(columns: list[str], needle: str) -> Column:
    """Case-insensitive substring test over several columns; % and _ are ordinary characters."""
    hits = [F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(needle))), F.lit(False)) for c in columns]
    return reduce(Column.__or__, hits)


def matching(
    rows: DataFrame,
    category: str | None = None,
    source: str | None = None,
    urgency: str | None = None,
    published_from: str | None = None,
    published_to: str | None = None,
    text: str | None = None,
    tag: str | None = None,
) -> DataFrame:
    """AND of the filters that are given.

    The date range looks at the publication date alone, so undated rows are out of it.
    """
    tests: list[Column] = []
    for column, value in (("category", category), ("source_label", source), ("urgency", urgency)):
        if value is not None:
            tests.append(F.col(column) == value)
    if published_from is not None:
        tests.append(F.col("published_at") >= F.lit(published_from).cast("timestamp_ntz"))
    if published_to is not None:
        tests.append(F.col("published_at") <= F.lit(published_to).cast("timestamp_ntz"))
    if text is not None:
        tests.append(contains_any(["title", "content"], text))
    if tag is not None:
        tests.append(F.array_contains("tags", tag))
    return rows.where(reduce(Column.__and__, tests)) if tests else rows


def ordered(rows: DataFrame, by: str = "published_at", descending: bool = True) -> list[Column]:
    """Order columns with the id as tie-break; nulls are first when descending and last otherwise."""
    if by not in SORTABLE:
        raise ValueError(f"cannot order by {by}")
    c = F.col(SORTABLE[by])
    return [c.desc_nulls_first() if descending else c.asc_nulls_last(), F.col("id").desc() if descending else F.col("id").asc()]


def placed(rows: DataFrame, *keys: Column) -> DataFrame:
    """All rows with their 1-based ``place`` in the order of ``keys``, which must be unique.

    A range exchange sorts them into files of the shared folder; a row's place is that in its task
    plus the totals of the tasks before, one row each.  No task sees more than its range.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, "placed")
    parts = {"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    rows.orderBy(*keys).withColumns(parts).write.parquet(path)
    cut = spark.read.parquet(path)
    before = F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    totals = cut.groupBy("__task").agg(F.count(F.lit(1)).alias("n"))
    starts = totals.select("__task", F.coalesce(before, F.lit(0)).alias("__start"))  # one row a task of the sort
    return cut.join(F.broadcast(starts), "__task").withColumn("place", F.col("__start") + F.col("__at") + 1).drop("__task", "__at", "__start")


def page(rows: DataFrame, number: int, size: int, by: str = "published_at", descending: bool = True) -> DataFrame:
    """The given page (from 1) in the order of ``by``."""
    number, size = max(1, number), min(max(1, size), 500)
    return rows.orderBy(*ordered(rows, by, descending)).offset((number - 1) * size).limit(size)


def totals(rows: DataFrame, size: int) -> DataFrame:
    """Number of rows and of pages of ``size``."""
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def counts_with_total(rows: DataFrame, by: str) -> DataFrame:
    """Group counts and, in the row named (all), the grand total, in one pass."""
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.grouping(by).alias("g")).select(
        F.when(F.col("g") == 1, "(all)").otherwise(F.col(by)).alias(by), "n"
    )


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
