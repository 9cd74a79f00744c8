"""Incremental ingest: admission, outcome by content hash, null-preserving merge, run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..functions.text import storable_title

#: Fields whose old value stays where the new one is null, and those that a null overwrites.
KEPT, REPLACED = ["title", "content", "category", "published_at"], ["summary"]


def admitted(items: DataFrame) -> DataFrame:
    """Items with a ``reason`` if they are refused: no URL, no storable title, or a URL seen before in the batch."""
    first = F.row_number().over(Window.partitionBy("url").orderBy("position"))
    rows = items.withColumn("__n", first)
    reason = (
        F.when(F.col("url").isNull() | (F.trim("url") == ""), "no url")
        .when(F.col("__n") > 1, "duplicate")
        .when(~storable_title("title"), "no title")
    )
    return rows.withColumn("reason", reason).drop("__n")


def outcomes(items: DataFrame, known: DataFrame) -> DataFrame:
    """new, updated or unchanged for each admitted item against the stored rows (``url``, ``content_hash``).

    An item is updated only if it has fresh content with another hash, or attachments that the
    stored row lacks.
    """
    fresh = items.withColumn("new_hash", content_hash(F.col("title"), F.col("content")))
    old = known.select("url", F.col("content_hash").alias("old_hash"), F.col("attachments").alias("old_attachments"))
    more = (F.size("attachments") > 0) & ~F.coalesce(F.col("attachments") == F.col("old_attachments"), F.lit(False))
    changed = F.col("content").isNotNull() & ~F.col("new_hash").eqNullSafe(F.col("old_hash"))
    outcome = F.when(F.col("old_hash").isNull(), "new").when(changed | F.coalesce(more, F.lit(False)), "updated").otherwise("unchanged")
    return fresh.join(old, "url", "left").withColumn("outcome", outcome)


def merged(known: DataFrame, items: DataFrame, key: str = "url") -> DataFrame:
    """The stored rows after an upsert of one item per key; a full outer join by key."""
    k, i = known.alias("k"), items.alias("i")
    rows = k.join(i, key, "full_outer")
    keep = [F.coalesce(F.col(f"i.{c}"), F.col(f"k.{c}")).alias(c) for c in KEPT]
    present = F.col("i.position").isNotNull()
    replace = [F.when(present, F.col(f"i.{c}")).otherwise(F.col(f"k.{c}")).alias(c) for c in REPLACED]
    out = rows.select(key, *keep, *replace)
    return out.withColumn("content_hash", content_hash(F.col("title"), F.col("content")))


def latest_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def inserted(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(key), key, "left_anti")


def run_counters(decided: DataFrame, *by: str) -> DataFrame:
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return decided.groupBy(*by).agg(F.count(F.lit(1)).alias("found"), of("new"), of("updated"), of("unchanged"))


def overlap(pages: DataFrame) -> DataFrame:
    """Of each page's distinct items the share that earlier pages of the source already had; 1 if empty.

    ``pages``: source, page, item.  The first page that has an item is one aggregate.
    """
    seen = pages.groupBy("source", "item").agg(F.min("page").alias("first"))
    rows = pages.select("source", "page", "item").distinct().join(seen, ["source", "item"])
    share = F.count_if(F.col("first") < F.col("page")) / F.count("item")
    return rows.groupBy("source", "page").agg(F.count("item").alias("items"), F.count_if(F.col("first") == F.col("page")).alias("fresh"), F.round(share, 6).alias("overlap"))


def accepted_text(old_quality: Column, old_length: Column, quality: Column, length: Column) -> Column:
    """What becomes of re-extracted text: EMPTY without characters, CLEAN from 0.55, IMPROVED if it is longer and no worse, or usable; else LOW_QUALITY."""
    better = (quality >= F.coalesce(old_quality, F.lit(0.0))) & (length > F.coalesce(old_length, F.lit(0)))
    usable = (length >= 60) & (quality >= 0.5)
    return F.when(length == 0, "EMPTY").when(quality >= 0.55, "CLEAN").when(better | usable, "IMPROVED").otherwise("LOW_QUALITY")


def upsert_batches(items: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each micro-batch's first item of a URL not stored under ``path`` yet.

    Items without a URL cannot be told apart and are left out.
    """
    spark = items.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        first = latest_wins(batch.where("url IS NOT NULL"), "url", [F.col("position")])
        spark.createDataFrame([], batch.schema).write.mode("append").parquet(path)  # so that there is a table to read
        known = spark.read.schema(batch.schema).parquet(path).select("url")
        first = first.join(known, "url", "left_anti").select(*batch.columns)
        first.write.mode("append").parquet(path)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
