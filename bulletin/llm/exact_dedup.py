"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by length, those that share one by the hash of a prefix too, and only the rows
that share both are read in full and grouped by their full hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, lower_ascii, small, spread_join, stored, table

TWIN = ["n_bytes", "prefix_hash"]


def normal(text_col: str) -> Column:
    """A-Z lower-cased, null as empty."""
    return lower_ascii(F.coalesce(F.col(text_col), F.lit("")))


def shared_keys(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys of two or more rows and how many have them; tasks count before keys move."""
    return stored(rows.groupBy(keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """``doc_id`` and ``text_sha256`` of the rows whose length and prefix other rows share.

    The first level reads lengths, the second the prefixes of rows with a length in common, the
    third the whole text of those with length and prefix in common.  Keys with many rows are
    broadcast (their number is bounded, see :func:`spread_join`), so none lands in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("n_bytes"))
    lengths = shared_keys(rows, ["n_bytes"], "dedup-lengths")
    rows = spread_join(rows, lengths, ["n_bytes"], "left_semi")
    rows = rows.withColumn("prefix_hash", F.xxhash64(lower_ascii(F.substring("text", 1, prefix))))
    twins = shared_keys(rows, TWIN, "dedup-prefixes")
    rows = spread_join(rows, twins, TWIN, "left_semi")
    return stored(rows.select("doc_id", F.sha2(lower_ascii(F.col("text")), 256).alias("text_sha256")), "dedup-hashes")


def groups(found: DataFrame) -> DataFrame:
    """Full hashes of two or more rows: ``keep_id`` (the largest id) and ``n`` (rows)."""
    counted = found.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return stored(counted.where("n > 1"), "dedup-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """Group equal texts; of each group the row with the largest id stays.

    One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``
    (which makes this result read every text once more).  Null and empty texts are equal.  Null
    ids: a group keeps its largest non-null id, and rows with a null id are kept only if all of
    the group's ids are null.  Of rows that repeat the same id and text all are kept if that id
    is.  Other columns are ignored; an empty table gives no rows.
    """
    same = groups(survivors(docs, id_col, text_col, prefix))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normal(text_col), 256).alias("text_sha256"))
    return spread_join(rows, same, ["text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; rows with a null id stay.

    Only texts that share length and prefix are read in full, and again those of ids to drop.
    """
    found = survivors(docs, id_col, text_col)
    dropped = spread_join(found.where("doc_id IS NOT NULL"), groups(found), ["text_sha256"], "inner").where("doc_id <> keep_id")
    gone_id, gone_hash = fresh_names(docs, "gone_id", "gone_hash")
    gone = stored(dropped.select(F.col("doc_id").alias(gone_id), F.array("text_sha256").alias(gone_hash)).distinct(), "dedup-gone")
    # Not an equality: the hash of a text is taken only where the id matches.
    same = F.array_contains(F.col(gone_hash), F.sha2(normal(text_col), 256))
    return docs.join(small(gone), (docs[id_col].cast("long") == F.col(gone_id)) & same, "left_anti")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""
