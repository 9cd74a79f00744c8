"""Files of a folder: type by content, text with fallback encoding, id by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of file types, types whose text can be read here, and the largest accepted size.
MAGIC = {
    "255044462D": "application/pdf", "504B0304": "application/zip", "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif",
    "D0CF11E0A1B11AE1": "application/msword", "1F8B": "application/gzip",
}
TEXT_TYPES = ["text/plain", "text/html", "text/csv"]
MOST_BYTES = 100 << 20


def mime(content: Column, path: Column) -> Column:
    """By the first bytes, else by the name's extension; null if neither tells."""
    head = F.hex(F.substring(content, 1, 8))
    by_content = F.coalesce(*(F.when(F.startswith(head, F.lit(m)), t) for m, t in MAGIC.items()))
    name = F.lower(path)
    by_name = F.when(name.rlike(r"\.html?$"), "text/html").when(name.endswith(".csv"), "text/csv").when(name.endswith(".txt"), "text/plain")
    return F.coalesce(by_content, by_name)


def decoded(content: Column) -> Column:
    """UTF-8 text, or Latin-1 if it is none; without a byte-order mark."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """One row per file: path, mime, n_bytes, file_hash, text (of text types), and why it is refused.

    Spark's reader leaves empty files out.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    kind = mime(F.col("content"), F.col("path"))
    reason = F.when(F.col("length") > MOST_BYTES, "too large").when(F.col("mime").isNull(), "unknown type")
    return rows.withColumn("mime", kind).select(
        "path", "mime", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("file_hash"),
        F.when(F.col("mime").isin(TEXT_TYPES), decoded(F.col("content"))).alias("text"), reason.alias("refused"),
    )


def changed(seen: DataFrame, state: DataFrame) -> DataFrame:
    """Pages to fetch: those whose validator (``url``, ``validator``) is not the stored one."""
    same = state.select("url", "validator")
    return seen.join(same, ["url", "validator"], "left_anti")
