"""Token ids as Parquet list columns, in document order, with selective reads.

Files hold ``doc_id``, ``n_tokens`` and a list column ``ids``, dictionary or delta encoded, in
row groups and pages of a chosen size.  The Parquet writer adds column and offset indexes, so a
reader that asks for some documents or for the metadata alone skips the other pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_worker, shared_dir, slices, table, text_bytes
from .pieces import tokenizer_words

LIST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Parquet settings by encoding of the list's values.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def encode_lists(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, specials_as_text: bool = False) -> DataFrame:
    """One row per document with its ids as a list, the end id last; keeps the rows' order."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker("pieces")
        encode = tokenizer_words(path, specials_as_text)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [str(t, "utf-8", "replace") for t in batch.column("text").to_pylist()]
                ids = [x + end for x in encode(texts)]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(offsets, values)], schema=LIST
                )

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>"
    )


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 1000,
    specials_as_text: bool = False,
) -> None:
    """Write every whole text's ids in ascending id order, each file a range of ids.

    The texts, which are smaller than their ids, are what the range exchange moves.  A null or
    empty text is the end id alone; null ids come first; repeated rows are all written; other
    columns are ignored; an empty table gives files without rows.  The string of an added token
    of the tokenizer file gives that token's id unless ``specials_as_text``.
    """
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    model = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    options = ENCODINGS[encoding] | {
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }
    encode_lists(ordered, "doc_id", "text", model, end_id, specials_as_text).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, with the file that each lies in."""
    return (
        spark.read.schema("doc_id long, n_tokens long, ids array<int>")
        .parquet(path)
        .select("doc_id", "n_tokens", "ids", F.col("_metadata.file_path").alias("file"))
    )


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, file, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit values."""
    out = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            sizes = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("file"), pa.array(sizes), pa.array(crc, pa.int64())], schema=out
            )

    return rows.select("doc_id", "file", "ids").mapInArrow(run, "doc_id long, file string, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: the number of ids in all rows before, in ascending doc_id order.

    Files are ranges of ids, so a prefix sum over the files' totals (one row per file) and one
    within each file give it without a global sort.
    """
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("low"))
    before = F.sum("total").over(Window.orderBy(F.asc_nulls_first("low"), "file").rowsBetween(Window.unboundedPreceding, -1))
    inside = Window.partitionBy("file").orderBy(F.asc_nulls_first("doc_id"), "n_tokens", "ids_crc32")
    return (
        rows.join(totals.select("file", F.coalesce(before, F.lit(0)).alias("before")), "file")
        .withColumn("start", F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
        .select("doc_id", "start", "n_tokens", "ids_crc32")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    rows = shared_dir(spark, "token-rows")
    checksums(read_token_files(spark, path)).write.parquet(rows)
    return with_starts(spark.read.schema("doc_id long, file string, n_tokens long, ids_crc32 long").parquet(rows))
