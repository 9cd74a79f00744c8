"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches, size_of  # noqa: F401


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``.  Only where that is unset in a
    local session a temporary folder takes its place; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="bulletin-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_worker(user: str) -> None:
    """Give back what this Python worker holds for other operators: their models and freed memory.

    Workers are used again by later stages; each keeps the models (``_LOADED``) of one operator.
    """
    for name, module in list(sys.modules.items()):
        if name.startswith(f"{__package__}.") and name != f"{__package__}.{user}" and hasattr(module, "_LOADED"):
            module._LOADED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str) -> Column:
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_bucket(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` does the same wherever a text is pure ASCII (as many bytes as characters) and is
    several times faster than ``translate``, which remains for the others.
    """
    return F.when(
        F.octet_length(column) == F.char_length(column), F.lower(column)
    ).otherwise(F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def slices(batch, column: str, most_bytes: int = 4_000_000):
    """Cut an Arrow batch into slices of bounded size in ``column`` (one row at least)."""
    lengths = batch.column(column)
    start, held = 0, 0
    for i in range(batch.num_rows):
        n = len(lengths[i].as_buffer()) if lengths[i].is_valid else 0
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have (in any case), made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(rows: DataFrame, found: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join ``rows`` with a stored table of one row a key and its number of rows ``n``, whatever one key holds.

    A small table is broadcast.  Of a larger one the keys with over 1/100,000 of the rows are, of
    which there are fewer than 100,000; each of the others is a small part of what Spark shuffles.
    ``how`` is left_semi, inner or left; null keys match nothing.
    """
    total, n = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if n <= 200_000:
        return rows.join(F.broadcast(found), keys, how)
    heavy = F.broadcast(found.where(F.col("n") > total / 100_000))
    light = found.where(F.col("n") <= total / 100_000)
    rest = rows.join(heavy.select(keys), keys, "left_anti").join(light, keys, how)
    return rows.join(heavy, keys, "left_semi" if how == "left_semi" else "inner").unionByName(rest)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` (a stored table) to be broadcast if it has few rows; beyond that Spark shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df
