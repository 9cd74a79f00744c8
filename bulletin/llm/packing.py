"""Harmonic packing of token ids into sequences of fixed capacity.

A document gives its full sequences; what remains, of length n, belongs to class
k = floor(capacity / n), and a bin of class k takes exactly k such remainders.  What a full bin
lacks to the capacity is filled by the head of a later document, if ``least`` ids or more would
go there and stay behind.  Every Spark task fills its own bins, without any exchange; the
remainders in its open bins fill the last gaps and then sequences one after the other, of which
the last is cut into powers of two.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, fresh_worker, slices, table, text_bytes
from .pieces import tokenizer_words

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


class Bins:
    """The open bins of one task; placed pieces move to ``rows``."""

    def __init__(self, capacity: int, first_id: int, least: int):
        self.capacity, self.next_id, self.least = capacity, first_id, least
        self.open: dict[int, list[tuple]] = {}  # by class: (document, start, ids, ids of the document)
        self.gaps: list[tuple[int, int]] = []  # (free ids at the end, sequence), the smallest first
        self.rows: list[tuple] = []
        self.held = 0

    def put(self, piece: tuple, sequence: int, offset: int) -> int:
        doc, start, ids, n = piece
        self.rows.append((doc, start, len(ids) // 4, ids, n, sequence, offset))
        self.held += len(ids) // 4
        return offset + len(ids) // 4

    def sequence(self, pieces: list[tuple]) -> int:
        """A new sequence of these pieces; gives what is left of it."""
        offset = 0
        for piece in pieces:
            offset = self.put(piece, self.next_id, offset)
        self.next_id += 1
        return self.capacity - offset

    def add(self, doc, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        at = bisect_right(self.gaps, (n - self.least, self.next_id)) - 1
        if at >= 0:
            gap, sequence = self.gaps.pop(at)
            self.put((doc, 0, ids[: 4 * gap], n), sequence, self.capacity - gap)
            start = gap
        while n - start >= self.capacity:
            self.sequence([(doc, start, ids[4 * start : 4 * (start + self.capacity)], n)])
            start += self.capacity
        if start < n:
            k = self.capacity // (n - start)
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[4 * start :], n))
            if len(bin_) == k:
                self.gap(self.sequence(self.open.pop(k)))

    def gap(self, size: int) -> None:
        if size >= self.least:
            insort(self.gaps, (size, self.next_id - 1))

    def finish(self) -> None:
        """Fill the gaps, the largest first, and then new sequences with what the open bins hold."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        left.reverse()
        self.open = {}

        def fill(size: int, sequence: int, offset: int) -> None:
            while size and left:
                doc, start, ids, n = left.pop()
                if len(ids) > 4 * size:
                    left.append((doc, start + size, ids[4 * size :], n))
                    ids = ids[: 4 * size]
                size -= len(ids) // 4
                offset = self.put((doc, start, ids, n), sequence, offset)

        while self.gaps and left:
            size, sequence = self.gaps.pop()
            fill(size, sequence, self.capacity - size)
        total = sum(len(p[2]) for p in left) // 4
        while total:
            size = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            fill(size, self.next_id, 0)
            self.next_id += 1
            total -= size

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(ARROW)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)
        self.rows, self.held = [], 0
        return batch


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = 1024,
    end_id: int = 0,
    least: int = 16,
    specials_as_text: bool = False,
) -> DataFrame:
    """Pack every whole text into sequences of at most ``capacity`` ids (a power of two).

    One row per piece: ``doc_id``, ``start`` (ids of the document before it), ``length``,
    ``ids`` (unsigned 32-bit little-endian), ``doc_tokens`` (with the end id), ``sequence_id``
    and ``offset`` there.  A null or empty text is the end id alone.  Repeated rows are packed
    as often as they occur; a null id stays null; other columns are ignored; an empty table
    gives no rows.  Pieces that fill gaps have at least ``least`` ids (but for the last bins of a
    task).  The string of an added token of the tokenizer file gives that token's id unless
    ``specials_as_text``.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker("pieces")
        encode = tokenizer_words(path, specials_as_text)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40, least)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [str(t, "utf-8", "replace") for t in batch.column("text").to_pylist()]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                    bins.add(doc, ids + end)
                    if bins.held > 250_000:
                        yield bins.take()
        bins.finish()
        yield bins.take()

    return bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
