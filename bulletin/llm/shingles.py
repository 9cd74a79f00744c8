"""Distinct word shingles of whole texts as integers in a global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_worker, slices, text_bytes

#: Buckets of the frequency sketch, and the counts from which a bucket is in class 1, 2, ... 7.
BUCKET_BITS = 20
CLASS_FROM = np.array([2, 4, 16, 64, 256, 4096, 65536])
#: Shingles that a task looks at together, and bytes of text that are hashed together.
CHUNK, SLICE = 2_000_000, 500_000
RANDOM = np.random.default_rng(20240101)
#: A random number for each byte (0 for white space) and for each place in a word.
BYTES = RANDOM.integers(1, 1 << 64, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTES[SPACE] = 0
LONGEST = 1024
#: Random odd multipliers for the place of a byte in a word and of a word in a shingle.
PLACES_IN_WORD = RANDOM.integers(0, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between white space start in ``raw`` (bytes), and their 64-bit hashes."""
    space = SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    tail = raw[starts[0] :]
    first = starts - starts[0]
    spans = np.empty(len(first), np.int64)
    spans[:-1] = first[1:] - first[:-1]
    spans[-1] = len(tail) - first[-1]
    at = np.arange(len(tail)) - np.repeat(first, spans)
    h = np.add.reduceat(BYTES[tail] * PLACES_IN_WORD[np.minimum(at, LONGEST - 1)], first)
    for k in np.flatnonzero(spans >= LONGEST):
        word = tail[first[k] : first[k] + spans[k]].tobytes().split()[0]
        if len(word) >= LONGEST:
            h[k] = xxhash.xxh3_64_intdigest(word)
    h ^= h >> np.uint64(32)
    return starts, h * np.uint64(0x9E3779B97F4A7C15)


def mixed(codes: np.ndarray, size: int) -> np.ndarray:
    """60-bit hashes of all runs of ``size`` codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h += codes[k : k + n] * PLACES[k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h >> np.uint64(4)


def distinct(h: np.ndarray) -> np.ndarray:
    if len(h) < 2:
        return h
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def shingle_hashes(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 60-bit hashes of each text's word shingles; A-Z is lower-cased first.

    Words are what stands between the bytes 20 and 09-0D (hexadecimal).  A text of fewer words
    than ``size`` has one shingle, the whole sequence; one without words has none.
    """
    joined = b" ".join(texts).lower()
    starts, codes = word_hashes(np.frombuffer(joined, np.uint8))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    bounds = [0, *np.searchsorted(starts, ends).tolist()]
    runs = mixed(codes, size)
    out = []
    for i, j in zip(bounds, bounds[1:]):
        if j - i >= size:
            out.append(distinct(runs[i : j - size + 1]))
        else:
            out.append(mixed(codes[i:j], j - i) if j > i else codes[:0])
    return out


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").to_pylist()


def keys_of(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys in the global order: frequency class first, then hash."""
    cls = classes[(hashes >> np.uint64(60 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort(hashes | cls << np.uint64(60)).astype(np.int64)


def frequency_classes(texts: DataFrame, size: int) -> np.ndarray:
    """Frequency class of every bucket of hashes: a table of fixed size (one byte a bucket).

    Tasks count the shingles that different texts of a chunk share; by the birthday bound a
    shingle of more than a few times the root of the number of chunks is all but sure to show.
    The table only sets the global order, so what it misses costs time and loses nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker("shingles")
        totals = np.zeros(1 << BUCKET_BITS, np.int64)
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        n = 0

        def flush() -> None:
            if held:
                values = np.concatenate(held)
                held.clear()
                values.sort()
                again = np.zeros(len(values), bool)
                np.equal(values[1:], values[:-1], out=again[1:])
                again[:-1] |= again[1:]
                np.add.at(totals, (values[again] >> np.uint64(60 - BUCKET_BITS)).astype(np.int64), 1)

        for hashes in (h for whole in batches for batch in slices(whole, "text", SLICE) for h in shingle_hashes(raw_texts(batch), size)):
            if (same := xxhash.xxh3_128_digest(hashes.tobytes())) in seen:
                continue
            seen.add(same)
            held.append(hashes)
            n += len(hashes)
            if n > CHUNK:
                flush()
                seen, n = set(), 0
        flush()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at])], names=["bucket", "n"])

    found = (
        texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return np.searchsorted(CLASS_FROM, counts, "right").astype(np.uint8)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (bytes) and ``key``, a hash of both, so that rows without an id differ too."""
    doc_id, text = F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")
    return bounded_batches(docs).select(doc_id, text).withColumn("key", F.xxhash64("doc_id", "text"))


def set_hash(keys: np.ndarray) -> int:
    """64-bit hash of a set, signed."""
    return int.from_bytes(xxhash.xxh3_64_digest(keys.tobytes()), "big", signed=True)


def prefix_length(n: int, percent: int) -> int:
    """Keys of a set of n among which any set of that similarity shares one."""
    return n - -(-percent * n // 100) + 1 if n else 0


SETS = "doc_id long, key long, n_shingles long, set_id long, prefix array<long>"


def prefixes(texts: DataFrame, classes: np.ndarray, size: int, percent: int) -> DataFrame:
    """Size, 64-bit hash and prefix in the global order of every text's set."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker("shingles")
        table = shared.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = [keys_of(h, table) for h in shingle_hashes(raw_texts(batch), size)]
                cut = [k[: prefix_length(len(k), percent)] for k in sets]
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*cut, np.empty(0, np.int64)])))
                ids = np.array([set_hash(k) for k in sets], np.int64)
                sizes = pa.array([len(k) for k in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), sizes, pa.array(ids), lists], schema=schema)

    return texts.mapInArrow(run, SETS)


def pivots(fragments: int) -> np.ndarray:
    """Cuts of the global order: the rare class, which holds most keys, in equal parts, then the rest by class."""
    inner = max(1, fragments - 2)
    rare = [(1 << 60) // inner * k for k in range(1, inner)]
    return np.array([*rare, 1 << 60, 4 << 60][: fragments - 1] if fragments > 1 else [], dtype=np.int64)


def segments(texts: DataFrame, classes: np.ndarray, size: int, fragments: int) -> DataFrame:
    """(set_id, partners, fragment, keys): each text's keys cut at the pivots; empty segments are left out.

    A row whose text does not have the set of its ``set_id`` (another row of that id) gives none.
    """
    shared = texts.sparkSession.sparkContext.broadcast(classes)
    cuts = pivots(fragments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker("shingles")
        table = shared.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                rows, numbers, sizes, values = [], [], [], []
                for row, (set_id, hashes) in enumerate(zip(batch.column("set_id").to_pylist(), shingle_hashes(raw_texts(batch), size))):
                    keys = keys_of(hashes, table)
                    if set_hash(keys) != set_id:
                        continue
                    values.append(keys)
                    edges = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                    for k, (i, j) in enumerate(zip(edges, edges[1:])):
                        if j > i:
                            rows.append(row)
                            numbers.append(k)
                            sizes.append(j - i)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*values, np.empty(0, np.int64)])))
                own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("set_id", "partners")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), lists], names=["set_id", "partners", "fragment", "keys"])

    return texts.select("set_id", "partners", "text").mapInArrow(
        run, "set_id long, partners array<struct<b:bigint,n:int>>, fragment int, keys array<long>"
    )
