"""Benchmark decontamination with an Aho-Corasick automaton over the windows of all test items.

Texts and items become words (A-Z lower-cased, everything but letters, digits and non-ASCII
characters left out); every word of the benchmark gets a code of fixed width, all other words one
more.  The automaton of the windows' codes reads each document's codes once; where it ends in a
window, the place divided by the width is the place of a word, and that of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_names, fresh_worker, slices, stored, table, text_bytes

#: Bytes of words, A-Z lower-cased; every other byte is a blank.  Non-ASCII characters are words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Symbols of a place of a code; each place has its own, so no match begins inside a code.
BASE = 64


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def pieces(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A long text in pieces of about ``size`` bytes that end between words."""
    start = 0
    while start < len(text):
        cut = text.find(b" ", start + size)
        end = len(text) if cut < 0 else cut
        yield text[start:end]
        start = end


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """Distinct (item, window): ``size`` consecutive words of an item's text, or all of a shorter one.

    Ids are taken as strings.  Items without an id or without words have no windows; an item on
    several rows has those of all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text")):
                words = words_of(text.as_py())
                found = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
                for part in batched(sorted(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(part)), pa.array(part, pa.binary())], names=["item", "window"])

    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "item string, window binary").distinct()


def batched(values: list, n: int) -> Iterator[list]:
    for start in range(0, len(values), n):
        yield values[start : start + n]


def union(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans (first and last place) without overlaps, in order."""
    by = np.argsort(first, kind="stable")
    first, reach = first[by], np.maximum.accumulate(last[by])
    start = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return first[start], reach[np.append(start[1:] - 1, len(reach) - 1)]


class Windows:
    """The automaton of (window, items) pairs."""

    def __init__(self, pairs: Iterable[tuple[bytes, list[str]]]):
        self.items, self.lengths, split = [], [], []
        codes: dict[bytes, str] = {}
        for window, items in pairs:
            words = window.split(b" ")
            split.append(words)
            self.items.append(items)
            self.lengths.append(len(words))
            for w in words:
                codes.setdefault(w, "")
        self.width = next(n for n in range(1, 9) if BASE**n >= len(codes))
        for i, w in enumerate(codes):
            codes[w] = "".join(chr(BASE * k + i // BASE**k % BASE) for k in range(self.width))
        self.codes, self.other = codes, chr(BASE * self.width) * self.width
        self.lengths = np.array(self.lengths, np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, words in enumerate(split):
            self.automaton.add_word("".join(codes[w] for w in words), i)
        self.automaton.make_automaton()

    def find(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """How many words the text has; first and last word of each occurrence; its window."""
        n, ends, walk = 0, [], None
        code, other = self.codes.get, self.other
        for part in pieces(text.translate(WORD_BYTES)):
            words = part.split()
            n += len(words)
            if not len(self.lengths) or not words:
                continue
            row = "".join([code(w, other) for w in words])
            if walk is None:
                walk = self.automaton.iter(row)
            else:
                walk.set(row, False)
            ends += walk
        at, window = np.array(ends, np.int64).reshape(-1, 2).T
        last = at // self.width
        return n, np.stack([last - self.lengths[window] + 1, last]) if len(last) else np.zeros((2, 0), np.int64), window


SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
SPANS_DDL = "array<struct<first: long, last: long, start: long, end: long>>"
FOUND_DDL = f"struct<n_words: long, spans: {SPANS_DDL}, items: array<string>>"
_LOADED: dict[str, Windows] = {}


def loaded(key: str, pairs: Broadcast) -> Windows:
    """The automaton of these pairs; a worker holds one at a time."""
    if key not in _LOADED:
        _LOADED.clear()
        fresh_worker("decontamination")
        _LOADED[key] = Windows(pairs.value)
    return _LOADED[key]


def original(text: bytes, first: np.ndarray, last: np.ndarray) -> list[dict]:
    """The spans of words with the offsets of their characters in the text."""
    out, k = [], 0
    for i, m in enumerate(WORD.finditer(text.translate(WORD_BYTES))):
        if i == first[k]:
            start = m.start()
        if i == last[k]:
            out.append({"first": int(first[k]), "last": i, "start": start, "end": m.end()})
            k += 1
            if k == len(first):
                break
    # From bytes to characters: bytes that continue a character are not counted.
    heads = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
    places = np.unique([0, *(s[x] for s in out for x in ("start", "end"))])
    counts = [int(np.count_nonzero(heads[a:b])) for a, b in zip(places[:-1], places[1:])]
    chars = dict(zip(places.tolist(), np.cumsum([0, *counts]).tolist()))
    return [s | {x: chars[s[x]] for x in ("start", "end")} for s in out]


def found_in(docs: DataFrame, pairs: Broadcast, text: Column, keep: list[str], hits: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``hits``: words, spans and items of each text, from one scan."""
    name, key = fresh_names(docs, "text_bytes")[0], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = loaded(key, pairs)
        for whole in batches:
            for batch in slices(whole, name):
                out = []
                for text in batch.column(name):
                    text = text.as_py()
                    n, (first, last), window = windows.find(text)
                    spans = original(text, *union(first, last)) if len(window) else []
                    items = {item for w in np.unique(window).tolist() for item in windows.items[w]}
                    out.append({"n_words": n, "spans": spans, "items": sorted(items)})
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, FOUND)], names=[*keep, hits])

    schema = docs.select(*keep, F.lit(None).cast(FOUND_DDL).alias(hits)).schema
    return bounded_batches(docs.select(*keep, text.alias(name))).mapInArrow(run, schema)


def merged(spans: Column) -> Column:
    """Spans in order of their first word, overlapping ones as one."""
    ordered = F.array_sort(spans)

    def step(done: Column, s: Column) -> Column:
        top = F.element_at(done, -1)
        wider = F.when(s["last"] > top["last"], F.struct(top["first"], s["last"], top["start"], s["end"])).otherwise(top)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        return F.when(s["first"] > top["last"], F.concat(done, F.array(s))).otherwise(joined).cast(SPANS_DDL)

    rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.when(F.size(spans) > 0, F.aggregate(rest, F.slice(ordered, 1, 1).cast(SPANS_DDL), step)).otherwise(ordered)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None, most_pairs: int = 500_000
) -> DataFrame:
    """``docs`` with a column ``hits`` (``hits_`` if there is one): what of each text is in the benchmark.

    ``hits`` has ``n_words``, ``n_hit`` (words inside any occurrence of a window of ``size`` item
    words), ``spans`` (disjoint, in order: first and last word, and start and end of the characters
    in the original text) and ``items`` (ids of items with an occurring window, as sorted strings).

    A null text has no words.  Every row is kept, repeated ones too, with all its columns or those
    of ``keep``.  An item of fewer words than ``size`` is one window; items without words or id never
    occur; with an empty benchmark nothing is hit.  Texts of any length are read whole, in pieces
    between which the automaton keeps its state.

    The automaton's (item, window) pairs are counted first.  Up to ``most_pairs`` (about 0.5 GB in a
    Python worker at windows of ten words) one automaton holds all and texts are scanned once.
    More pairs are split by hash into automata of that size; each scans all texts in turn, and the
    spans and items of a row are united.
    """
    spark, keep = docs.sparkSession, keep or docs.columns
    pairs = stored(item_windows(benchmark, item_col, item_text, size), "benchmark-windows")
    blocks = max(1, -(-pairs.count() // most_pairs))
    row, hits = fresh_names(docs, "row", "hits")

    def shipped(k: int) -> Broadcast:
        mine = pairs.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == k)
        rows = mine.groupBy("window").agg(F.collect_set("item").alias("items")).toArrow()
        return spark.sparkContext.broadcast(list(zip(rows["window"].to_pylist(), rows["items"].to_pylist())))

    if blocks == 1:
        found = found_in(docs, shipped(0), text_bytes(text_col), keep, hits)
    else:
        docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "benchmark-texts")
        every = None
        for k in range(blocks):
            sent = shipped(k)
            part = found_in(docs, sent, text_bytes(text_col), [row], hits)
            part = stored(part if k == 0 else part.where(F.size(F.col(hits)["spans"]) > 0), "benchmark-hits")
            sent.destroy()
            every = part if every is None else every.unionByName(part)
        h = F.col(hits)
        united = F.struct(
            F.max(h["n_words"]).alias("n_words"),
            merged(F.flatten(F.collect_list(h["spans"]))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(h["items"])))).alias("items"),
        )
        found = docs.select(row, *keep).join(every.groupBy(row).agg(united.alias(hits)), row).drop(row)
    h = F.col(hits)
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.withColumn(hits, F.struct(h["n_words"].alias("n_words"), n_hit.alias("n_hit"), h["spans"].alias("spans"), h["items"].alias("items")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


#: All runs of words of a window's length, joined with the windows on the words themselves.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT doc_id, item_id, k, i FROM places JOIN windows USING (k, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
