"""Byte-level BPE by recursive queries.

Each Spark partition runs DuckDB.  Token-position rows of the words that are new to it join the
merge table; every step contracts each word's leftmost pair of minimum rank until no pair is
left.  Decoding joins ids to byte strings and aggregates them in order.

A long word is contracted as overlapping pieces of itself.  A contraction inside a span does not depend
on what lies outside as long as none crosses its ends, so tokens are those of a word if and only if
every two neighbours among them are the tokens of their own bytes.  Two pieces that have a token
in common at the same place may therefore be joined there; pieces without one become one piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_worker, slices, table, text_bytes
from .pieces import Memory, Words

#: One step contracts one pair a word.  state: word << 32 | position, token; live until the fixpoint.
LEFTMOST = """
WITH RECURSIVE state(k, tok, live) AS (
    SELECT (w::BIGINT << 32) | pos, tok, true FROM start_rows
  UNION ALL
    (WITH pairs AS (
       SELECT k, tok, lead(tok) OVER o AS next_tok, lead(k) OVER o AS next_k, lag(k) OVER o AS prev_k
       FROM state WHERE live WINDOW o AS (ORDER BY k)),
     lowest AS (
       SELECT k >> 32 AS w, min((m.merged::BIGINT << 32) | (k & 4294967295)) AS best
       FROM pairs JOIN merges m ON m.pair = (tok::BIGINT << 32) | next_tok
       WHERE next_k >> 32 = k >> 32 GROUP BY 1)
     SELECT k, CASE WHEN k & 4294967295 = best & 4294967295 THEN (best >> 32)::INTEGER ELSE tok END, best IS NOT NULL
     FROM pairs LEFT JOIN lowest ON w = k >> 32
     WHERE best IS NULL OR prev_k IS NULL OR prev_k <> ((k >> 32) << 32 | (best & 4294967295)))
)
SELECT (k >> 32)::INTEGER AS w, tok FROM state WHERE NOT live ORDER BY k
"""
#: For long words one step contracts all occurrences of the minimum pair, leftmost first without
#: overlap, where no pair with the new token has a lower rank; else the leftmost alone.
ALL_OCCURRENCES = """
WITH RECURSIVE state(w, pos, tok, live) AS (
    SELECT w, pos, tok, true FROM start_rows
  UNION ALL
    SELECT w, pos, CASE WHEN taken THEN best ELSE tok END, best IS NOT NULL
    FROM (
      SELECT w, pos, tok, best, taken, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS eaten
      FROM (
        SELECT w, pos, tok, best,
               best IS NOT NULL AND coalesce(merged = best, false) AND CASE WHEN best IN (SELECT tok FROM unsafe)
                 THEN k = 1 ELSE (k - min(k) OVER (PARTITION BY w, merged = best, i - k)) % 2 = 0 END AS taken
        FROM (
          SELECT w, pos, tok, merged, best, i, row_number() OVER (PARTITION BY w, merged = best ORDER BY pos) AS k
          FROM (
            SELECT s.w, s.pos, s.tok, s.i, m.merged, min(m.merged) OVER (PARTITION BY s.w) AS best
            FROM (SELECT w, pos, tok, lead(tok) OVER o AS next_tok, row_number() OVER o AS i
                  FROM state WHERE live WINDOW o AS (PARTITION BY w ORDER BY pos)) s
            LEFT JOIN merges m ON m.pair = (s.tok::BIGINT << 32) | s.next_tok))))
    WHERE NOT eaten
)
SELECT w, tok FROM state WHERE NOT live ORDER BY w, pos
"""
DECODE = """
SELECT d, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM token_rows JOIN vocabulary USING (tok) GROUP BY d
"""


class BytePairs(Words):
    """Ranks and merge table of one vocabulary in a DuckDB connection of this Python worker.

    Encoding remembers distinct words, decoding distinct runs of tokens up to the next token
    that begins with a space; DuckDB contracts and spells what is new.
    """

    LONG = 1024  # bytes of a word from which all occurrences of a pair are contracted in one step
    PIECE = 128  # bytes of the pieces of words over twice as long; neighbours share half

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own_pattern, self.split = pattern != public_tokenizers.PATTERN, regex.compile(pattern).findall
        super().__init__(self.encode_words, self.encode_pieces)
        self.runs = Memory(self.decode_runs, 50_000, 256)
        self.begins_run = np.zeros(max(self.ranks.values()) + 1, bool)
        self.begins_run[[r for t, r in self.ranks.items() if t.startswith(b" ")]] = True
        self.lengths = np.zeros(len(self.begins_run), np.int64)
        self.lengths[list(self.ranks.values())] = [len(t) for t in self.ranks]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": False})
        self.con.execute("SET enable_progress_bar = false")
        rows = [
            (left << 32 | right, merged)
            for token, merged in self.ranks.items()
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None
        ]
        merges = pa.table({"pair": pa.array([r[0] for r in rows], pa.int64()), "merged": pa.array([r[1] for r in rows], pa.int32())})
        unsafe = sorted({t for pair, merged in rows for t in (pair >> 32, pair & 0xFFFFFFFF) if merged < t})
        words = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        for name, data in (("merges", merges), ("unsafe", pa.table({"tok": pa.array(unsafe, pa.int32())})), ("vocabulary", words)):
            self.con.register("new_rows", data)
            self.con.execute(f"CREATE TABLE {name} AS FROM new_rows")
            self.con.unregister("new_rows")

    def contract(self, words: list[bytes], query: str) -> list[bytes]:
        """Ids of each word, as buffers of unsigned 32-bit integers."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        first = np.cumsum(sizes) - sizes
        pos = (np.arange(len(w)) - first[w]).astype(np.int32)
        tok = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self.con.register("start_rows", pa.table({"w": w, "pos": pos, "tok": tok}))
        out = self.con.execute(query).fetchnumpy()
        self.con.unregister("start_rows")
        counts = np.bincount(np.asarray(out["w"]), minlength=len(words))
        ends = (4 * np.cumsum(counts)).tolist()
        raw = np.asarray(out["tok"]).astype("<u4").tobytes()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; a word in the vocabulary is its own token."""
        out = [b""] * len(words)
        new: list[int] = []
        for i, word in enumerate(words):
            if word == b"\0":  # stands between texts
                continue
            if (rank := self.ranks.get(word)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(word) > 2 * self.PIECE:
                out[i] = self.long_word(word)
            else:
                new.append(i)
        for i, ids in zip(new, self.contracted([words[i] for i in new])):
            out[i] = ids
        return out

    def contracted(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, a bounded number of bytes at a time."""
        out = [b""] * len(words)
        groups: dict[bool, list[int]] = {False: [], True: []}
        for i, word in enumerate(words):
            groups[len(word) > self.LONG].append(i)
        for long, places in groups.items():
            start, held = 0, 0
            for k, i in enumerate(places):
                held += len(words[i])
                if held >= 300_000 or k == len(places) - 1:
                    group = places[start : k + 1]
                    for at, ids in zip(group, self.contract([words[g] for g in group], ALL_OCCURRENCES if long else LEFTMOST)):
                        out[at] = ids
                    start, held = k + 1, 0
        return out

    def long_word(self, word: bytes) -> bytes:
        """Ids of a word from those of its pieces, joined at a token that neighbours share."""
        half = self.PIECE // 2
        begin = np.arange(0, len(word) - half, half)
        end = np.minimum(begin + self.PIECE, len(word))
        end[-1] = len(word)
        done: dict[tuple[int, int], np.ndarray] = {}
        spread = 0
        while True:
            places = list(zip(begin.tolist(), end.tolist()))
            fresh = [p for p in places if p not in done]
            texts = [word[i:j] for i, j in fresh]
            distinct = list(dict.fromkeys(texts))
            found = dict(zip(distinct, self.contracted(distinct)))
            done = {p: done[p] for p in places if p in done} | {p: np.frombuffer(found[t], "<u4") for p, t in zip(fresh, texts)}
            tokens = np.concatenate([done[p] for p in places])
            piece = np.repeat(np.arange(len(places)), [len(done[p]) for p in places])
            length = self.lengths[tokens]
            at = np.cumsum(length) - length
            at += (begin - at[np.searchsorted(piece, np.arange(len(places)))])[piece]
            key = at << 16 | length
            left = (piece < len(places) - 1) & (at >= np.append(begin[1:], 0)[piece])
            right = (piece > 0) & (at + length <= np.append(0, end[:-1])[piece])
            shared = np.intersect1d(key[left], key[right])
            zone, first = np.unique(np.searchsorted(begin[1:], shared >> 16, "right") - 1, return_index=True)
            if len(zone) == len(places) - 1:
                cuts = (shared[first] >> 16) + (shared[first] & 0xFFFF)
                keep = (at >= np.append(0, cuts)[piece]) & (at < np.append(cuts, len(word))[piece])
                return tokens[keep].astype("<u4").tobytes()
            apart = np.ones(len(places) - 1, bool)
            apart[zone] = False
            united = np.zeros(len(places) - 1, bool)
            for k in range(-spread, spread + 1):  # what stays apart takes in more neighbours each round
                moved = np.flatnonzero(apart) + k
                united[moved[(moved >= 0) & (moved < len(united))]] = True
            begin, end = begin[np.append(True, ~united)], end[np.append(~united, True)]
            spread = 2 * spread + 1

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that the expression cuts into words."""
        split = [[w.encode() for w in self.split(p.decode())] for p in pieces]
        distinct = list({w for words in split for w in words})
        found = dict(zip(distinct, self.words(distinct))) | {b"\0": self.byte_ids[:1].tobytes()}
        return [b"".join([found[w] for w in words]) for words in split]

    def plain(self, text: str) -> bool:
        return not self.own_pattern and super().plain(text)

    def mixed(self, text: str) -> bytes:
        return self.encode_pieces([text.encode()])[0] if self.own_pattern else super().mixed(text)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text from the tokens of all and where each ends."""
        if not len(ids):
            return [b""] * len(ends)
        begins = self.begins_run[ids]
        begins[ends[ends < len(ids)]] = True
        begins[0] = True
        starts = np.flatnonzero(begins)
        spelled, at = self.runs.spell(ids.astype("<i4").tobytes(), 4 * starts)
        edges = at[np.searchsorted(starts, ends)].tolist()
        return [bytes(spelled[a:b]) for a, b in zip([0, *edges], edges)]

    def decode_runs(self, runs: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        d = np.repeat(np.arange(len(runs), dtype=np.int32), sizes)
        tok = np.frombuffer(b"".join(runs), "<i4")
        self.con.register("token_rows", pa.table({"d": d, "pos": np.arange(len(d), dtype=np.int32), "tok": tok}))
        out = [b""] * len(runs)
        for run, raw in self.con.execute(DECODE).fetchall():
            out[run] = raw
        self.con.unregister("token_rows")
        return out


_LOADED: dict[tuple, BytePairs] = {}


def model(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairs(path, pattern)
    return _LOADED[path, pattern]


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([*IDS, ("bytes", pa.binary())])


def encoded(batches: Iterator[pa.RecordBatch], pairs: BytePairs) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = pairs([str(t, "utf-8", "replace") for t in batch.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], schema=IDS)


def decoded(batches: Iterator[pa.RecordBatch], pairs: BytePairs) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        ends = whole.column("ids").offsets.to_numpy()
        start = 0
        while start < whole.num_rows:  # a bounded number of tokens at a time, one row at least
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + 1_000_000, "right")) - 1)
            part = whole.slice(start, stop - start)
            values = part.column("ids")
            at = values.offsets.to_numpy()
            raw = pairs.decode(values.values.to_numpy()[at[0] : at[-1]], at[1:] - at[0])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values, pa.array(raw, pa.binary())], schema=DECODED)
            start = stop


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, and_decode: bool = False
) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text, without special tokens.

    ``ranks`` is a tiktoken rank file and ``pattern`` the expression that splits texts into
    words.  A null or empty text has no ids.  Repeated rows give repeated rows; a null id stays
    null; other columns are ignored; an empty table gives no rows.  ``and_decode`` adds what
    :func:`decode` gives for the ids, by the same worker.
    """
    path, words = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker("bpe")
        pairs = model(path, words)
        ids = encoded(batches, pairs)
        yield from decoded(ids, pairs) if and_decode else ids

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>" + (", bytes binary" if and_decode else "")
    )


def decode(tokens: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``bytes``, the concatenated byte strings of ``ids`` (columns of those names are read).

    Null or empty ids give no bytes.  A null ``doc_id`` stays null; repeated rows give repeated
    rows; other columns are ignored; an empty table gives no rows.  Ids that are not in the
    vocabulary are an error.
    """
    path, words = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker("bpe")
        yield from decoded(batches, model(path, words))

    return bounded_batches(tokens).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(
        run, "doc_id long, ids array<int>, bytes binary"
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), and_decode=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
