"""Spelling variants: words of one corpus that differ by one inserted, deleted or replaced letter.

A word and a near one share the word's first or last half.  Words that share a half meet in one
group, which makes a minimal acyclic automaton of its words, of the words read backwards for the
second halves; states count the words beyond them, so a path gives the word's number in order.
The query word's half is matched exactly, the rest with one error; what both directions would
find is left to the forward one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, slices, small, stored, table, text_bytes

#: Latin-1 letters, A-Z lower-cased; every other byte is a blank.  A byte is a code point here.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def runs_of(text: bytes) -> list[bytes]:
    """The runs of letters of a text in UTF-8, each in Latin-1."""
    return text.decode("utf-8", "replace").encode("latin-1", "replace").translate(LETTERS).split()


def with_slip(run: bytes, prefix: int, every: int) -> bytes:
    """The run without one letter if ``every`` divides its hash, which goes on from that of the id."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    return run if h % every else run[: (k := h % len(run))] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_letters: int, least_count: int, every: int) -> DataFrame:
    """(word, n): words in Latin-1 and their occurrences over all rows; tasks pre-aggregate in a bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for letters, n in Counter(runs_of(text.as_py())).items():
                        if len(letters) >= least_letters and len(word := with_slip(letters, prefix, every)) >= least_letters:
                            counts[word] += n
                if len(counts) > 300_000:
                    yield take()
        yield take()

    rows = bounded_batches(docs.select(F.col(id_col).cast("string").alias("doc_id"), text_bytes(text_col).alias("text")))
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WordAutomaton:
    """Minimal acyclic automaton of sorted distinct words, with the number of each.

    An edge has the next state and how many words of its own state come before those beyond it, so
    the numbers along a path sum to the place of its word.
    """

    def __init__(self, words: list[bytes]):
        self.edges: list[dict[int, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.beyond: list[int] = []
        self.known: dict[tuple, int] = {}
        # States on the path of the last word are open: whether a word ends there, its letter-state pairs.
        last, ends, pairs = b"", [False], [[]]
        for word in words:
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            for letter in reversed(last[shared:]):
                state = self.closed(ends.pop(), pairs.pop())
                pairs[-1].append((letter, state))
            for _ in word[shared:]:
                ends.append(False)
                pairs.append([])
            ends[-1] = True
            last = word
        for letter in reversed(last):
            state = self.closed(ends.pop(), pairs.pop())
            pairs[-1].append((letter, state))
        self.start = self.closed(ends.pop(), pairs.pop())
        self.known.clear()

    def closed(self, final: bool, pairs: list[tuple[int, int]]) -> int:
        """The state that equals this one, a new one if there is none."""
        key = (final, *pairs)
        if (state := self.known.get(key)) is None:
            state = self.known[key] = len(self.edges)
            edges, before = {}, int(final)
            for letter, child in pairs:
                edges[letter] = (child, before)
                before += self.beyond[child]
            self.edges.append(edges)
            self.final.append(final)
            self.beyond.append(before)
        return state

    def number(self, word: bytes) -> int | None:
        state, number = self.start, 0
        for letter in word:
            if (edge := self.edges[state].get(letter)) is None:
                return None
            state, number = edge[0], number + edge[1]
        return number if self.final[state] else None

    def one_error(self, word: bytes, exact: int) -> set[int]:
        """Numbers of the words that begin with word[:exact] and differ after it by one letter inserted, deleted or replaced."""
        edges, final = self.edges, self.final
        found: set[int] = set()

        def rest(state: int, number: int, at: int) -> None:
            for letter in word[at:]:
                if (edge := edges[state].get(letter)) is None:
                    return
                state, number = edge[0], number + edge[1]
            if final[state]:
                found.add(number)

        state, number = self.start, 0
        for at in range(len(word) + 1):
            here, letter, after = edges[state], word[at] if at < len(word) else -1, word[at + 1] if at + 1 < len(word) else -1
            if at >= exact:
                # Of equal letters in a row only the first is deleted, and none like the one before is inserted.
                same = word[at - 1] if at > exact else -1
                if at < len(word) and letter != same:
                    rest(state, number, at + 1)
                for other, (child, before) in here.items():
                    # A step is taken only where the next letter, if there is one, can follow.
                    follows = edges[child]
                    if other != same and (letter < 0 or letter in follows):
                        rest(child, number + before, at)
                    if other != letter and letter >= 0 and (after < 0 or after in follows):
                        rest(child, number + before, at + 1)
            if (edge := here.get(letter)) is None:
                break
            state, number = edge[0], number + edge[1]
        return found


NEAR = pa.schema([("word", pa.binary()), ("n_near", pa.int64()), ("best", pa.struct([("minus_n", pa.int64()), ("near", pa.binary())]))])
NEAR_DDL = "word binary, n_near long, best struct<minus_n: long, near: binary>"


def halves(words: DataFrame) -> DataFrame:
    """Rows of (word, n) for each direction and half length in which a near word could ask for it; ``asks`` marks the word's own half."""
    m, rows = F.octet_length("word"), []
    for backward in (False, True):
        own = F.floor((m + 1) / 2) if backward else F.floor(m / 2)
        # A word one letter shorter or longer has this half.
        other = own + F.when((m % 2 == 0) != F.lit(backward), -1).otherwise(1)
        for asks, length in ((True, own), (False, other)):
            half = F.substring("word", F.lit(1), length.cast("int")) if not backward else F.substring("word", (m - length + 1).cast("int"), length.cast("int"))
            rows.append(F.struct(F.lit(backward).alias("backward"), F.xxhash64(F.lit(backward), half).alias("half"), F.lit(asks).alias("asks")))
    return words.select("word", "n", F.explode(F.array(*rows)).alias("h")).select("word", "n", "h.*")


def near_words(words: DataFrame, group_letters: int = 500_000, most_in_half: int = 20_000) -> DataFrame:
    """(word, n_near, best) of the stored (word, n): how many words are near, and the most frequent of them (ties: the smallest).

    A word has rows in the groups of the halves that near words could ask with, and asks in those of
    its own.  Groups are halves by hash, of about ``group_letters`` letters.  The words of a half
    that over ``most_in_half`` share are cut into blocks of that size, the asked and the asking ones
    alike, and every pair of blocks is a group, so no group grows with the corpus.
    """
    letters = words.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    groups = max(1, -(-2 * letters // group_letters))
    rows = halves(words)
    counted = rows.groupBy("half").count().where(F.col("count") > most_in_half)
    hot = stored(counted.select("half", F.ceil(F.col("count") / most_in_half).cast("int").alias("blocks")), "hot-halves")
    rows = rows.join(small(hot), "half", "left")
    own, blocks = F.pmod(F.xxhash64("word"), "blocks").cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)

    def place(asked: Column, asking: Column, member: Column, asks: Column) -> Column:
        return F.struct(asked.alias("asked"), asking.alias("asking"), member.alias("member"), asks.alias("asks"))

    yes, no = F.lit(True), F.lit(False)
    as_member = F.transform(blocks, lambda j: place(own, j, yes, F.col("asks") & (j == own)))
    as_asking = F.transform(F.filter(blocks, lambda i: F.col("asks") & (i != own)), lambda i: place(i, own, no, yes))
    alone = F.array(place(F.lit(-1), F.lit(-1), yes, F.col("asks")))
    rows = rows.withColumn("place", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(as_member, as_asking))))
    group = F.when(F.col("blocks").isNull(), F.pmod("half", F.lit(groups))).otherwise(F.col("half"))

    def run(batch: pa.Table) -> pa.Table:
        backward = batch.column("backward")[0].as_py()
        turn = slice(None, None, -1 if backward else 1)
        names = [w[turn] for w in batch.column("word").to_pylist()]
        counts, member, asks = (batch.column(c).to_numpy() for c in ("n", "member", "asks"))
        count_of = {names[i]: c for i, c in zip(np.flatnonzero(member).tolist(), counts[member].tolist())}
        known = sorted(count_of)
        minus = [-count_of[w] for w in known]
        automaton = WordAutomaton(known)
        out = []
        for word in {names[i] for i in np.flatnonzero(asks).tolist()}:
            m = len(word)
            found = automaton.one_error(word, (m + 1) // 2 if backward else m // 2)
            if backward:
                # A word that shares the first half too is found forwards.
                first = word[m - m // 2 :]
                found = [(minus[i], known[i][::-1]) for i in found if not known[i].endswith(first)]
            else:
                found = [(minus[i], known[i]) for i in found]
            if found:
                least = min(found)
                out.append((word[turn], len(found), {"minus_n": least[0], "near": least[1]}))
        columns = zip(*out) if out else [[]] * 3
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NEAR)], schema=NEAR)

    dealt = rows.select("word", "n", "backward", group.alias("dealt"), "place.*")
    return dealt.groupBy("backward", "dealt", "asked", "asking").applyInArrow(run, NEAR_DDL)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the stored (word, form): the last of the forms that a word leads to.

    A form's count is a multiple of its word's, so chains end; each round doubles the steps taken.
    """
    hops = forms.select("word", F.col("form").alias("root"))
    while True:
        beyond = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = stored(hops.join(small(beyond), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if hops.where("moved").isEmpty():
            return hops.select("word", "root")


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199,
    group_letters: int = 500_000, most_in_half: int = 20_000,
) -> DataFrame:
    """The words of all texts with their near words, form and root.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased; a run whose hash with its
    document's id ``every`` divides loses a letter (the dealt rule of planted slips).  Kept are
    those of ``least_letters`` and ``least_count`` occurrences.  One row a word: ``word``, ``form``
    (the near word of largest count, ties: the smallest in code-point order, if its count is
    ``ratio`` times the word's; else null), ``root`` (where forms lead; the word itself without
    one), ``n``, ``n_near`` and ``form_n``.

    Null and empty texts have no words, a null id counts as an empty one, repeated rows count
    each, other columns are ignored, words may be of any length and an empty table gives no rows.
    """
    words = stored(word_counts(docs, id_col, text_col, least_letters, least_count, every), "spelling-words")
    near = near_words(words, group_letters, most_in_half)
    none = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus_n: long, near: binary>").alias("best"), "n")
    every_word = none.unionByName(near.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    better = -F.col("best.minus_n") >= ratio * F.col("n")
    rows = stored(every_word.select("word", "n", "n_near", F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.minus_n")).alias("form_n")), "spelling-forms")
    with_roots = rows.join(small(roots(rows.where("form IS NOT NULL"))), "word", "left")
    return with_roots.select(
        F.decode("word", "ISO-8859-1").alias("word"),
        F.decode("form", "ISO-8859-1").alias("form"),
        F.decode(F.coalesce("root", "word"), "ISO-8859-1").alias("root"),
        "n",
        "n_near",
        "form_n",
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: Near words meet where deletions of a letter are equal; crc32 is computed from its table, byte by byte.
ORACLE = r"""
WITH crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS h FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents)
  GROUP BY doc_id, run HAVING length(run) >= 6),
bytes AS (
  SELECT run, n, list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)) AS b
  FROM runs),
hashed AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, min(other) FILTER (n = top) AS near
  FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN near END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word))
SELECT f.word, f.form, coalesce(f5.form, f4.form, f3.form, f2.form, f1.form, f.form, f.word) AS root, f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN forms f1 ON f1.word = f.form LEFT JOIN forms f2 ON f2.word = f1.form LEFT JOIN forms f3 ON f3.word = f2.form
LEFT JOIN forms f4 ON f4.word = f3.form LEFT JOIN forms f5 ON f5.word = f4.form
"""
