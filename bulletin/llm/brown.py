"""Brown class-based bigram language model over whole texts.

Every training word is counted and gets a class: the most frequent ones by exchange clustering
(each moves to the class that gains most likelihood, in sweeps), all others by exchange sweeps
that Spark tasks count for, each over all neighbours that have a class by then.  A table of the
frequent words is at hand in every task; classes and counts of the words beyond it are Parquet
tables that are joined.  Only words that training has not seen share a class, for which the words
seen once stand in.  A token's probability is that of its class after the class before it,
discounted and backed off to the class's own frequency, times that of the word in its class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, id_bucket, slices, stored, table, text_bytes

END = b""  # no word is empty
LONGEST_WORD = 1024
DISCOUNT = 0.5
#: Groups of words whose counts one task sums, and codes that a task counts together.
BLOCKS, CODES = 128, 3_000_000


def words_of(text: bytes) -> list[bytes]:
    """Words between the bytes 20 and 09-0D (hexadecimal), A-Z lower-cased, and one end."""
    words = text.lower().split()
    words.append(END)
    return words


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows; tasks pre-aggregate in a bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"]
            )
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                counts.update(words_of(text.as_py()))
                if len(counts) > 500_000:
                    yield take()
        yield take()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(vocabulary: DataFrame, most: int, most_bytes: int = 1 << 24) -> list[tuple[bytes, int]]:
    """The most frequent words without the end token, in order of count.

    At most ``most`` words and ``most_bytes`` bytes of words of up to 1024 bytes.  A histogram of
    logarithmic count classes, and one of hash classes within the count class that is cut, give
    the bounds, so only these rows are read.
    """
    step, part = F.floor(F.log2("c") * 16), F.pmod(F.xxhash64("word"), F.lit(1024))
    short = vocabulary.where(F.octet_length("word").between(1, LONGEST_WORD))
    size = [F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("bytes")]
    inside, total, held, cut = F.lit(False), 0, 0, None
    for row in short.groupBy(step.alias("step")).agg(*size).orderBy(F.desc("step")).collect():
        if total + row["n"] > most or held + row["bytes"] > most_bytes:
            cut = row["step"]
            break
        inside, total, held = step >= row["step"], total + row["n"], held + row["bytes"]
    if cut is not None:
        last = None
        for row in short.where(step == cut).groupBy(part.alias("part")).agg(*size).orderBy("part").collect():
            if total + row["n"] > most or held + row["bytes"] > most_bytes:
                break
            last, total, held = row["part"], total + row["n"], held + row["bytes"]
        if last is not None:
            inside = inside | ((step == cut) & (part <= last))
    rows = short.where(inside).select("word", "c").toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist()), key=lambda x: (-x[1], x[0]))


SEQUENCES = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("ids", pa.binary()), ("rare", pa.list_(pa.binary()))]
)


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows, and where each row's end."""
    ids = batch.column("ids")
    return np.frombuffer(b"".join(ids.to_pylist()), np.int32), np.cumsum(pc.binary_length(ids).to_numpy()) // 4


def sequences(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """Each text as places in the word table (its size for all others; bytes of 32-bit integers), with the other words."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(shared.value)}
        beyond = len(place)
        for whole in batches:
            for batch in slices(whole, "text"):
                split = [words_of(t) for t in batch.column("text").to_pylist()]
                flat = list(chain.from_iterable(split))
                ids = np.fromiter(map(place.get, flat, repeat(beyond)), np.int32, len(flat))
                ends = np.concatenate([[0], np.cumsum([len(w) for w in split])])
                at = np.flatnonzero(ids == beyond)
                rare = pa.array([flat[i] for i in at.tolist()], pa.binary())
                rare_ends = np.searchsorted(at, ends).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("doc_id"),
                        batch.column("learn"),
                        pa.array([ids[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary()),
                        pa.ListArray.from_arrays(rare_ends, rare),
                    ],
                    schema=SEQUENCES,
                )

    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "learn", "text").mapInArrow(
        run, "row long, doc_id long, learn boolean, ids binary, rare array<binary>"
    )


AROUND = pa.schema(
    [("row", pa.int64()), ("learn", pa.bool_()), ("pos", pa.int32()), ("word", pa.binary()), ("before", pa.int32()), ("after", pa.int32()), ("rare_before", pa.binary())]
)


def around(rows: DataFrame, m: int) -> DataFrame:
    """Each token beyond the table of ``m`` words with its neighbours' places, and the word before it if that is beyond it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, ends), words = ids_of(batch), batch.column("rare").flatten()
            at = np.flatnonzero(ids == m)
            if not len(at):
                continue
            owner = np.searchsorted(ends, at, "right")
            before, after = ids[at - 1], ids[at + 1]  # the end token comes before and after each text
            earlier = pa.array(np.maximum(np.arange(len(at)) - 1, 0), mask=before != m)
            full = [batch.column(c).take(pa.array(owner)) for c in ("row", "learn")]
            whole = pa.RecordBatch.from_arrays(
                [*full, pa.array(at, pa.int32()), words, pa.array(before), pa.array(after), words.take(earlier)], schema=AROUND
            )
            for start in range(0, len(at), 10_000):
                yield whole.slice(start, 10_000)

    return rows.select("row", "learn", "ids", "rare").mapInArrow(
        run, "row long, learn boolean, pos int, word binary, before int, after int, rare_before binary"
    )


def counted(rows: DataFrame, codes_of) -> DataFrame:
    """(code, n): how often each code occurs that ``codes_of`` gives for (previous ids, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def take() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

        for batch in batches:
            ids, _ = ids_of(batch)
            if len(ids):
                held.append(codes_of(np.concatenate([ids[-1:], ids[:-1]]), ids))  # every text ends with the end token
            if sum(map(len, held)) > 3_000_000:
                yield take()
        yield take()

    return rows.select("ids").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def planes(x: np.ndarray) -> bytes:
    """Integers as bytes, all lowest ones first, which compress well."""
    return np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def summed(codes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with the sums of their counts."""
    every, counts = np.concatenate([*codes, np.empty(0, np.int64)]), np.concatenate([*n, np.empty(0, np.int64)])
    if not len(every):
        return every, counts
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.flatnonzero(np.diff(every, prepend=every[0] - 1))
    return every[starts], np.add.reduceat(counts[order], starts)


def in_blocks(rows: DataFrame, codes_of: Callable[[pa.RecordBatch], np.ndarray], width: int) -> DataFrame:
    """(block, codes, n): how often each code occurs that ``codes_of`` gives for the batches.

    Each task packs the codes of a block of words, a word's being ``width`` codes in succession.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def take() -> Iterator[pa.RecordBatch]:
            codes, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
            held.clear()
            block = codes // width % BLOCKS
            order = np.argsort(block, kind="stable")
            codes, n, edges = codes[order], n[order], np.searchsorted(block[order], np.arange(BLOCKS + 1))
            for start in range(0, BLOCKS, 16):
                parts = [(b, edges[b], edges[b + 1]) for b in range(start, start + 16) if edges[b] < edges[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in parts], pa.int32()),
                        pa.array([planes(np.diff(codes[i:j], prepend=0)) for _, i, j in parts], pa.binary()),
                        pa.array([planes(n[i:j]) for _, i, j in parts], pa.binary()),
                    ],
                    names=["block", "codes", "n"],
                )

        for batch in batches:
            held.append(codes_of(batch))
            if sum(map(len, held)) > CODES:
                yield from take()
        yield from take()

    return rows.mapInArrow(run, "block int, codes binary, n binary")


def summed_blocks(blocks: DataFrame, result: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``result`` makes of the codes of some whole blocks and their counts; a task holds each code once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = [], []
        for batch in batches:
            for packed, counts in zip(batch.column("codes").to_pylist(), batch.column("n").to_pylist()):
                codes.append(np.cumsum(from_planes(packed)))
                n.append(from_planes(counts))
                if sum(map(len, codes[1:])) > max(CODES, len(codes[0])):
                    codes, n = ([x] for x in summed(codes, n))
        yield result(*summed(codes, n))

    return blocks.repartition(BLOCKS, "block").select("codes", "n").mapInArrow(run, schema)


def beside(codes_of) -> Callable[[pa.RecordBatch], np.ndarray]:
    """The codes that ``codes_of`` gives for (previous ids, ids) of a batch of sequences."""

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        ids, _ = ids_of(batch)
        return codes_of(np.concatenate([ids[-1:], ids[:-1]]), ids)  # every text ends with the end token

    return codes


def code_counts(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, n_classes: int, sweeps: int = 50) -> np.ndarray:
    """Classes of words by exchange clustering on their bigram counts (words x words).

    Each word in turn leaves its class and joins the one where the likelihood of the class
    bigrams gains most, until a sweep moves nothing or ``sweeps`` are done.  Word 0 keeps class 0 to itself.
    """
    k = len(bigrams)
    b = bigrams.astype(np.float64)
    classes = np.zeros(k, np.int64)
    if k > 1 and n_classes > 1:
        classes[1:] = 1 + np.arange(k - 1) % (n_classes - 1)
    hot = np.eye(n_classes)[classes]
    after, before = b @ hot, b.T @ hot  # of each word: counts of the classes after and before it
    pairs = hot.T @ after
    of_word = b.sum(1) + b.sum(0)
    base = xlogx(pairs)
    for _ in range(sweeps if n_classes > 2 else 0):
        moved = 0
        for w in range(1, k):
            old, self_n = classes[w], b[w, w]
            r, l = after[w].copy(), before[w].copy()
            r[old] -= self_n
            l[old] -= self_n
            pairs[old] -= r
            pairs[:, old] -= l
            pairs[old, old] -= self_n
            base[old], base[:, old] = xlogx(pairs[old]), xlogx(pairs[:, old])
            here, of_here = np.diagonal(pairs), np.diagonal(base)
            some, others = np.flatnonzero(r), np.flatnonzero(l)  # only cells that change count
            gain = (xlogx(pairs[:, some] + r[some]) - base[:, some]).sum(1) - (xlogx(here + r) - of_here)
            gain += (xlogx(pairs[others] + l[others, None]) - base[others]).sum(0) - (xlogx(here + l) - of_here)
            gain += xlogx(here + r + l + self_n) - of_here
            left, right = pairs.sum(1), pairs.sum(0)
            gain -= xlogx(left + r.sum() + self_n) - xlogx(left) + xlogx(right + l.sum() + self_n) - xlogx(right)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            pairs[new] += r
            pairs[:, new] += l
            pairs[new, new] += self_n
            base[new], base[:, new] = xlogx(pairs[new]), xlogx(pairs[:, new])
            if new != old and of_word[w]:
                moved += 1
                classes[w] = new
                for of_class, counts in ((after, b[:, w]), (before, b[w])):
                    of_class[:, old] -= counts
                    of_class[:, new] += counts
        if not moved:
            break
    return classes


def best(owner: np.ndarray, codes: np.ndarray, n: np.ndarray, words: int, log_next: np.ndarray, class_n: np.ndarray) -> np.ndarray:
    """The class that gives each word's neighbours most likelihood.

    A neighbour's code is its class before the word, classes + its class after it, or 2 x classes
    if it has no class yet.
    """
    c = len(class_n)
    weights = np.concatenate([log_next, log_next.T, np.zeros((1, c))])
    out = np.empty(words, np.int32)
    order = np.argsort(owner, kind="stable")
    owner, codes, n = owner[order], codes[order], n[order]
    for start in range(0, words, 2000):
        end = min(start + 2000, words)
        i, j = np.searchsorted(owner, [start, end])
        seen = np.bincount((owner[i:j] - start) * (2 * c + 1) + codes[i:j], n[i:j], (end - start) * (2 * c + 1)).reshape(-1, 2 * c + 1)
        total = seen.sum(1, keepdims=True) / 2
        score = seen @ weights - total * np.log(class_n + total)
        score[:, [0, c - 1]] = -np.inf  # of the end token and of unseen words
        out[start:end] = score.argmax(1)
    return out


def best_class(blocks: DataFrame, log_next: np.ndarray, class_n: np.ndarray) -> DataFrame:
    """(word, class) of table words from the blocks of their contexts: code = word x (2 x classes + 1) + a neighbour's code.

    A word has at most two codes a class, so what a task holds is bounded.
    """
    width = 2 * len(class_n) + 1

    def choose(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        words, owner = np.unique(codes // width, return_inverse=True)
        chosen = best(owner, codes % width, n, len(words), log_next, class_n)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(chosen)], names=["word", "class"])

    return summed_blocks(blocks, choose, "word long, class int")


def rare_contexts(pairs: DataFrame, rare: DataFrame, c: int) -> DataFrame:
    """(word, codes): the classes of neighbours beyond the table, from pairs (rare_before, word) and classes (word, class)."""
    known = rare.select("word", "class")
    first = pairs.join(known.withColumnRenamed("word", "rare_before"), "rare_before").select("word", F.col("class").alias("code"))
    second = pairs.join(known, "word").select(F.col("rare_before").alias("word"), (F.col("class") + c).alias("code"))
    return first.unionByName(second).groupBy("word").agg(F.collect_list("code").alias("codes"))


def rare_best(
    rare: DataFrame, near: DataFrame | None, classes: np.ndarray, log_next: np.ndarray, class_n: np.ndarray, neighbours: bool = True
) -> DataFrame:
    """The words beyond the table (word, before, after) with the class of their neighbours' most likelihood and their count.

    The lists of neighbours go along only if another sweep needs them.
    """
    c, m, joined = len(class_n), len(classes) - 1, near is not None
    rare = rare.select("word", "before", "after")
    rows = rare.withColumn("codes", F.array().cast("array<int>")) if not joined else rare.join(near, "word", "left")
    shared = rare.sparkSession.sparkContext.broadcast((classes, log_next, class_n))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, log_next, class_n = shared.value
        for batch in batches:
            owners, codes = [], []
            for name in ("before", "after", "codes"):
                lists = batch.column(name)
                values, owner = lists.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy()
                if name != "codes":
                    # What lies beyond the table comes with ``codes``, if it has a class.
                    values = np.where(values == m, 2 * c, classes[values] + (c if name == "after" else 0))
                    if joined:
                        values, owner = values[values < 2 * c], owner[values < 2 * c]
                owners.append(owner)
                codes.append(values.astype(np.int64))
            code = np.concatenate(codes)
            chosen = best(np.concatenate(owners), code, np.ones(len(code)), batch.num_rows, log_next, class_n)
            counts = pc.list_value_length(batch.column("before")).cast(pa.int64())
            names = ["word", "before", "after"] if neighbours else ["word"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(chosen), counts], names=[*names, "class", "c"])

    kept = "word binary, before array<int>, after array<int>" if neighbours else "word binary"
    return rows.select("word", "before", "after", "codes").mapInArrow(choose, f"{kept}, class int, c long")


def beside_rare(rare: DataFrame, k: int, m: int, c: int) -> DataFrame:
    """Blocks of contexts of the table words from ``k`` on that neighbours beyond the table give."""

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        classes, out = batch.column("class").to_numpy(), []
        for name, shift in (("before", c), ("after", 0)):
            lists = batch.column(name)
            ids, own = lists.flatten().to_numpy(zero_copy_only=False), classes[pc.list_parent_indices(lists).to_numpy()]
            inside = (ids >= k) & (ids < m)
            out.append(ids[inside].astype(np.int64) * (2 * c + 1) + own[inside] + shift)
        return np.concatenate(out)

    return in_blocks(rare.select("before", "after", "class"), codes, 2 * c + 1)


def transitions(pairs: np.ndarray) -> np.ndarray:
    """log10 of the smoothed class-transition probabilities, from counts (before x after)."""
    n = len(pairs)
    own = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * n)
    total = pairs.sum(1, keepdims=True)
    kinds = (pairs > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (np.maximum(pairs - DISCOUNT, 0) + DISCOUNT * kinds * own) / total
    return np.log10(np.where(total > 0, p, own))


@dataclass
class BrownModel:
    words: list[bytes]  # the table, most frequent first but for the end token in front
    counts: np.ndarray
    classes: np.ndarray  # of the table's words; the last class is that of unseen words
    log_next: np.ndarray
    log_word: np.ndarray  # of the table's words in their classes
    train_tokens: int
    vocabulary_size: int
    in_class: np.ndarray  # training tokens of each class
    log_unseen: float
    placed: DataFrame  # tokens beyond the table by row


PLACED = "array<struct<pos:int,before:int,after:int,class:int,c:bigint>>"


def place(rows: DataFrame, rare: DataFrame, m: int, c: int) -> DataFrame:
    """(row, learn, rare): each row's tokens beyond the table with their classes and counts, joined with those of the words."""
    told = around(rows, m).drop("rare_before").join(rare.select("word", "class", "c"), "word", "left")
    item = F.struct("pos", "before", "after", F.coalesce("class", F.lit(c - 1)).alias("class"), F.coalesce("c", F.lit(0)).alias("c"))
    return told.groupBy("row", "learn").agg(F.collect_list(item).cast(PLACED).alias("rare"))


def unpacked(batch: pa.RecordBatch, classes: np.ndarray, once: np.ndarray):
    """Placed tokens in order: row, class before, class, class after (-1 if its token is in the list too), count, and whether the neighbours were seen once."""
    lists = batch.column("rare")
    items, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    order = np.lexsort((items.field("pos").to_numpy(), owner))
    before, after, own, n = (items.field(f).to_numpy()[order] for f in ("before", "after", "class", "c"))
    m = len(classes) - 1
    earlier = lambda x: np.concatenate([x[-1:], x[:-1]])
    first = np.where(before == m, earlier(own), classes[before])
    return owner[order], first, own, np.where(after == m, -1, classes[after]), n, np.where(before == m, earlier(n) == 1, once[before]), once[after]


def fit(
    rows: DataFrame, words: list[bytes], counts: np.ndarray, totals: tuple[int, int], n_classes: int = 96, clustered: int = 2048, sweeps: int = 2
) -> BrownModel:
    """Classes and probabilities from the stored sequences of the training texts."""
    m, c = len(words), n_classes + 1
    k = min(clustered, m)
    learn = rows.where("learn")

    def inner(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        both = (before < k) & (ids < k)
        return before[both].astype(np.int64) * k + ids[both]

    found = summed_blocks(in_blocks(learn.select("ids"), beside(inner), k), code_counts, "code long, n long").toArrow()  # at most k x k rows
    bigrams = np.zeros(k * k, np.int64)
    bigrams[found["code"].to_numpy()] = found["n"].to_numpy()
    top = exchange(bigrams.reshape(k, k), n_classes)
    classes = np.full(m + 1, c - 1, np.int64)
    classes[:k] = top
    hot = np.eye(c)[top]
    pairs = hot.T @ bigrams.reshape(k, k) @ hot
    tokens = around(learn, m)
    rare = tokens.groupBy("word").agg(F.collect_list("before").alias("before"), F.collect_list("after").alias("after"))
    both_rare = stored(tokens.where("rare_before IS NOT NULL").select("rare_before", "word"), "brown-rare-pairs", "zstd")
    for sweep in range(sweeps):
        known = classes.copy()
        if sweep:
            pairs = table_pairs(learn, known, counts, c)

        def contexts(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
            first = (before >= k) & (before < m) & (known[ids] < c - 1)
            second = (ids >= k) & (ids < m) & (known[before] < c - 1)
            return np.concatenate(
                [before[first].astype(np.int64) * (2 * c + 1) + c + known[ids[first]], ids[second].astype(np.int64) * (2 * c + 1) + known[before[second]]]
            )

        natural, class_n = transitions(pairs) * np.log(10), pairs.sum(1) + 1
        if m > k:
            seen = in_blocks(learn.select("ids"), beside(contexts), 2 * c + 1)
            seen = seen.unionByName(beside_rare(rare, k, m, c)) if sweep else seen
            chosen = best_class(seen, natural, class_n).toArrow()
            classes[chosen["word"].to_numpy()] = chosen["class"].to_numpy()
            if not sweep:
                alone = np.flatnonzero(classes[:m] == c - 1)  # no neighbour has a class yet
                classes[alone] = min(1, n_classes - 1)
        near = rare_contexts(both_rare, rare, c) if sweep else None
        rare = stored(rare_best(rare, near, classes, natural, class_n, sweep < sweeps - 1), "brown-classes", "zstd")
    placed = stored(place(rows, rare, m, c), "brown-placed", "zstd")
    pairs = table_pairs(learn, classes, counts, c) + rare_pairs(placed.where("learn"), classes, counts, c)
    in_class = np.bincount(classes[:m], weights=counts, minlength=c)
    for row in rare.groupBy("class").agg(F.sum("c").alias("c")).collect():
        in_class[row["class"]] += row["c"]
    once = int((counts == 1).sum()) + rare.where("c = 1").count()
    with np.errstate(divide="ignore"):
        log_word = np.where(counts > 0, np.log10(counts / np.maximum(in_class[classes[:m]], 1)), 0.0)
    n, v = totals
    return BrownModel(words, counts, classes, transitions(pairs), log_word, n, v, in_class, -float(np.log10(once + 1)), placed)


def with_once(first: np.ndarray, second: np.ndarray, first_once: np.ndarray, second_once: np.ndarray, c: int) -> np.ndarray:
    """Codes of class pairs; words seen once stand in for the unseen ones, as their class was chosen by these very pairs."""
    return np.where(first_once, c - 1, first).astype(np.int64) * c + np.where(second_once, c - 1, second)


def matrix(found: pa.Table, c: int) -> np.ndarray:
    pairs = np.zeros(c * c)
    pairs[found["code"].to_numpy()] = found["n"].to_numpy()
    return pairs.reshape(c, c)


def table_pairs(learn: DataFrame, classes: np.ndarray, counts: np.ndarray, c: int) -> np.ndarray:
    """Counts of class pairs (before x after) of neighbours that are both in the table."""
    m, once = len(classes) - 1, np.append(counts == 1, False)

    def codes(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        both = (before < m) & (ids < m)
        before, ids = before[both], ids[both]
        return with_once(classes[before], classes[ids], once[before], once[ids], c)

    return matrix(counted(learn, codes).toArrow(), c)  # at most classes x classes rows


def rare_pairs(placed: DataFrame, classes: np.ndarray, counts: np.ndarray, c: int) -> np.ndarray:
    """Counts of the other class pairs."""
    once_in_table = np.append(counts == 1, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(c * c, np.int64)
        for batch in batches:
            _, first, own, after, n, once_before, once_after = unpacked(batch, classes, once_in_table)
            if len(own):
                once, last = n == 1, after >= 0
                codes = np.concatenate([with_once(first, own, once_before, once, c), with_once(own[last], after[last], once[last], once_after[last], c)])
                total += np.bincount(codes, minlength=c * c)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["code", "n"])

    return matrix(placed.select("rare").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow(), c)


def score(rows: DataFrame, model: BrownModel) -> DataFrame:
    """Token counts and log10 probabilities of every sequence."""
    m, c = len(model.words), len(model.in_class)
    n, v = model.train_tokens, model.vocabulary_size
    shared = rows.sparkSession.sparkContext.broadcast((model.counts, model.classes, model.log_next, model.log_word, model.in_class, model.log_unseen))
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of_word, log_next, log_word, _, _ = shared.value
        base = np.append(np.log10((counts + 0.5) / (n + 0.5 * (v + 1))), 0.0)
        word, seen = np.append(log_word, 0.0), np.append(counts > 0, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = ids_of(batch)
            starts = np.concatenate([[0], ends[:-1]])
            classes = of_word[ids]
            before = np.concatenate([ids[-1:], ids[:-1]])  # the end token before each text
            inside = np.where((ids < m) & (before < m), log_next[of_word[before], classes], 0.0)
            total = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("learn"), pa.array(ends - starts, pa.int64()),
                    pa.array(total(seen[ids].astype(np.int64))), pa.array(total(base[ids])), pa.array(total(inside + word[ids])),
                ],
                schema=schema,
            )

    def run_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, of_word, log_next, _, in_class, log_unseen = shared.value
        for batch in batches:
            owner, first, own, after, count, _, _ = unpacked(batch, of_word, of_word < 0)
            value = log_next[first, own] + np.where(after >= 0, log_next[own, np.maximum(after, 0)], 0.0)
            value += np.where(count > 0, np.log10(np.maximum(count, 1) / np.maximum(in_class[own], 1)), log_unseen)
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
            sums = [np.bincount(owner, x, batch.num_rows) for x in (count > 0, base, value)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["row", "rare_known", "rare_base", "rare_score"]
            )

    told = rows.select("row", "doc_id", "learn", "ids").mapInArrow(
        run, "row long, doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double"
    )
    looked_up = model.placed.select("row", "rare").mapInArrow(run_rare, "row long, rare_known long, rare_base double, rare_score double")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return told.join(looked_up, "row", "left").select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        add("n_known", "rare_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        add("base_score", "rare_base"),
        add("score", "rare_score"),
    )


def score_texts(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", table_words: int = 600_000, n_classes: int = 96, clustered: int = 2048
) -> DataFrame:
    """Score every whole text by a class-based bigram model learned from the rows where ``learn`` holds.

    One row per input row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-half unigram) and ``score``, both log10 probabilities.  A null or empty
    text is the end token alone.  Repeated rows are scored, and learned from, as often as they
    occur; a null ``learn`` is held out; other columns are ignored; an empty table gives no rows.
    ``table_words`` bounds the words that every task holds (the others are joined) and
    ``clustered`` those that the driver's exchange moves before the sweeps of all words.
    """
    texts = bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), text_bytes(text_col).alias("text")
    )
    vocabulary = stored(word_counts(texts.where("learn")), "brown-words", "zstd")
    end_count = F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))
    n, v, ends = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), end_count).first()
    top = [(END, ends), *frequent_words(vocabulary, table_words)]
    words, counts = [w for w, _ in top], np.array([c for _, c in top], dtype=np.int64)
    rows = stored(sequences(texts, words), "brown-sequences", "zstd")
    return score(rows, fit(rows, words, counts, (n, v), n_classes, clustered))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), id_bucket("doc_id", 5) != 1)
