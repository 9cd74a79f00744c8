"""Dense and keyword retrieval, rank fusion, selection and merging of context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches

#: Constants of rank fusion and of BM25.
FUSION_K, K1, B = 60, 1.2, 0.75
# The least score, and how far under the best score a result may lie.
FLOOR, MARGIN = 0.78, 0.06


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def ranked(rows: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The best ``k`` rows of each ``by`` with their 0-based ``rank``.

    Spark keeps ``k`` rows a task and group before the exchange, so a group of any size is fine.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie)))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long") - 1)


def vector_blocks(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows (``key`` long, ``vector``) gathered in the tasks into rows of at most ``size`` ids with their vectors end to end.

    Rows without a vector are left out; all vectors have one length.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                columns = [part.column(0), part.column(1).flatten()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(c)], c) for c in columns], names=["ids", "flat"])

    whole = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return whole.mapInArrow(gather, "ids array<long>, flat array<float>")


def nearest(k: int, floor: float | None, most: int = 500_000):
    """A task function on pairs of blocks: one matrix product a pair; a task gives ``k`` rows a query for about ``most`` rows it found."""

    def best_of(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        q, i, score = map(np.concatenate, zip(*held))
        order = np.lexsort((i, -score, q))
        q, i, score = q[order], i[order], score[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        return [q[keep], i[keep], score[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for asked, asked_flat, ids, flat in zip(*(batch.column(c) for c in ("query_ids", "query_flat", "ids", "flat"))):
                q, i = (np.asarray(x.values, np.int64) for x in (asked, ids))
                i, order = np.sort(i), np.argsort(i, kind="stable")
                a, b = (np.asarray(x.values, np.float64).reshape(n, -1) for x, n in ((asked_flat, len(q)), (flat, len(i))))
                scores = np.round(a @ b[order].T, 6)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(scores, best, 1).ravel()
                columns = [np.repeat(q, best.shape[1]), i[best.ravel()], found]
                held.append(columns if floor is None else [c[found >= floor] for c in columns])
                size += len(held[-1][0])
                if size >= most:
                    held = [best_of(held)]
                    size = len(held[0][0])
                    if size >= most // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["query_id", "id", "score"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best_of(held)], names=["query_id", "id", "score"])

    return run


NEAREST = "query_id long, id long, score double"


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None, block: int = 1024) -> DataFrame:
    """For each query (``query_id``, ``query``) the nearest of (``id``, ``vector``) by cosine of unit vectors: query_id, id, score, rank.

    Both sides are cut into blocks of bounded size, and each pair of blocks is one matrix product in
    double precision that leaves ``k`` rows a query; Spark deals the pairs of blocks out, so neither
    side goes to every task beyond the size that Spark itself checks.  Ties go to the smaller id.
    """
    asked = vector_blocks(queries, "query_id", "query", block // 4).toDF("query_ids", "query_flat")
    pairs = vector_blocks(vectors, "id", "vector", block).crossJoin(asked)
    return ranked(bounded_batches(pairs).mapInArrow(nearest(k, floor), NEAREST), "query_id", "score", "id", k)


def category_blocks(rows: DataFrame, key: str, vector: str, size: int, asked: bool) -> DataFrame:
    """:func:`vector_blocks` of one ``category`` each: (any, category, ids, flat).

    Blocks of ``any`` serve questions of no category: of the questions those without one, of what is searched all rows.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(2)
            parts = [(None, batch.filter(kinds.is_null()) if asked else batch)]
            parts += [(kind, batch.filter(pc.equal(kinds, kind))) for kind in kinds.unique() if kind.is_valid]
            for kind, part in parts:
                for start in range(0, part.num_rows, size):
                    piece = part.slice(start, size)
                    lists = [pa.ListArray.from_arrays([0, len(c)], c) for c in (piece.column(0), piece.column(1).flatten())]
                    yield pa.RecordBatch.from_arrays([pa.array([kind is None]), pa.array([kind and kind.as_py()], pa.string()), *lists], names=["any", "category", "ids", "flat"])

    whole = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), "category").where("id IS NOT NULL AND v IS NOT NULL")
    return whole.mapInArrow(gather, "any boolean, category string, ids array<long>, flat array<float>")


def category_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024, salts: int = 16) -> DataFrame:
    """:func:`dense_topk` where each query sees the rows of its own ``category`` only, or all rows if that is null.

    Blocks meet by an equality of the category.  The blocks of a frequent category are dealt to
    ``salts`` groups, and the question blocks go to each of them.  A null category of a row is
    found by questions of no category only.
    """
    asked = category_blocks(queries, "query_id", "query", block // 4, True).toDF("any", "category", "query_ids", "query_flat")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    searched = category_blocks(vectors, "id", "vector", block, False).withColumn("salt", F.pmod(F.hash("ids"), F.lit(salts)))
    same = (asked["any"] == searched["any"]) & asked["category"].eqNullSafe(searched["category"]) & (asked["salt"] == searched["salt"])
    pairs = searched.join(asked, same).select("query_ids", "query_flat", "ids", "flat")
    return ranked(bounded_batches(pairs).mapInArrow(nearest(k, None), NEAREST), "query_id", "score", "id", k)


def notice_leg(questions: DataFrame, notices: DataFrame, k: int, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """The vector leg of announcements: query_id, id, score, in_window, least.

    ``questions`` have ``query_id``, ``query``, ``category`` and the days ``first_day`` and
    ``last_day`` (all three may be null), ``notices`` ``id``, ``vector``, ``category`` and ``day``.  A
    question takes its max(3k, 15) nearest rows, with a window max(8k, 40).  Of these a window
    keeps the rows inside it, unless it would keep none: then all stay, with ``in_window`` false.
    Last come the floor and the margin under the best that is left.  Undated rows are in no window;
    without a window ``in_window`` is null.
    """
    days = questions.select("query_id", "first_day", "last_day").withColumn("windowed", F.expr("first_day IS NOT NULL OR last_day IS NOT NULL"))
    wide, narrow = max(8 * k, 40), max(3 * k, 15)
    rows = category_topk(questions, notices, wide).join(days, "query_id").where(F.col("windowed") | (F.col("rank") < narrow))
    rows = rows.join(notices.select("id", "day"), "id")
    inside = F.coalesce((F.col("day") >= F.coalesce("first_day", "day")) & (F.col("day") <= F.coalesce("last_day", "day")), F.lit(False))
    rows = rows.withColumn("in_window", F.when(F.col("windowed"), inside))
    rows = rows.withColumn("found", F.max("in_window").over(Window.partitionBy("query_id"))).where(F.expr("NOT windowed OR in_window OR NOT found"))
    return near_best(rows, "query_id", floor, margin).select("query_id", "id", "score", "in_window", "least")


def prototype_scores(rows: DataFrame, prototypes: DataFrame, margin: float = 0.04) -> DataFrame:
    """Each row's best prototype class, if it leads the next by the margin; else (unsure).

    ``prototypes`` (``class``, ``query``) are a stated set of few rows.
    """
    scored = rows.join(F.broadcast(prototypes)).select("id", "class", F.round(dot("query", "vector"), 6).alias("score"))
    best = scored.groupBy("id", "class").agg(F.max("score").alias("score")).groupBy("id")
    tops = best.agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "class")), False), 1, 2).alias("t"))
    first, second = F.col("t")[0], F.get("t", F.lit(1))
    sure = second.isNull() | (F.round(first["score"] - second["score"], 6) >= margin)
    return tops.select("id", F.when(sure, first["class"]).otherwise("(unsure)").alias("class"), first["score"].alias("score"))


def terms(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and combining marks."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def bm25(docs: DataFrame, question: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(``id``, ``score``) of the documents (``id``, ``text``) that hold a term of the question.

    Only the question's terms are counted, so one scan gives a few numbers a document; document
    frequencies and the mean length are aggregates over all of them.
    """
    question = sorted({t.lower() for t in question})
    tokens = docs.select("id", terms("text").alias("t"))

    def times(term: str) -> Column:
        return F.size(F.filter("t", lambda x: x == term))

    tf = [times(q).alias(f"tf{i}") for i, q in enumerate(question)]
    rows = tokens.select("id", F.size("t").alias("n"), *tf)
    stats = rows.agg(
        F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(question)))
    )
    score = F.lit(0.0)
    for i in range(len(question)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return rows.join(F.broadcast(stats)).select("id", F.round(score, 6).alias("score")).where("score > 0")


def bm25_scores(questions: DataFrame, docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 of many questions (``query_id``, ``category``, array ``terms``) on (``id``, ``category``, ``text``): query_id, id, score.

    Only rows of a question's category are scored (all if it is null); frequencies and the mean
    length are those of all rows, a null text being empty.  Terms count once and meet the words of texts by an equality, after words were counted a text.
    """
    asked = questions.select("query_id", F.col("category").alias("only"), F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    lengths = docs.select("id", "category", terms(F.coalesce("text", F.lit(""))).alias("t")).withColumn("n", F.size("t"))
    counts = lengths.select("id", "category", "n", F.explode("t").alias("term")).groupBy("id", "category", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = counts.join(asked.select("term").distinct(), "term")
    stats = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    rows = counts.join(df, "term").join(F.broadcast(stats)).select("id", "category", "term", weight.alias("weight")).join(asked, "term")
    return rows.where("only IS NULL OR category = only").groupBy("query_id", "id").agg(F.round(F.sum("weight"), 6).alias("score"))


def hybrid(questions: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Both legs of each question, fused and scored again: query_id, id, mode, fused, score, place.

    ``questions``: ``query_id``, ``query``, ``category`` (null: any), ``terms``; ``points``: ``id``, ``vector``,
    ``category``, ``text``.  The category filters both legs.  Of a question with terms each leg gives 2k rows, and the best
    k by rank fusion stay (``hybrid-rrf``; ties: vector leg first, then the smaller id); without terms the vector leg alone
    gives k (``dense``, ``fused`` null).  Both are placed by cosine, from 0.
    """
    modes = questions.select("query_id", "query", F.when(F.size(F.coalesce("terms", F.array())) > 0, "hybrid-rrf").otherwise("dense").alias("mode"))
    dense = category_topk(questions, points, 2 * k).select("query_id", "id", "rank", F.lit(0).alias("leg"))
    keyword = ranked(bm25_scores(questions, points), "query_id", "score", "id", 2 * k).select("query_id", "id", "rank", F.lit(1).alias("leg"))
    both = dense.unionByName(keyword).groupBy("query_id", "id").agg(
        F.round(F.sum(1 / (FUSION_K + F.col("rank") + 1)), 9).alias("fused"), F.min("leg").alias("leg")
    )
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "leg", "id"))
    rows = both.withColumn("n", best).where(F.col("n") <= k).join(modes, "query_id").join(points.select("id", "vector"), "id")
    rows = rows.withColumn("score", F.round(dot("query", "vector"), 6)).withColumn("fused", F.when(F.col("mode") == "hybrid-rrf", F.col("fused")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.select("query_id", "id", "mode", "fused", "score", (place - 1).cast("long").alias("place"))


def fused(legs: list[DataFrame], k: int = FUSION_K) -> DataFrame:
    """Reciprocal-rank fusion of legs (``id``, ``rank``): sum of 1 / (k + rank + 1); ties to the leg seen first."""
    rows = None
    for i, leg in enumerate(legs):
        part = leg.select("id", "rank", F.lit(i).alias("leg"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(
        F.round(F.sum(1 / (k + F.col("rank") + 1)), 9).alias("fused"), F.min(F.struct("leg", "rank")).alias("first"), F.count(F.lit(1)).alias("legs")
    )


def selected(hits: DataFrame, k: int, floor: float = FLOOR) -> DataFrame:
    """Hits over the floor, one for each (doc, index), then one for each content (whole, without case, white space squeezed), then the best k."""
    def first(by: list[Column], rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "doc", "index")
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    rows = first([F.col("doc"), F.col("index")], hits.where(F.col("score") >= floor))
    rows = first([F.md5(F.lower(F.trim(F.regexp_replace("content", r"(?U)[\s\x1c-\x1f]+", " "))))], rows)
    return rows.orderBy(F.desc("score"), "doc", "index").limit(k)


def merged(chunks: DataFrame) -> DataFrame:
    """Runs of adjacent chunks of one document and section joined: gaps and islands over the index.

    With a column ``page`` a run gets ``first_page`` and ``last_page``: those of its first and last chunk that state a page.
    """
    w = Window.partitionBy("doc", "section").orderBy("index")
    gap = F.coalesce((F.col("index") - F.lag("index").over(w) > 1).cast("int"), F.lit(0))
    parts = F.array_sort(F.collect_list(F.struct("index", "content")))
    stated = F.when(F.col("page").isNotNull(), F.col("index")) if "page" in chunks.columns else None
    pages = [] if stated is None else [F.min_by("page", stated).alias("first_page"), F.max_by("page", stated).alias("last_page")]
    return (
        chunks.withColumn("gap", gap).withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
        .groupBy("doc", "section", "island")
        .agg(
            F.min("index").alias("first"), F.max("index").alias("last"), F.max("score").alias("score"),
            F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"), *pages,
        )
        .drop("island")
    )


def near_best(rows: DataFrame, by: str, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """Rows whose score is at least the floor and within the margin of the group's best."""
    best = F.max("score").over(Window.partitionBy(by))
    return rows.withColumn("least", F.round(F.greatest(F.lit(floor), best - margin), 6)).where(F.col("score") >= F.col("least"))


def scoped(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows of the allowed keys; no allowed key, no rows."""
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def ages(rows: DataFrame, day: str) -> DataFrame:
    """Days behind the newest row, and whether that makes a row old (over a year)."""
    newest = rows.agg(F.max(day).alias("newest"))
    age = F.date_diff("newest", day).cast("long")
    return rows.join(F.broadcast(newest)).withColumn("age_days", age).withColumn("old", F.coalesce(F.col("age_days") > 365, F.lit(False)))


def context_budget(rows: DataFrame, total: int = 14000, least: int = 700) -> DataFrame:
    """Summary first, then as much of the content as an equal share of the budget leaves (350 at least)."""
    n = rows.agg(F.count(F.lit(1)).alias("__rows"))
    share = F.greatest(F.floor(F.lit(total) / F.col("__rows")), F.lit(least)).cast("int")
    room = F.col("share") - F.length(F.coalesce("summary", F.lit("")))
    return rows.join(F.broadcast(n)).withColumn("share", share).drop("__rows").withColumn(
        "excerpt", F.when(room >= 350, F.substring("content", F.lit(1), room))
    )
