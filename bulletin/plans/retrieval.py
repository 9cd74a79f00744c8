"""Queries of hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as ops
from ..operators.catalogue import placed
from ..sources.tables import NOTICES_SQL, day_text, notices, table
from .registry import query

# Queries of the searches: every vector whose id is divisible by 20, against all vectors.
ASKED = "vec_id % 20 = 0"
TERMS = ["the", "water", "maison"]
DOT_SQL = "round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
DENSE_SQL = f"""
dense AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, {DOT_SQL} AS score FROM embeddings q, embeddings v WHERE q.{ASKED}),
dense_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM dense)
"""
BM25_SQL = """
tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+') AS t FROM documents),
tf AS (SELECT id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'water')) AS b,
         len(list_filter(t, lambda x: x = 'maison')) AS c FROM tok),
st AS (SELECT count(*) AS d, avg(n) AS m, count_if(a > 0) AS da, count_if(b > 0) AS db, count_if(c > 0) AS dc FROM tf),
bm AS (SELECT id, round(ln(1 + (d - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m))
        + ln(1 + (d - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m))
        + ln(1 + (d - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score FROM tf, st)
"""


def vectors(spark, path):
    return table(spark, path, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(spark, path):
    rows = table(spark, path, "embeddings").where(ASKED)
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("dense_topk", f"WITH {DENSE_SQL} SELECT query_id, id, score, rank FROM dense_ranked WHERE rank < 10")
def dense_topk(spark, path):
    return ops.dense_topk(asked(spark, path), vectors(spark, path), 10)


@query(
    "dense_topk_filtered",
    f"""WITH {DENSE_SQL} SELECT query_id, id, score FROM dense WHERE label % 2 = 0
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
)
def dense_topk_filtered(spark, path):
    rows = ops.dense_topk(asked(spark, path), vectors(spark, path).where("label % 2 = 0"), 10)
    return rows.select("query_id", "id", "score")


@query(
    "score_floor_margin",
    f"""WITH {DENSE_SQL}, w AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM dense_ranked WHERE rank < 40 AND id <> query_id)
    SELECT query_id, id, score, round(greatest(0.1, best - 0.06), 6) AS least FROM w WHERE score >= round(greatest(0.1, best - 0.06), 6)""",
)
def score_floor_margin(spark, path):
    rows = ops.dense_topk(asked(spark, path), vectors(spark, path), 40).where("id <> query_id")
    return ops.near_best(rows, "query_id", floor=0.1).select("query_id", "id", "score", "least")


@query(
    "prototype_intent",
    f"""WITH p AS (SELECT vec_id % 3 AS class, embedding FROM embeddings WHERE vec_id < 12),
    s AS (SELECT v.vec_id AS id, q.class, max({DOT_SQL}) AS score FROM embeddings v, p q GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class DESC) AS k, lead(score) OVER (PARTITION BY id ORDER BY score DESC, class DESC) AS second FROM s)
    SELECT id, CASE WHEN round(score - second, 6) >= 0.04 THEN class::VARCHAR ELSE '(unsure)' END AS class, score FROM r WHERE k = 1""",
)
def prototype_intent(spark, path):
    rows = table(spark, path, "embeddings")
    prototypes = rows.where("vec_id < 12").select((F.col("vec_id") % 3).cast("string").alias("class"), F.col("embedding").alias("query"))
    return ops.prototype_scores(vectors(spark, path), prototypes)


@query("bm25_topk", f"WITH {BM25_SQL} SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def bm25_topk(spark, path):
    docs = table(spark, path, "documents").select(F.col("doc_id").alias("id"), "text")
    return ops.bm25(docs, TERMS).orderBy(F.desc("score"), "id").limit(20)


@query(
    "hybrid_rrf",
    f"""WITH {DENSE_SQL}, {BM25_SQL},
    k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20),
    s AS (SELECT id, rank FROM dense_ranked WHERE query_id = 40 AND rank < 20),
    u AS (SELECT *, 0 AS leg FROM k UNION ALL SELECT *, 1 FROM s)
    SELECT id, round(sum(1 / (60 + rank + 1)), 9) AS fused, count(*) AS legs FROM u GROUP BY id ORDER BY fused DESC, min(leg), id LIMIT 10""",
)
def hybrid_rrf(spark, path):
    docs = table(spark, path, "documents").select(F.col("doc_id").alias("id"), "text")
    keyword = ops.ranked(ops.bm25(docs, TERMS).withColumn("q", F.lit(0)), "q", "score", "id", 20)
    dense = ops.dense_topk(asked(spark, path).where("query_id = 40"), vectors(spark, path), 20)
    return ops.fused([keyword, dense]).orderBy(F.desc("fused"), "first.leg", "id").limit(10).select("id", "fused", "legs")


# A question in three asks all categories; of four, one has no window, one a first day, one both, and one a window that nothing is in.
QUESTIONS_SQL = f"""
{NOTICES_SQL},
points AS (SELECT n.id, n.category, n.content, strftime(n.published_at, '%Y-%m-%d') AS day, e.embedding FROM notices n JOIN embeddings e ON e.vec_id = n.id),
words AS (SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS t FROM points),
questions AS (
  SELECT p.id AS query_id, p.embedding, CASE WHEN (p.id // 20) % 3 > 0 THEN p.category END AS category,
         CASE (p.id // 20) % 4 WHEN 1 THEN '2024-06-01' WHEN 2 THEN '2024-03-01' WHEN 3 THEN '2030-01-01' END AS first_day,
         CASE WHEN (p.id // 20) % 4 = 2 THEN '2024-04-15' END AS last_day,
         CASE WHEN (p.id // 20) % 5 = 4 THEN [] ELSE list_sort(list_distinct(list_filter(t, lambda x: length(x) >= 5)))[1:2] END AS terms
  FROM points p JOIN words w ON w.id = p.id WHERE p.id % 20 = 0)
"""


def points(spark, path):
    found = table(spark, path, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = notices(spark, path).select("id", "category", F.col("content").alias("text"), day_text("published_at").alias("day"))
    return rows.join(found, "id")


def questions(spark, path):
    turn = F.floor(F.col("id") / 20)
    words = F.filter(ops.terms("text"), lambda x: F.length(x) >= 5)
    return points(spark, path).where("id % 20 = 0").select(
        F.col("id").alias("query_id"), F.col("vector").alias("query"), F.when(turn % 3 > 0, F.col("category")).alias("category"),
        F.when(turn % 4 == 1, "2024-06-01").when(turn % 4 == 2, "2024-03-01").when(turn % 4 == 3, "2030-01-01").alias("first_day"),
        F.when(turn % 4 == 2, "2024-04-15").alias("last_day"),
        F.when(turn % 5 != 4, F.slice(F.array_sort(F.array_distinct(words)), 1, 2)).alias("terms"),
    )


@query(
    "notice_leg_windowed",
    f"""WITH {QUESTIONS_SQL},
    s AS (SELECT q.query_id, first_day, last_day, first_day IS NOT NULL OR last_day IS NOT NULL AS windowed, v.id, v.day, {DOT_SQL} AS score
          FROM questions q JOIN points v ON q.category IS NULL OR q.category = v.category),
    r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= CASE WHEN windowed THEN 48 ELSE 18 END),
    w AS (SELECT *, CASE WHEN windowed THEN day IS NOT NULL AND (first_day IS NULL OR day >= first_day) AND (last_day IS NULL OR day <= last_day) END AS in_window FROM r),
    f AS (SELECT *, bool_or(in_window) OVER (PARTITION BY query_id) AS found FROM w),
    g AS (SELECT *, round(greatest(0.1, max(score) OVER (PARTITION BY query_id) - 0.06), 6) AS least FROM (SELECT * FROM f WHERE NOT windowed OR in_window OR NOT found))
    SELECT query_id, id, score, in_window, least FROM g WHERE score >= least""",
)
def notice_leg_windowed(spark, path):
    return ops.notice_leg(questions(spark, path), points(spark, path), 6, floor=0.1)


@query(
    "hybrid_filtered",
    f"""WITH {QUESTIONS_SQL},
    st AS (SELECT count(*) AS d, avg(len(t)) AS m FROM words),
    tf AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM words) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    kw AS (SELECT q.query_id, tf.id, round(sum(ln(1 + (d - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))), 6) AS score
           FROM (SELECT query_id, category, unnest(terms) AS term FROM questions) q JOIN tf USING (term) JOIN df USING (term)
           JOIN points p ON p.id = tf.id AND (q.category IS NULL OR q.category = p.category), st GROUP BY 1, 2),
    dn AS (SELECT q.query_id, v.id, {DOT_SQL} AS score FROM questions q JOIN points v ON q.category IS NULL OR q.category = v.category),
    legs AS (
      SELECT *, 0 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM dn QUALIFY n <= 12
      UNION ALL
      SELECT *, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM kw QUALIFY n <= 12),
    u AS (SELECT query_id, id, round(sum(1 / (60 + n)), 9) AS fused, min(leg) AS first_leg FROM legs GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first_leg, id) <= 6)
    SELECT u.query_id, u.id, CASE WHEN len(q.terms) > 0 THEN 'hybrid-rrf' ELSE 'dense' END AS mode, CASE WHEN len(q.terms) > 0 THEN fused END AS fused, score,
           row_number() OVER (PARTITION BY u.query_id ORDER BY score DESC, u.id) - 1 AS place
    FROM u JOIN questions q USING (query_id) JOIN dn ON dn.query_id = u.query_id AND dn.id = u.id""",
)
def hybrid_filtered(spark, path):
    return ops.hybrid(questions(spark, path), points(spark, path), 6)


HITS_SQL = """
hits AS (SELECT doc_id // 4 AS doc, doc_id % 4 AS index, (doc_id // 8) % 2 AS section, text AS content,
           round(0.6 + (doc_id * 37 % 400) / 1000.0, 3)::DOUBLE AS score FROM documents)
"""


def hits(spark, path):
    i = F.col("doc_id")
    return table(spark, path, "documents").select(
        F.floor(i / 4).alias("doc"), (i % 4).alias("index"), (F.floor(i / 8) % 2).alias("section"), F.col("text").alias("content"),
        F.round(0.6 + (i * 37 % 400) / 1000.0, 3).alias("score"),
    )


@query(
    "select_context",
    f"""WITH {HITS_SQL}, a AS (SELECT * FROM hits WHERE score >= 0.78 QUALIFY row_number() OVER (PARTITION BY doc, index ORDER BY score DESC) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY md5(lower(trim(regexp_replace(content, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')))) ORDER BY score DESC, doc, index) = 1)
    SELECT doc, index, score, content FROM b ORDER BY score DESC, doc, index LIMIT 50""",
)
def select_context(spark, path):
    return ops.selected(hits(spark, path), 50).select("doc", "index", "score", "content")


@query(
    "merge_adjacent",
    f"""WITH {HITS_SQL}, s AS (SELECT * FROM hits WHERE score >= 0.7),
    g AS (SELECT *, index - row_number() OVER (PARTITION BY doc, section ORDER BY index) AS island FROM s)
    SELECT doc, section, min(index) AS first, max(index) AS last, max(score) AS score, string_agg(content, chr(10) ORDER BY index) AS content
    FROM g GROUP BY doc, section, island""",
)
def merge_adjacent(spark, path):
    return ops.merged(hits(spark, path).where("score >= 0.7"))


@query(
    "merged_page_ranges",
    f"""WITH {HITS_SQL}, s AS (SELECT *, CASE WHEN (doc * 4 + index) % 5 > 0 THEN index + 1 END AS page FROM hits WHERE score >= 0.65),
    g AS (SELECT *, index - row_number() OVER (PARTITION BY doc, section ORDER BY index) AS island FROM s)
    SELECT doc, section, min(index) AS first, max(index) AS last, arg_min(page, index) FILTER (page IS NOT NULL) AS first_page, arg_max(page, index) FILTER (page IS NOT NULL) AS last_page
    FROM g GROUP BY doc, section, island""",
)
def merged_page_ranges(spark, path):
    page = F.when((F.col("doc") * 4 + F.col("index")) % 5 > 0, F.col("index") + 1)
    rows = ops.merged(hits(spark, path).where("score >= 0.65").withColumn("page", page))
    return rows.select("doc", "section", "first", "last", "first_page", "last_page")


@query(
    "age_markers",
    f"""WITH {NOTICES_SQL}, d AS (SELECT id, published_at::DATE AS day FROM notices)
    SELECT id, date_diff('day', day, (SELECT max(day) FROM d)) AS age_days, coalesce(date_diff('day', day, (SELECT max(day) FROM d)) > 365, false) AS old FROM d""",
)
def age_markers(spark, path):
    rows = notices(spark, path).select("id", F.to_date("published_at").alias("day"))
    return ops.ages(rows, "day").select("id", "age_days", "old")


@query(
    "scoped_semi_join",
    """SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def scoped_semi_join(spark, path):
    docs = table(spark, path, "documents").select(F.col("doc_id").alias("id"), "source")
    return ops.scoped(docs, table(spark, path, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), "id")


@query(
    "context_budget",
    f"""WITH {NOTICES_SQL}, t AS (SELECT id, title AS summary, content FROM notices WHERE category = 'TENDER' ORDER BY effective_at DESC, id LIMIT 12)
    SELECT id, 1166::BIGINT AS share, CASE WHEN 1166 - length(summary) >= 350 THEN substring(content, 1, 1166 - length(summary)) END AS excerpt FROM t""",
)
def context_budget(spark, path):
    top = notices(spark, path).where("category = 'TENDER'").orderBy(F.desc("effective_at"), "id").limit(12)
    return ops.context_budget(top.select("id", F.col("title").alias("summary"), "content")).select("id", F.col("share").cast("long").alias("share"), "excerpt")


@query(
    "recency_reordered",
    f"""WITH {NOTICES_SQL} SELECT id, strftime(published_at, '%Y-%m-%d') AS day,
    row_number() OVER (ORDER BY published_at IS NULL, published_at DESC, id) AS place FROM notices""",
)
def recency_reordered(spark, path):
    rows = notices(spark, path).select("id", "published_at")
    return placed(rows, F.col("published_at").desc_nulls_last(), F.col("id")).select("id", day_text("published_at").alias("day"), "place")
