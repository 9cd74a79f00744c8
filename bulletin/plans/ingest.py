"""Queries of incremental ingest, with documents as crawled items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import content_hash, salted, uuid5
from ..functions.text import quality, stripped
from ..operators import ingest as ops
from ..sources import scans
from ..sources.folders import shared_folder
from ..sources.tables import NOTICES_SQL, notices, table
from .registry import query
from .reports import QUALITY_SQL

ITEMS_SQL = f"""
{NOTICES_SQL},
items AS (
  SELECT id AS position, 'https://portal.example/' || source_label || '/' || (id // 2) AS url, CASE WHEN id % 7 <> 0 THEN title END AS title,
         CASE WHEN id % 11 <> 0 THEN content END AS content, category, published_at, CASE WHEN id % 2 = 0 THEN title END AS summary,
         CASE WHEN id % 13 = 0 THEN ['a.pdf'] ELSE []::VARCHAR[] END AS attachments FROM notices WHERE id % 3 <> 0),
known AS (
  SELECT 'https://portal.example/' || source_label || '/' || (id // 2) AS url, title, CASE WHEN id % 5 = 0 THEN 'New. ' || content ELSE content END AS content,
         category, published_at, title AS summary, []::VARCHAR[] AS attachments,
         sha256(title || '|' || CASE WHEN id % 5 = 0 THEN 'New. ' || content ELSE content END) AS content_hash
  FROM notices WHERE id % 4 = 0),
gate AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY url ORDER BY position) > 1 THEN 'duplicate'
    WHEN title IS NULL OR length(title) < 8 OR lower(trim(title)) = '(untitled)' OR length(regexp_replace(title, '[^A-Za-zऄ-ॿ]', '', 'g')) < 5 THEN 'no title' END AS reason
  FROM items),
decided AS (
  SELECT g.*, CASE WHEN k.url IS NULL THEN 'new'
    WHEN g.content IS NOT NULL AND sha256(coalesce(g.title, '') || '|' || g.content) <> k.content_hash OR len(g.attachments) > 0 THEN 'updated' ELSE 'unchanged' END AS outcome
  FROM gate g LEFT JOIN known k USING (url) WHERE reason IS NULL)
"""


def _url():
    return F.concat_ws("/", F.lit("https://portal.example"), "source_label", F.floor(F.col("id") / 2).cast("string"))


def items(spark, path):
    i = F.col("id")
    none = F.array().cast("array<string>")
    return notices(spark, path).where(i % 3 != 0).select(
        i.alias("position"), _url().alias("url"), F.when(i % 7 != 0, F.col("title")).alias("title"), F.when(i % 11 != 0, F.col("content")).alias("content"),
        "category", "published_at", F.when(i % 2 == 0, F.col("title")).alias("summary"), F.when(i % 13 == 0, F.array(F.lit("a.pdf"))).otherwise(none).alias("attachments"),
    )


def known(spark, path):
    i = F.col("id")
    content = F.when(i % 5 == 0, F.concat(F.lit("New. "), "content")).otherwise(F.col("content"))
    rows = notices(spark, path).where(i % 4 == 0).select(
        _url().alias("url"), "title", content.alias("content"), "category", "published_at", F.col("title").alias("summary"), F.array().cast("array<string>").alias("attachments")
    )
    return rows.withColumn("content_hash", content_hash(F.col("title"), F.col("content")))


def decided(spark, path):
    return ops.outcomes(ops.admitted(items(spark, path)).where("reason IS NULL").drop("reason"), known(spark, path))


@query("ingest_admission", f"WITH {ITEMS_SQL} SELECT coalesce(reason, 'admitted') AS reason, count(*) AS n FROM gate GROUP BY 1")
def ingest_admission(spark, path):
    return ops.admitted(items(spark, path)).groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("ingest_outcomes", f"WITH {ITEMS_SQL} SELECT position, url, outcome FROM decided")
def ingest_outcomes(spark, path):
    return decided(spark, path).select("position", "url", "outcome")


@query(
    "run_counters",
    f"""WITH {ITEMS_SQL} SELECT split_part(url, '/', 4) AS source, count(*) AS found, count_if(outcome = 'new') AS new, count_if(outcome = 'updated') AS updated,
    count_if(outcome = 'unchanged') AS unchanged FROM decided GROUP BY 1""",
)
def run_counters(spark, path):
    return ops.run_counters(decided(spark, path).withColumn("source", F.split("url", "/")[3]), "source")


@query(
    "ingest_merge",
    f"""WITH {ITEMS_SQL}, a AS (SELECT * FROM gate WHERE reason IS NULL)
    SELECT url, coalesce(a.title, k.title) AS title, coalesce(a.category, k.category) AS category, CASE WHEN a.position IS NOT NULL THEN a.summary ELSE k.summary END AS summary,
      sha256(coalesce(a.title, k.title, '') || '|' || coalesce(a.content, k.content, '')) AS content_hash FROM known k FULL JOIN a USING (url)""",
)
def ingest_merge(spark, path):
    fresh = ops.admitted(items(spark, path)).where("reason IS NULL").drop("reason")
    return ops.merged(known(spark, path), fresh).select("url", "title", "category", "summary", "content_hash")


@query("known_url_anti_join", f"WITH {ITEMS_SQL} SELECT position, url FROM items WHERE url NOT IN (SELECT url FROM known)")
def known_url_anti_join(spark, path):
    return ops.inserted(known(spark, path), items(spark, path), "url").select("position", "url")


@query("set_difference", "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 50")
def set_difference(spark, path):
    e = table(spark, path, "events")
    return e.where("event_type = 'view'").select("user_id").distinct().join(e.where("event_type = 'error' AND value > 50").select("user_id"), "user_id", "left_anti")


@query(
    "page_overlap",
    """WITH p AS (SELECT DISTINCT user_id % 20 AS source, extract(day FROM ts)::BIGINT AS page, user_id AS item FROM events),
    f AS (SELECT source, item, min(page) AS first FROM p GROUP BY 1, 2)
    SELECT source, page, count(*) AS items, count_if(first = page) AS fresh, round(count_if(first < page) / count(*), 6) AS overlap FROM p JOIN f USING (source, item) GROUP BY 1, 2""",
)
def page_overlap(spark, path):
    e = table(spark, path, "events")
    return ops.overlap(e.select((F.col("user_id") % 20).alias("source"), F.dayofmonth("ts").cast("long").alias("page"), F.col("user_id").alias("item")))


@query("content_hash", "SELECT doc_id AS id, sha256(source || '|' || coalesce(text, '')) AS hash FROM documents")
def content_hashes(spark, path):
    return table(spark, path, "documents").select(F.col("doc_id").alias("id"), content_hash(F.col("source"), F.col("text")).alias("hash"))


@query(
    "point_id_uuid5",
    """WITH h AS (SELECT doc_id AS id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('notice:' || doc_id)) AS h FROM documents)
    SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point FROM h""",
)
def point_id_uuid5(spark, path):
    return table(spark, path, "documents").select(F.col("doc_id").alias("id"), uuid5(F.concat(F.lit("notice:"), F.col("doc_id").cast("string"))).alias("point"))


@query("viewer_hash", "SELECT DISTINCT user_id, sha256('salt:' || user_id || ':agent') AS viewer FROM events")
def viewer_hash(spark, path):
    return table(spark, path, "events").select("user_id").distinct().select("user_id", salted("salt", F.col("user_id").cast("string"), F.lit("agent")).alias("viewer"))


@query(
    "reextraction_status",
    f"""WITH {NOTICES_SQL}, {QUALITY_SQL} SELECT n.id, CASE WHEN length(trim(n.content)) = 0 THEN 'EMPTY' WHEN n.quality >= 0.55 THEN 'CLEAN'
      WHEN n.quality >= coalesce(o.quality, 0) AND length(trim(n.content)) > coalesce(length(o.content), 0) OR length(trim(n.content)) >= 60 AND n.quality >= 0.5 THEN 'IMPROVED' ELSE 'LOW_QUALITY' END AS status
    FROM scored n LEFT JOIN scored o ON o.id = n.id - 1""",
)
def reextraction_status(spark, path):
    """The announcement before stands for what was stored."""
    rows = notices(spark, path).select("id", quality("content").alias("q"), F.length("content").alias("n"), F.length(stripped("content")).alias("chars"))
    old = rows.select((F.col("id") + 1).alias("id"), F.col("q").alias("old_q"), F.col("n").alias("old_n"))
    return rows.join(old, "id", "left").select("id", ops.accepted_text(F.col("old_q"), F.col("old_n"), F.col("q"), F.col("chars")).alias("status"))


@query("resumable_scan", "SELECT doc_id, length(text)::INT AS chars, md5(text) AS digest FROM documents")
def resumable_scan(spark, path):
    """A scan of all documents in ranges of ids, the first half of them in an earlier call."""
    rows = table(spark, path, "documents")
    step = lambda part: part.select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))
    last, out = rows.agg(F.max("doc_id")).first()[0], shared_folder(spark, "scan")
    width = last // 8 + 1
    scans.resumable_scan(rows.where(F.col("doc_id") < 4 * width), out, step, "doc_id", width)
    return scans.resumable_scan(rows, out, step, "doc_id", width)
