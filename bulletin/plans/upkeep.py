"""Queries of the small operators around the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest, upkeep
from ..sources.tables import CATEGORIES, NOTICES_SQL, RUNS_SQL, notices, runs, table
from .registry import query

PAGES_SQL = """
p AS (SELECT DISTINCT user_id % 20 AS source, extract(day FROM ts)::BIGINT AS page, user_id AS item FROM events),
f AS (SELECT source, item, min(page) AS first FROM p GROUP BY 1, 2),
o AS (SELECT source, page, count(*) AS items, count_if(first = page) AS fresh FROM p JOIN f USING (source, item) GROUP BY 1, 2)
"""


@query("pagination_goes_on", f"WITH {PAGES_SQL} SELECT source, page, fresh >= 3 AND fresh / items >= 0.25 AS goes_on FROM o")
def pagination_goes_on(spark, path):
    e = table(spark, path, "events")
    seen = ingest.overlap(e.select((F.col("user_id") % 20).alias("source"), F.dayofmonth("ts").cast("long").alias("page"), F.col("user_id").alias("item")))
    return upkeep.adds_new(seen).select("source", "page", "goes_on")


@query(
    "sitemap_gate",
    r"""WITH u AS (SELECT page_id AS position, 'https://p.example/' || CASE WHEN page_id % 3 = 0 THEN 'tag' ELSE 'news' END || '/' || page_id // 2 AS url, page_id % 5 <> 0 AS titled FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY position) AS n FROM u)
    SELECT position, CASE WHEN n > 1 THEN 'duplicate_in_run' WHEN position % 7 = 0 THEN 'already_scraped' WHEN position % 3 = 0 THEN 'not_article_url' WHEN NOT titled THEN 'no_title' ELSE '' END AS reason
    FROM r""",
)
def sitemap_gate(spark, path):
    i = F.col("page_id")
    url = F.concat(F.lit("https://p.example/"), F.when(i % 3 == 0, "tag").otherwise("news"), F.lit("/"), F.floor(i / 2).cast("string"))
    rows = table(spark, path, "pages").select(i.alias("position"), url.alias("url"), F.when(i % 5 != 0, "t").alias("title"))
    first = rows.groupBy("url").agg(F.min("position").alias("position"))
    known = first.where("position % 7 = 0").select(F.concat("url", F.lit("/#top")).alias("url"))
    return upkeep.sitemap_gate(rows, known).select("position", F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    "route_changes",
    """SELECT s_suppkey AS source_id, 'https://s' || s_suppkey || '.example/list' AS old, 'https://s' || s_suppkey || '.example/news/' AS new FROM supplier WHERE s_suppkey % 4 = 1""",
)
def route_changes(spark, path):
    k = F.col("s_suppkey")
    base = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example/"))
    rows = table(spark, path, "supplier")
    proposed = F.when(k % 4 == 0, F.concat(base, F.lit("list/"))).when(k % 4 == 1, F.concat(base, F.lit("news/")))
    return upkeep.route_changes(rows.select(k.alias("source_id"), F.concat(base, F.lit("list")).alias("url")), rows.select(k.alias("source_id"), proposed.alias("url")))


@query("manifest_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS s_name FROM supplier")
def manifest_update(spark, path):
    rows = table(spark, path, "supplier").select("s_suppkey", "s_name")
    manifest = rows.where("s_suppkey % 2 = 1 OR s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "renamed").alias("s_name"))
    return upkeep.updated_sources(rows, manifest, "s_suppkey", ["s_name"])


@query(
    "subscription_sync",
    """WITH e AS (SELECT o_custkey AS user_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS tier, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1)
    SELECT c_custkey AS user_id, CASE WHEN e.user_id IS NULL OR c_custkey % 4 = 0 THEN 'FREE' ELSE tier END AS tier, CASE WHEN e.user_id IS NULL OR c_custkey % 4 = 0 THEN 'ACTIVE' ELSE status END AS status
    FROM customer LEFT JOIN e ON e.user_id = c_custkey""",
)
def subscription_sync(spark, path):
    events = table(spark, path, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("event_id")
    )
    stored = table(spark, path, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("FREE").alias("tier"), F.lit("ACTIVE").alias("status"), (F.col("c_custkey") % 4 == 0).alias("granted"))
    return upkeep.synced_subscriptions(events, stored)


@query(
    "attachment_names",
    """SELECT doc_id AS id, array_to_string(CASE WHEN doc_id % 3 = 0 THEN ['a.pdf', 'b.pdf'] WHEN doc_id % 3 = 1 THEN ['a.pdf', 'c.pdf'] ELSE ['a.pdf'] END, ';') AS names FROM documents""",
)
def attachment_names(spark, path):
    i = F.col("doc_id")
    items = F.when(i % 3 == 0, F.array(F.lit("x/a.pdf"), F.lit("x/b.pdf"))).otherwise(F.array(F.lit("x/a.pdf")))
    legacy = F.when(i % 3 == 1, "y/c.pdf").when(i % 3 == 0, "x/a.pdf")
    return table(spark, path, "documents").select(i.alias("id"), F.array_join(upkeep.attachments(F.lit(""), items, legacy), ";").alias("names"))


@query(
    "context_labels",
    """SELECT doc_id AS id, concat_ws(', ', source, CASE doc_id % 3 WHEN 0 THEN 'page 2' WHEN 1 THEN 'pages 2-4' END, CASE WHEN doc_id % 2 = 0 THEN 'Intro' END) AS label FROM documents""",
)
def context_labels(spark, path):
    i = F.col("doc_id")
    pages = F.when(i % 3 == 0, F.array(F.lit(2))).when(i % 3 == 1, F.array(F.lit(4), F.lit(2)))
    return table(spark, path, "documents").select(i.alias("id"), upkeep.context_label(F.col("source"), pages, F.when(i % 2 == 0, "Intro").otherwise("")).alias("label"))


@query("answer_keys", "SELECT doc_id AS id, sha256('what?' || chr(30) || lang || chr(30) || substring(text, 1, 500) || chr(31) || source) AS key FROM documents")
def answer_keys(spark, path):
    rows = table(spark, path, "documents")
    return rows.select(F.col("doc_id").alias("id"), upkeep.answer_key(F.lit(" What? "), F.col("lang"), F.array("text", "source")).alias("key"))


@query(
    "embedding_payloads",
    f"""WITH {NOTICES_SQL} SELECT id, md5(title || chr(10) || CASE WHEN id % 2 = 0 THEN category || chr(10) ELSE '' END || substring(content, 1, 1200)) AS payload FROM notices WHERE trim(title) <> ''""",
)
def embedding_payloads(spark, path):
    payload = upkeep.embedding_payload(F.col("title"), F.when(F.col("id") % 2 == 0, F.col("category")).otherwise(""), F.col("content"))
    return notices(spark, path).select("id", F.md5(payload).alias("payload")).where("payload IS NOT NULL")


@query(
    "run_views",
    f"""WITH {RUNS_SQL} SELECT coalesce(CASE WHEN status = 'RUNNING' AND started_at >= TIMESTAMP '2024-01-29 00:00:00' THEN 'running' WHEN status = 'SUCCESS' THEN 'done: ' || run_id % 3
      WHEN status = 'FAILED' THEN 'failed' END, '') AS shown, count(*) AS n FROM runs WHERE started_at < TIMESTAMP '2024-01-30' GROUP BY 1""",
)
def run_views(spark, path):
    rows = runs(spark, path).where("started_at < timestamp_ntz'2024-01-30 00:00:00'")
    shown = upkeep.run_view(F.col("status"), F.col("started_at"), F.expr("timestamp_ntz'2024-01-30 00:00:00'"), F.col("run_id") % 3, 86400)
    return rows.groupBy(F.coalesce(shown, F.lit("")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "model_replies",
    """SELECT doc_id AS id, 'S' || doc_id AS summary, CASE WHEN doc_id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS urgency, CASE WHEN doc_id % 3 = 0 THEN 'TENDER' END AS category,
      CASE WHEN doc_id % 5 = 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM documents WHERE doc_id % 7 <> 0""",
)
def model_replies(spark, path):
    i = F.col("doc_id")
    field = lambda name, value: F.concat(F.lit(f', "{name}": '), value)
    reply = F.concat(
        F.lit('Here it is:\n```json\n{"summary": "'), F.when(i % 7 != 0, F.concat(F.lit(" S"), i.cast("string"))).otherwise(" "), F.lit('"'),
        field("urgency", F.when(i % 2 == 0, '"high"').otherwise('"soon"')), field("category", F.when(i % 3 == 0, '"tender"').otherwise('"other"')),
        field("category_confidence", F.when(i % 5 == 0, '"many"').otherwise("0.5")), F.lit(', "tags": ["a", ""]}\n```'),
    )
    rows = table(spark, path, "documents").select(i.alias("id"), text.model_analysis(reply, CATEGORIES).alias("r")).where("r IS NOT NULL")
    return rows.select("id", "r.summary", "r.urgency", "r.category", "r.confidence")


@query(
    "citations_checked",
    """SELECT doc_id AS id, 'See [1] and [3]' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' text' END || '.' AS answer FROM documents""",
)
def citations_checked(spark, path):
    i = F.col("doc_id")
    raw = F.concat(F.lit("See [1] and [3] [4]"), F.when(i % 2 == 0, " [12] ").otherwise("  text [99] "), F.lit("."))
    return table(spark, path, "documents").select(i.alias("id"), text.cited(raw, 3).alias("answer"))


FACTS_SQL = "(?i)" + "|".join(f"(?:{p})" for p in text.FACT_QUESTIONS)
QUESTIONS_SQL = r"""asked AS (
  SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'How many ' WHEN 2 THEN 'What is the total ' ELSE '' END || text || CASE WHEN conv_id % 3 = 0 THEN ' in 2021' ELSE '' END AS text
  FROM conversations WHERE role = 'user')"""


@query(
    "underspecified_questions",
    rf"""WITH {QUESTIONS_SQL} SELECT conv_id, turn, regexp_matches(text, '{FACTS_SQL}') AND NOT regexp_matches(text, '{text.YEAR}')
      AND NOT regexp_matches(text, '{text.QUOTED.replace("'", "''")}') AND NOT regexp_matches(text, '(?i){text.RECENCY}')
      AND len(regexp_split_to_array(trim(text), '\s+')) <= 14 AS unclear FROM asked""",
)
def underspecified_questions(spark, path):
    """All questions asked; the tables hold none for facts, so such words stand before or behind some."""
    before = F.when(F.col("turn") % 4 == 0, "How many ").when(F.col("turn") % 4 == 2, "What is the total ").otherwise("")
    after = F.when(F.col("conv_id") % 3 == 0, " in 2021").otherwise("")
    asked = table(spark, path, "conversations").where("role = 'user'").withColumn("text", F.concat(before, "text", after))
    return asked.select("conv_id", "turn", text.underspecified("text").alias("unclear"))


@query(
    "question_gates",
    rf"""SELECT conv_id, turn, regexp_matches(text, '(?i){text.RECENCY}') AS recent, len(regexp_split_to_array(trim(text, ' '), '\s+')) <= 14 AS short FROM conversations WHERE role = 'user'""",
)
def question_gates(spark, path):
    asked = table(spark, path, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.col("text").rlike(f"(?iU){text.RECENCY}").alias("recent"), (F.size(F.split(F.trim("text"), r"\s+")) <= 14).alias("short"))


@query(
    "scan_noise",
    """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'नेपाल सरकार सूचना प्रकाशन गरिएको छ सम्बन्धित सबैको जानकारी' || chr(10) || 'बोर्ड COVID-19 WHO' || chr(10) || '12 ab' ELSE 'Se eh' END AS cleaned FROM documents""",
)
def scan_noise(spark, path):
    i = F.col("doc_id")
    scanned = "नेपाल सरकार सूचना प्रकाशन गरिएको छ सम्बन्धित सबैको जानकारी\nSe eh eS\nबोर्ड aa COVID-19 WHO eh |\n12 ab"
    return table(spark, path, "documents").select(i.alias("id"), text.without_scan_noise(F.when(i % 2 == 0, scanned).otherwise("Se eh")).alias("cleaned"))
