"""Aggregate reports: health, transitions, usage, meters, latency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, quota
from ..operators import reports as ops
from ..sources.tables import NOTICES_SQL, day_text, notices, table
from .registry import query

#: The quality score in SQL for the text column ``content``.
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
GAPS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
QUALITY_SQL = rf"""
q0 AS (
  SELECT *, regexp_replace(substring(content, 1, 8000), '{GAPS}', '', 'g') AS solid,
         regexp_extract_all(substring(content, 1, 8000), '[A-Za-z]{{2,}}') AS words
  FROM notices),
q1 AS (
  SELECT *, length(solid) AS chars, len(words)::DOUBLE AS n,
         len(list_filter(words, lambda w: list_contains({STOP_SQL}, lower(w))))::DOUBLE AS stop,
         len(list_filter(words, lambda w: length(w) = 2))::DOUBLE AS short,
         length(regexp_replace(solid, '[^ऀ-ॿ]', '', 'g'))::DOUBLE AS deva, length(regexp_replace(solid, '[^A-Za-z]', '', 'g'))::DOUBLE AS latin
  FROM q0),
scored AS (
  SELECT *, CASE WHEN content IS NULL OR length(regexp_replace(content, '^{GAPS}+|{GAPS}+$', '', 'g')) < 40 OR chars = 0 THEN 0.0::DOUBLE
         WHEN deva / chars >= 0.15 THEN greatest(0.0, least(1.0, 0.65 + deva / chars) - CASE WHEN deva / chars >= 0.6 THEN least(0.5, 3.0 * latin / chars) ELSE 0.0 END)
         WHEN n < 25 THEN 0.6::DOUBLE
         ELSE greatest(0.0, least(1.0, stop / n / 0.12) - CASE WHEN short / n > 0.2 THEN least(0.6, 3.0 * (short / n - 0.2)) ELSE 0.0 END, least(0.6, 4.0 * deva / chars)) END::DOUBLE AS quality
  FROM q1),
classed AS (SELECT *, CASE WHEN quality >= 0.55 THEN 'clean' WHEN quality > 0 THEN 'messy' ELSE 'broken' END AS class FROM scored)
"""
HEALTH_COLUMNS = """count(*) AS total, count_if(id % 4 = 0) AS with_attachment, count_if(id % 4 <> 0) AS without_attachment,
  count_if(class = 'clean') AS clean, count_if(class = 'messy') AS messy, count_if(class = 'broken') AS broken,
  count_if(class <> 'clean' AND id % 4 = 0) AS fixable, round(100.0 * count_if(class = 'clean') / count(*), 1) AS clean_percent"""


def scored(spark, path):
    rows = notices(spark, path).withColumn("quality", text.quality("content"))
    return rows.withColumns({"class": text.quality_class("quality"), "attached": F.col("id") % 4 == 0})


@query("text_quality", f"WITH {NOTICES_SQL}, {QUALITY_SQL} SELECT id, round(quality, 9) AS quality, class FROM classed")
def text_quality(spark, path):
    return scored(spark, path).select("id", F.round("quality", 9).alias("quality"), "class")


@query("health_rollup", f"WITH {NOTICES_SQL}, {QUALITY_SQL} SELECT {HEALTH_COLUMNS} FROM classed")
def health_rollup(spark, path):
    return ops.health(scored(spark, path))


@query("health_by_source", f"WITH {NOTICES_SQL}, {QUALITY_SQL} SELECT source_label, {HEALTH_COLUMNS} FROM classed GROUP BY source_label")
def health_by_source(spark, path):
    return ops.health(scored(spark, path), "source_label")


@query(
    "quality_agreement",
    f"""WITH {NOTICES_SQL}, {QUALITY_SQL} SELECT class, l.quality AS label, count(*) AS n
    FROM classed JOIN labels l ON l.doc_id = classed.id GROUP BY class, l.quality""",
)
def quality_agreement(spark, path):
    labels = table(spark, path, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return scored(spark, path).join(labels, "id").groupBy("class", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "usage_monthly_pivot",
    """SELECT user_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month,
      round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS click, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS purchase,
      round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS view
    FROM events GROUP BY 1, 2""",
)
def usage_monthly_pivot(spark, path):
    events = table(spark, path, "events")
    used = ops.monthly_usage(events.select("user_id", F.col("event_type").alias("metric"), "ts", F.col("value").alias("quantity")))
    wide = ops.by_metric(used, ["click", "purchase", "view"])
    return wide.select("user_id", day_text("month").alias("month"), *(F.round(c, 4).alias(c) for c in ("click", "purchase", "view")))


PLAN_SQL = """
plan AS (
  SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'PRO' WHEN 'BUILDING' THEN 'BASIC' END AS tier,
         CASE WHEN c_custkey % 5 = 0 THEN 'PAST_DUE' WHEN c_custkey % 7 = 0 THEN 'CANCELED' WHEN c_custkey % 2 = 0 THEN 'TRIALING' ELSE 'ACTIVE' END AS status,
         c_custkey % 10 < 5 AS in_period FROM customer),
effective AS (
  SELECT user_id, CASE WHEN tier IS NOT NULL AND (status IN ('ACTIVE', 'TRIALING') OR status = 'PAST_DUE' AND in_period) THEN tier ELSE 'FREE' END AS tier FROM plan),
used AS (SELECT o_custkey AS user_id, count(*) AS used FROM orders GROUP BY 1)
"""


def subscriptions(spark, path):
    """Customers as users: the segment gives a tier (some have none), the key the state."""
    k = F.col("c_custkey")
    tier = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "PRO").when(F.col("c_mktsegment") == "BUILDING", "BASIC")
    status = F.when(k % 5 == 0, "PAST_DUE").when(k % 7 == 0, "CANCELED").when(k % 2 == 0, "TRIALING").otherwise("ACTIVE")
    return table(spark, path, "customer").select(k.alias("user_id"), tier.alias("tier"), status.alias("status"), (k % 10 < 5).alias("in_period"))


@query("effective_plan", f"WITH {PLAN_SQL} SELECT user_id, tier FROM effective")
def effective_plan(spark, path):
    return subscriptions(spark, path).select("user_id", ops.effective_tier("tier", "status", "in_period").alias("tier"))


@query(
    "quota_meter",
    f"""WITH {PLAN_SQL}, m AS (
      SELECT e.user_id, tier, coalesce(used, 0) AS used, CASE tier WHEN 'FREE' THEN 5 WHEN 'BASIC' THEN 15 END AS lim
      FROM effective e LEFT JOIN used u USING (user_id))
    SELECT user_id, tier, used, lim::BIGINT AS "limit", CASE WHEN lim IS NOT NULL THEN greatest(lim - used, 0) END AS remaining,
      coalesce(used >= lim, false) AS exceeded FROM m""",
)
def quota_meter(spark, path):
    tiers = subscriptions(spark, path).select("user_id", ops.effective_tier("tier", "status", "in_period").alias("tier"))
    used = table(spark, path, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("used"))
    return ops.meter(tiers, used, {"FREE": 5, "BASIC": 15, "PRO": None})


@query(
    "distinct_daily_viewers",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 50 AS notice_id, count(DISTINCT user_id) AS viewers FROM events WHERE event_type = 'view' GROUP BY 1, 2""",
)
def distinct_daily_viewers(spark, path):
    views = table(spark, path, "events").where("event_type = 'view'")
    return ops.daily_viewers(views.select((F.col("user_id") % 50).alias("notice_id"), F.col("user_id").alias("viewer"), "ts"))


BOUNDS = ops.LATENCY_BOUNDS
BUCKET_SQL = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}::DOUBLE" for b in BOUNDS) + " END"


@query("latency_histogram", f"SELECT coalesce({BUCKET_SQL}, -1.0) AS bound, count(*) AS n FROM events GROUP BY 1")
def latency_histogram(spark, path):
    return ops.histogram(table(spark, path, "events"), "value").select(F.coalesce("bound", F.lit(-1.0)).alias("bound"), "n")


@query(
    "bucket_percentiles",
    f"""WITH h AS (SELECT event_type, {BUCKET_SQL} AS bound, count(*) AS n FROM events GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bound NULLS LAST) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
    SELECT event_type, p, coalesce(min(bound) FILTER (cum >= p * total / 100), {BOUNDS[-1]}::DOUBLE) AS seconds
    FROM c, (VALUES (50), (90), (95), (99)) t(p) GROUP BY event_type, p""",
)
def bucket_percentiles(spark, path):
    return ops.percentiles(ops.histogram(table(spark, path, "events"), "value", "event_type"), "event_type")


@query(
    "category_transitions_top",
    f"""WITH {NOTICES_SQL} SELECT category AS old, urgency AS new, count(*) AS n FROM notices GROUP BY 1, 2 ORDER BY n DESC, old, new LIMIT 15""",
)
def category_transitions_top(spark, path):
    return ops.transitions(notices(spark, path).select(F.col("category").alias("old"), F.col("urgency").alias("new")), 15)


@query(
    "mode_section",
    """WITH u AS (SELECT source, split_part(url, '/', 4) AS section, page_id FROM (SELECT page_id, url, 's' || page_id % 7 AS source FROM pages)),
    c AS (SELECT source, section, count(*) AS n, min(page_id) AS first FROM u WHERE section <> '' GROUP BY 1, 2)
    SELECT source, section, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1""",
)
def mode_section(spark, path):
    pages = table(spark, path, "pages")
    section = F.get(F.split("url", "/"), F.lit(3))
    rows = pages.select(F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string")).alias("source"), section.alias("section"), "page_id")
    return ops.most_common(rows.where("section <> ''"), "source", "section", "page_id")


@query("chunk_stats", None)  # packing is a fold over blocks: held against a plain version in the tests
def chunk_stats(spark, path):
    return ops.chunk_stats(chunking.chunk_documents(table(spark, path, "documents")))


@query(
    "spend_by_nation_rank",
    """SELECT n_name, round(sum(o_totalprice), 2) AS spent, rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC) AS place
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
def spend_by_nation_rank(spark, path):
    nation = F.broadcast(table(spark, path, "nation"))  # 25 rows at any size
    spent = (
        table(spark, path, "orders").join(table(spark, path, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("s"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("s", 2).alias("spent"))
    )
    return spent.withColumn("place", F.rank().over(Window.orderBy(F.desc("spent"))).cast("long"))


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
      round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def pricing_summary(spark, path):
    return table(spark, path, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_net"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"),
    )


LIMITS = {"FREE": 5, "BASIC": 15, "PRO": None}
ADMITTED_SQL = f"""
  SELECT event_id, user_id, lim AS "limit", CASE WHEN lim IS NOT NULL THEN least(place - 1, lim) END AS used, coalesce(place <= lim, true) AS admitted
  FROM (SELECT event_id, user_id, CASE tier WHEN 'PRO' THEN NULL WHEN 'BASIC' THEN 15 ELSE 5 END::BIGINT AS lim, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS place
    FROM (SELECT * REPLACE (ts + to_days((event_id % 3 * 20)::INT) AS ts) FROM events) LEFT JOIN effective USING (user_id))"""


def asked(spark, path):
    """Events as questions, a third of them twenty and a third forty days later; users as in ``subscriptions``."""
    later = F.expr("ts + make_dt_interval(CAST(event_id % 3 * 20 AS INT))")
    plans = subscriptions(spark, path).select("user_id", ops.effective_tier("tier", "status", "in_period").alias("tier"))
    return table(spark, path, "events").select("event_id", "user_id", later.alias("ts")), plans


@query("quota_admission", f"WITH {PLAN_SQL} {ADMITTED_SQL}")
def quota_admission(spark, path):
    return quota.admitted(*asked(spark, path), LIMITS).select("event_id", "user_id", "limit", "used", "admitted")
