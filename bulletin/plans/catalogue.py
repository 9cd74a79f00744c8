"""Queries on the catalogue of announcements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as ops
from ..sources.tables import NOTICES_SQL, day_text, notices, table
from .registry import query

FROM, TO = "2024-02-01 00:00:00", "2025-01-31 00:00:00"
FILTERED = """
  SELECT * FROM notices WHERE category = 'TENDER' AND published_at >= TIMESTAMP '2024-02-01' AND published_at <= TIMESTAMP '2025-01-31'
    AND (contains(lower(title), 'the') OR contains(lower(content), 'the'))"""


@query(
    "catalog_list",
    f"""WITH {NOTICES_SQL}, f AS ({FILTERED})
    SELECT id, category, urgency, source_label, strftime(effective_at, '%Y-%m-%d') AS effective_day
    FROM f ORDER BY effective_at DESC NULLS FIRST, id DESC LIMIT 20""",
)
def catalog_list(spark, path):
    rows = ops.matching(notices(spark, path), category="TENDER", published_from=FROM, published_to=TO, text="the")
    return ops.page(rows, 1, 20).select("id", "category", "urgency", "source_label", day_text("effective_at").alias("effective_day"))


@query(
    "catalog_page_total",
    f"""WITH {NOTICES_SQL}, f AS ({FILTERED})
    SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS total_pages FROM f""",
)
def catalog_page_total(spark, path):
    return ops.totals(ops.matching(notices(spark, path), category="TENDER", published_from=FROM, published_to=TO, text="the"), 20)


@query(
    "catalog_page_two_by_title",
    f"""WITH {NOTICES_SQL} SELECT id, title FROM notices WHERE urgency = 'HIGH'
    ORDER BY title ASC NULLS LAST, id ASC LIMIT 15 OFFSET 15""",
)
def catalog_page_two_by_title(spark, path):
    return ops.page(ops.matching(notices(spark, path), urgency="HIGH"), 2, 15, "title", False).select("id", "title")


@query(
    "effective_date_order",
    f"""WITH {NOTICES_SQL} SELECT id, strftime(effective_at, '%Y-%m-%d') AS day, published_at IS NULL AS undated,
    row_number() OVER (ORDER BY effective_at DESC, id DESC) AS place FROM notices""",
)
def effective_date_order(spark, path):
    rows = notices(spark, path).select("id", "effective_at", F.col("published_at").isNull().alias("undated"))
    found = ops.placed(rows, F.col("effective_at").desc(), F.col("id").desc())
    return found.select("id", day_text("effective_at").alias("day"), "undated", "place")


@query("category_counts", f"WITH {NOTICES_SQL} SELECT category, count(*) AS n FROM notices GROUP BY category")
def category_counts(spark, path):
    return ops.counts(notices(spark, path), "category")


@query(
    "status_counts_total",
    """SELECT coalesce(o_orderstatus, '(all)') AS o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)""",
)
def status_counts_total(spark, path):
    return ops.counts_with_total(table(spark, path, "orders"), "o_orderstatus")


@query(
    "point_lookup",
    f"WITH {NOTICES_SQL} SELECT id, title, category FROM notices WHERE id = 42",
)
def point_lookup(spark, path):
    return notices(spark, path).where(F.col("id") == 42).select("id", "title", "category")


@query(
    "tag_membership",
    """SELECT l_orderkey AS id, list_sort(list_distinct(list(l_shipdate_month))) AS tags_text, count(*) AS n
    FROM (SELECT l_orderkey, l_returnflag AS l_shipdate_month FROM lineitem) GROUP BY 1 HAVING list_contains(list(l_shipdate_month), 'R')""".replace(
        "list_sort(list_distinct(list(l_shipdate_month)))", "array_to_string(list_sort(list_distinct(list(l_shipdate_month))), ',')"
    ),
)
def tag_membership(spark, path):
    tagged = table(spark, path, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("tags"), F.count(F.lit(1)).alias("n")
    )
    return ops.matching(tagged, tag="R").select("id", F.array_join("tags", ",").alias("tags_text"), "n")


@query(
    "newest_per_source",
    f"""WITH {NOTICES_SQL} SELECT source_label, id, row_number() OVER (PARTITION BY source_label ORDER BY effective_at DESC, id DESC) AS rank
    FROM notices QUALIFY rank <= 3""",
)
def newest_per_source(spark, path):
    rows = ops.top_per_group(notices(spark, path), ["source_label"], [F.desc("effective_at"), F.desc("id")], 3)
    return rows.select("source_label", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "sitemap_feed",
    f"""WITH {NOTICES_SQL}, s AS (
      SELECT id, title, effective_at, trim(regexp_replace(lower(title), '[^a-z0-9ऀ-ॿ]+', '-', 'g'), '-') AS slug FROM notices
      WHERE length(title) >= 8 AND lower(trim(title)) <> '(untitled)' AND length(regexp_replace(title, '[^A-Za-zऄ-ॿ]', '', 'g')) >= 5)
    SELECT id, slug || '-' || id AS slug, strftime(effective_at, '%Y-%m-%d') AS day FROM s ORDER BY effective_at DESC, id DESC LIMIT 50000""",
)
def sitemap_feed(spark, path):
    from ..functions.text import slug, storable_title

    rows = notices(spark, path).where(storable_title("title")).orderBy(F.desc("effective_at"), F.desc("id")).limit(50000)
    return rows.select("id", F.concat_ws("-", slug("title"), "id").alias("slug"), day_text("effective_at").alias("day"))
