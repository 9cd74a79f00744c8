"""Queries of crawl bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl as ops
from ..sources.tables import RUNS_SQL, runs, table
from .registry import query

PATH_SQL = "lower(regexp_extract(url, '//[^/?#]*([^?#]*)', 1))"
SITE_SQL = "regexp_replace(lower(regexp_extract(url, '//([^/?#:]*)', 1)), '^(www|m|blog)\\.', '')"
SCORE_SQL = " + ".join(f"CASE WHEN contains(path, '{w}') THEN {n} ELSE 0 END" for words, n in ((ops.PREFERRED, 3), (ops.SKIPPED, -5)) for w in words)


@query("sitemap_child_scores", f"WITH u AS (SELECT page_id, {PATH_SQL} || CASE page_id % 3 WHEN 0 THEN '-news-sitemap.xml' WHEN 1 THEN '-tag.xml' ELSE '' END AS path FROM pages) SELECT page_id, {SCORE_SQL} AS score FROM u")
def sitemap_child_scores(spark, path):
    """The pages' own paths, two of three with a sitemap's name at the end."""
    i = F.col("page_id")
    bare = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, path, "pages").select(i, ops.sitemap_score(F.concat(bare, F.when(i % 3 == 0, "-news-sitemap.xml").when(i % 3 == 1, "-tag.xml").otherwise(""))).alias("score"))


@query(
    "sitemap_detected",
    rf"""WITH e AS (SELECT {SITE_SQL} AS site, page_id, {PATH_SQL} AS path, regexp_replace(lower(regexp_extract(url, '//([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages),
    w AS (SELECT *, right(site, 11) AS source, 'https://' || right(site, 11) || CASE page_id % 3 WHEN 0 THEN '/news.xml' WHEN 1 THEN '/tags.xml' ELSE '/map.xml' END AS sitemap FROM e),
    o AS (SELECT * FROM w WHERE host = source OR ends_with(host, '.' || source)),
    c AS (SELECT source, sitemap, count(*) AS addresses, count_if(regexp_matches(path, '[0-9]{{3}}|{"|".join(ops.ARTICLE_WORDS)}')) AS articles FROM o GROUP BY 1, 2)
    SELECT source, sitemap, addresses, articles FROM c WHERE addresses >= 10 AND articles >= 0.5 * addresses
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN ends_with(sitemap, 'news.xml') THEN 0 WHEN ends_with(sitemap, 'map.xml') THEN 1 ELSE 2 END, sitemap) = 1""",
)
def sitemap_detected(spark, path):
    """The hosts' last 11 characters (``example.com``) as sites, their pages dealt over three sitemaps."""
    site = F.regexp_replace(F.lower(F.regexp_extract("url", "//([^/?#:]*)", 1)), r"^(www|m|blog)\.", "")
    source = F.right(site, F.lit(11))
    base = F.concat(F.lit("https://"), source)
    kind = F.col("page_id") % 3
    sitemap = F.concat(base, F.when(kind == 0, "/news.xml").when(kind == 1, "/tags.xml").otherwise("/map.xml"))
    return ops.usable_sitemaps(table(spark, path, "pages").select(source.alias("source"), base.alias("base"), sitemap.alias("sitemap"), F.col("url").alias("loc")))


@query(
    "sitemap_walk",
    """WITH RECURSIVE f AS (SELECT s_suppkey AS file, s_suppkey * 3 + n AS child, n, CASE WHEN (s_suppkey * 3 + n) % 5 = 0 THEN 1 ELSE 9 END AS lastmod FROM supplier, range(3) t(n)),
    w AS (SELECT k AS source, k AS file, 0 AS depth, [0] AS trail FROM range(1, 4) r(k)
      UNION ALL SELECT source, child, depth + 1, list_append(trail, f.n::INT) FROM w JOIN f USING (file) WHERE lastmod >= 5 AND child IN (SELECT s_suppkey FROM supplier) AND depth < 20),
    b AS (SELECT source, file, min((depth, trail)) AS k FROM w GROUP BY 1, 2),
    r AS (SELECT source, file, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS place FROM b)
    SELECT source, file, place FROM r WHERE place < 20""",
)
def sitemap_walk(spark, path):
    """Suppliers as sitemap files: file k lists 3k, 3k + 1 and 3k + 2, of which multiples of five are old."""
    rows = table(spark, path, "supplier").select(F.col("s_suppkey").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position"))
    child = F.col("file") * 3 + F.col("position")
    files = rows.withColumn("child", child).withColumn("lastmod", F.when(child % 5 == 0, 1).otherwise(9))
    roots = spark.range(1, 4).select(F.col("id").alias("source"), F.col("id").alias("file"), F.lit(5).alias("since"))
    return ops.walked_sitemaps(files, roots)


NAMES = ["notices_2", " press_release ", "bid", "Samachar", "career_page", "unknown_kind", ""]


@query(
    "route_categories",
    f"""SELECT page_id, ['NOTICE', 'PRESS_RELEASE', 'TENDER', 'NEWS', 'JOB', 'NOTICE', 'NOTICE'][page_id % 7 + 1] AS category FROM pages""",
)
def route_categories(spark, path):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, path, "pages").select("page_id", ops.route_category(name).alias("category"))


@query(
    "routes_reportable",
    f"""WITH r AS (SELECT {SITE_SQL} AS source, url, page_id % 11 AS score, page_id % 4 = 0 AS verified FROM pages)
    SELECT source, url, score, verified, row_number() OVER (PARTITION BY source ORDER BY verified DESC, score DESC, url) AS place FROM r WHERE verified OR score >= 5""",
)
def routes_reportable(spark, path):
    site = F.regexp_replace(F.lower(F.regexp_extract("url", "//([^/?#:]*)", 1)), r"^(www|m|blog)\.", "")
    return ops.reportable_routes(table(spark, path, "pages").select(site.alias("source"), "url", (F.col("page_id") % 11).alias("score"), (F.col("page_id") % 4 == 0).alias("verified")))


@query(
    "listing_routes",
    """SELECT s_suppkey AS source, CASE WHEN s_suppkey % 4 = 0 THEN 'NEWS' ELSE 'NOTICE' END AS kind, 'https://' || s_name || CASE WHEN s_suppkey % 4 = 0 THEN '/m' WHEN s_suppkey % 3 = 0 THEN '/c' ELSE '/d' END AS url,
      CASE WHEN s_suppkey % 4 = 0 THEN 'manifest' WHEN s_suppkey % 3 = 0 THEN 'columns' ELSE 'discovery' END AS origin FROM supplier""",
)
def listing_routes(spark, path):
    k = F.col("s_suppkey")
    rows = table(spark, path, "supplier")
    page = lambda end: F.concat(F.lit("https://"), F.col("s_name"), F.lit(end)).alias("url")
    manifest = rows.where(k % 2 == 0).select(k.alias("source"), F.lit("news").alias("kind"), F.when(k % 4 == 0, page("/m")).alias("url"))
    return ops.listing_routes(manifest, rows.where(k % 3 == 0).select(k.alias("source"), F.lit(None).cast("string").alias("kind"), page("/c")), rows.select(k.alias("source"), F.lit("NOTICE").alias("kind"), page("/d")))


@query(
    "sources_picked",
    """WITH s AS (SELECT s_suppkey AS source, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 10 END AS last_run_at FROM supplier WHERE s_acctbal > 0)
    SELECT 'due' AS pick, source, row_number() OVER (ORDER BY last_run_at NULLS FIRST, name, source) AS place FROM s
    UNION ALL SELECT 'named', s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) FROM supplier WHERE contains(lower(s_name), '07') OR contains(s_suppkey::VARCHAR, '07') OR contains('https://n' || s_nationkey || '.example', '07')""",
)
def sources_picked(spark, path):
    k = F.col("s_suppkey")
    sources = table(spark, path, "supplier").select(
        k.alias("source"), F.col("s_name").alias("name"), F.concat(F.lit("https://n"), F.col("s_nationkey").cast("string"), F.lit(".example")).alias("base_url"),
        (F.col("s_acctbal") > 0).alias("enabled"), F.when(k % 3 != 0, k % 10).alias("last_run_at"),
    )
    picks = [ops.picked_sources(sources, needle).select(F.lit(name).alias("pick"), "source", "place") for name, needle in (("due", None), ("named", "07"))]
    return picks[0].unionByName(picks[1])


@query(
    "source_settings_changed",
    """SELECT s_suppkey AS source, CASE WHEN s_suppkey % 5 = 0 THEN 'https://new' ELSE 'https://old' END AS base_url, CASE WHEN s_suppkey % 4 = 0 THEN '/new' ELSE '/list' END AS notice_url,
      CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS sitemap, CASE WHEN s_suppkey % 4 <> 0 THEN 'selectors' END AS notice_schema FROM supplier""",
)
def source_settings_changed(spark, path):
    k = F.col("s_suppkey")
    rows = table(spark, path, "supplier")
    stored = rows.select(k.alias("source"), F.lit("https://old").alias("base_url"), F.lit("/list").alias("notice_url"), F.col("s_name").alias("sitemap"), F.lit("selectors").alias("notice_schema"))
    updates = rows.where("s_suppkey % 5 = 0 OR s_suppkey % 4 = 0").select(k.alias("source"), F.when(k % 5 == 0, "https://new").alias("base_url"), F.when(k % 4 == 0, "/new").alias("notice_url"))
    return ops.updated_settings(stored, updates, {"base_url": ["sitemap"], "notice_url": ["notice_schema"]})


@query(
    "errors_cleaned",
    r"""WITH l AS (SELECT page_id, trim(regexp_replace(html, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), ' ') AS line, html FROM pages)
    SELECT page_id, CASE WHEN coalesce(html, '') = '' THEN 'Unknown error' WHEN length(line) <= 500 THEN line ELSE rtrim(substring(line, 1, 500), ' ') || ' … (truncated)' END AS error FROM l""",
)
def errors_cleaned(spark, path):
    """Whole pages as the error messages."""
    return table(spark, path, "pages").select("page_id", ops.clean_error("html").alias("error"))


@query(
    "issue_summaries",
    f"""WITH {RUNS_SQL}, i AS (SELECT source_id, count_if(status <> 'SKIPPED') AS failed, count_if(status = 'SKIPPED') AS skipped FROM runs WHERE status <> 'SUCCESS' GROUP BY 1)
    SELECT source_id, failed, skipped, CASE WHEN failed > 0 THEN ', ' || failed || ' failed' ELSE '' END || CASE WHEN skipped > 0 THEN ', ' || skipped || ' skipped' ELSE '' END AS summary FROM i""",
)
def issue_summaries(spark, path):
    rows = runs(spark, path).where("status <> 'SUCCESS'")
    return ops.issue_summary(rows.select("source_id", F.when(F.col("status") == "SKIPPED", "skipped").when(F.col("status") == "FAILED", "failed").alias("outcome")), "source_id")


@query("run_close_left", f"WITH {RUNS_SQL} SELECT run_id, source_id FROM runs WHERE status IN ('FAILED', 'SKIPPED')")
def run_close_left(spark, path):
    s = F.col("status")
    rows = runs(spark, path).withColumn("streamed", F.when(s == "SUCCESS", True).when(s == "RUNNING", True).when(s == "FAILED", False))
    return ops.unstreamed(rows).select("run_id", "source_id")
