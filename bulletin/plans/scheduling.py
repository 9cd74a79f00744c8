"""Queries on crawl runs and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnosis
from ..operators import scheduling as ops
from ..sources.tables import RUNS_SQL, day_text, runs, table
from .registry import query

AS_OF = "2024-01-30 12:00:00"
LATEST_SQL = "latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1)"


@query("latest_run_per_source", f"WITH {RUNS_SQL}, {LATEST_SQL} SELECT source_id, run_id, status, strftime(started_at, '%Y-%m-%d') AS day FROM latest")
def latest_run_per_source(spark, path):
    return ops.latest_run(runs(spark, path)).select("source_id", "run_id", "status", day_text("started_at").alias("day"))


@query(
    "consecutive_failures",
    f"""WITH {RUNS_SQL} SELECT s.source_id, count(r.run_id) AS failures FROM (SELECT DISTINCT source_id FROM runs) s
    LEFT JOIN (SELECT source_id, max(started_at) AS t FROM runs WHERE status = 'SUCCESS' GROUP BY 1) l USING (source_id)
    LEFT JOIN runs r ON r.source_id = s.source_id AND r.status = 'FAILED' AND (l.t IS NULL OR r.started_at > l.t) GROUP BY 1""",
)
def consecutive_failures(spark, path):
    return ops.failures_since_success(runs(spark, path))


@query(
    "failure_streaks",
    f"""WITH {RUNS_SQL}, i AS (SELECT *, sum((status = 'SUCCESS')::INT) OVER (PARTITION BY source_id ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island
      FROM runs WHERE status IN ('SUCCESS', 'FAILED'))
    SELECT source_id, island, count(*) AS length FROM i WHERE status = 'FAILED' GROUP BY 1, 2""",
)
def failure_streaks(spark, path):
    return ops.failure_streaks(runs(spark, path))


def sources(spark, path):
    k = F.col("s_suppkey")
    return table(spark, path, "supplier").select(
        (k - 1).alias("source_id"), (k % 6 != 0).alias("enabled"), F.when(k % 3 == 0, 180).otherwise(900).cast("long").alias("poll_seconds")
    )


@query(
    "due_sources",
    f"""WITH {RUNS_SQL}, {LATEST_SQL}, src AS (SELECT s_suppkey - 1 AS source_id, s_suppkey % 6 <> 0 AS enabled,
      (CASE WHEN s_suppkey % 3 = 0 THEN 180 ELSE 900 END)::BIGINT AS poll_seconds FROM supplier),
    ok AS (SELECT source_id, max(started_at) AS t FROM runs WHERE status = 'SUCCESS' GROUP BY 1),
    f AS (SELECT r.source_id, count(*) AS failures FROM runs r LEFT JOIN ok USING (source_id)
      WHERE status = 'FAILED' AND started_at > greatest(coalesce(t, TIMESTAMP '1900-01-01'), TIMESTAMP '{AS_OF}' - INTERVAL 7200 SECONDS) GROUP BY 1),
    d AS (SELECT s.source_id, l.last_run,
        least(greatest(poll_seconds, 60) * pow(2, least(coalesce(failures, 0), 10)), 21600)::BIGINT AS wait_s
      FROM src s LEFT JOIN (SELECT source_id, max(started_at) AS last_run FROM runs GROUP BY 1) l USING (source_id) LEFT JOIN f USING (source_id)
      WHERE enabled AND s.source_id NOT IN (SELECT source_id FROM latest WHERE status = 'RUNNING'))
    SELECT source_id, wait_s, strftime(last_run, '%Y-%m-%d') AS last_day FROM d
    WHERE last_run IS NULL OR last_run + to_seconds(wait_s) <= TIMESTAMP '{AS_OF}' ORDER BY last_run NULLS FIRST, source_id LIMIT 50""",
)
def due_sources(spark, path):
    return ops.due(sources(spark, path), runs(spark, path), AS_OF).select("source_id", "wait_s", day_text("last_run").alias("last_day"))


@query(
    "stale_runs",
    f"""WITH {RUNS_SQL} SELECT source_id, count_if(status = 'RUNNING' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 3600 SECONDS) AS recovered,
      count_if(status = 'FAILED' OR status = 'RUNNING' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 3600 SECONDS) AS failed FROM runs GROUP BY 1""",
)
def stale_runs(spark, path):
    return ops.stale(runs(spark, path), AS_OF).groupBy("source_id").agg(
        F.count_if("recovered").alias("recovered"), F.count_if(F.col("status") == "FAILED").alias("failed")
    )


@query(
    "retry_queue",
    """SELECT doc_id AS id, doc_id % 8 AS attempts, CASE WHEN doc_id % 8 > 5 THEN 'failed' ELSE 'retry' END AS status,
      CASE WHEN doc_id % 8 >= 1 THEN ([120, 600, 1800, 7200, 21600])[doc_id % 8] END AS wait_s FROM documents""",
)
def retry_queue(spark, path):
    rows = table(spark, path, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 8).alias("attempts"))
    return rows.withColumns(ops.retried(F.lit("retry"), F.col("attempts")))


@query(
    "enrichment_queue",
    """SELECT doc_id AS id FROM documents WHERE doc_id % 4 IN (0, 1) AND length(text) > 20
      AND (doc_id % 5 = 0 OR TIMESTAMP '2024-01-15' + to_days((doc_id % 30)::INT) <= TIMESTAMP '2024-01-30 12:00:00')
    ORDER BY doc_id % 97 DESC, doc_id DESC LIMIT 25""",
)
def enrichment_queue(spark, path):
    i = F.col("doc_id")
    items = table(spark, path, "documents").select(
        i.alias("id"), F.col("text").alias("content"), (i % 97).alias("created_at"),
        F.when(i % 4 == 0, "pending").when(i % 4 == 1, "retry").otherwise("completed").alias("status"),
        F.when(i % 5 != 0, F.expr("timestamp_ntz'2024-01-15 00:00:00' + make_dt_interval(CAST(doc_id % 30 AS INT))")).alias("next_at"),
    )
    return ops.queue(items, AS_OF).select("id")


@query(
    "run_all_states",
    f"""WITH {RUNS_SQL}, {LATEST_SQL} SELECT s_suppkey - 1 AS source_id, CASE WHEN s_suppkey % 6 = 0 THEN 'disabled'
      WHEN status = 'RUNNING' THEN 'already-running' ELSE 'scheduled' END AS state FROM supplier LEFT JOIN latest ON source_id = s_suppkey - 1""",
)
def run_all_states(spark, path):
    latest = ops.latest_run(runs(spark, path)).select("source_id", F.col("status").alias("last"))
    return sources(spark, path).join(latest, "source_id", "left").select("source_id", ops.queue_state(F.col("last"), F.col("enabled")).alias("state"))


@query(
    "poll_decisions",
    """SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 11 = 0 THEN 'recheck' WHEN s_suppkey % 4 = 0 THEN 'listing'
      WHEN s_suppkey % 3 <> 0 THEN 'sitemap' ELSE 'detect' END AS action, (CASE WHEN s_suppkey % 4 = 0 THEN 900 ELSE 180 END)::BIGINT AS poll_seconds FROM supplier""",
)
def poll_decisions(spark, path):
    k = F.col("s_suppkey")
    has = k % 4 != 0
    return table(spark, path, "supplier").select(
        k.alias("source_id"), ops.poll_action(k % 11 == 0, has, k % 3 != 0).alias("action"), F.when(has, 180).otherwise(900).cast("long").alias("poll_seconds")
    )


@query(
    "run_outcomes_daily",
    f"""WITH {RUNS_SQL} SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS runs, count_if(status = 'FAILED') AS failed,
      max(run_id) AS latest FROM runs GROUP BY 1""",
)
def run_outcomes_daily(spark, path):
    return runs(spark, path).groupBy(day_text("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.max("run_id").alias("latest")
    )


@query(
    "final_status",
    """SELECT event_id AS run_id, CASE WHEN event_type = 'error' OR (user_id % 4 = 0 AND user_id % 3 > 0) THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events""",
)
def final_status(spark, path):
    e = table(spark, path, "events")
    error = F.when(F.col("event_type") == "error", F.col("event_type"))
    return e.select(F.col("event_id").alias("run_id"), ops.final_status(error, F.col("user_id") % 4, F.col("user_id") % 3).alias("status"))


# What happens in the runs of a source, by its number: (stage, outcome, reason, error); none from ten on.
ISSUES = [
    ("listing_url", "failed", None, "Listing URL returned HTTP 404: moved"), ("detail", "failed", None, "HTTP 403 Forbidden"), ("raw_fetch", None, None, "net::ERR_NAME_NOT_RESOLVED"),
    ("listing", "failed", None, "SSL handshake failed"), ("listing", "", None, "Read timed out"), ("schema_detection", "failed", None, "Could not detect a working listing pattern"),
    (None, "skipped", "not_article_url", None), (None, "skipped", "no_title", None), ("detail", "failed", None, "no text"), ("raw_fetch", "failed", None, "HTTP 410 after timeout"),
]
_case = lambda j: "CASE kind " + " ".join(f"WHEN {i} THEN '{x[j]}'" for i, x in enumerate(ISSUES) if x[j] is not None) + " END"


@query(
    "run_diagnosis",
    f"""WITH r AS (
      SELECT c_custkey AS run_id, c_custkey % 5 * 3 AS found, CASE WHEN c_custkey % 5 = 1 THEN 1 ELSE 0 END AS new, c_custkey % 2 = 0 AS sitemap, c_custkey % 3 = 0 AS moved, c_custkey % 7 = 0 AS noted, c_custkey % 4 AS pages,
        'https://s' || c_custkey || '.org/' AS home FROM customer),
    i AS (
      SELECT run_id, kind, {_case(0)} AS stage, coalesce(nullif({_case(1)}, ''), 'failed') AS outcome, {_case(2)} AS reason, lower(coalesce({_case(3)}, '')) AS error, event_id % 2 = 0 AS listed
      FROM (SELECT *, (run_id % 12 + event_id // 7 % 2 * 5) % 14 AS kind FROM (SELECT event_id, event_id % (SELECT count(*) FROM customer) + 1 AS run_id FROM events)) WHERE kind < 10),
    n AS (
      SELECT run_id, count(*) AS issues, count_if(kind IN (0, 9)) AS dead, count_if(kind = 1) AS blocked, count_if(kind = 2) AS dns, count_if(kind = 3) AS tls, count_if(kind IN (4, 9)) AS unreachable, count_if(kind = 5) AS unread,
        count_if(kind = 6) AS rejected, count_if(kind = 7) AS untitled, count_if(kind IN (1, 8)) AS details, bool_or(kind = 0) AS s404, bool_or(kind = 9) AS s410, bool_or(kind IN (0, 9) AND listed) AS dead_notice FROM i GROUP BY 1),
    c AS (SELECT r.*, coalesce(issues, 0) AS issues, coalesce(dead, 0) AS dead, coalesce(blocked, 0) AS blocked, coalesce(dns, 0) AS dns, coalesce(tls, 0) AS tls, coalesce(unreachable, 0) AS unreachable, coalesce(unread, 0) AS unread,
        coalesce(rejected, 0) AS rejected, coalesce(untitled, 0) AS untitled, coalesce(details, 0) AS details, concat_ws(', ', CASE WHEN s404 THEN '404' END, CASE WHEN s410 THEN '410' END) AS statuses,
        coalesce(dead_notice AND moved, false) AS patched FROM r LEFT JOIN n USING (run_id)),
    d AS (
      SELECT run_id, 0 AS i, 0 AS rank, 'listing_url_dead' AS code, dead AS n, statuses AS note, CASE WHEN patched THEN 'noticeListUrl=' || home || 'new' ELSE '' END AS patch, CASE WHEN patched THEN 'apply_patch' ELSE 'discover_routes' END AS actions FROM c WHERE dead > 0
      UNION ALL SELECT run_id, 1, 0, 'blocked', blocked, NULL, 'pollIntervalSeconds=3600', 'apply_patch' FROM c WHERE blocked > 0
      UNION ALL SELECT run_id, 2, 0, 'dns_failure', dns, NULL, '', 'edit_source' FROM c WHERE dns > 0
      UNION ALL SELECT run_id, 3, 0, 'tls_failure', tls, NULL, '', 'edit_source' FROM c WHERE tls > 0
      UNION ALL SELECT run_id, 4, 1, 'site_unreachable', unreachable, NULL, '', 'retry' FROM c WHERE unreachable > 0 AND dns + tls + blocked = 0
      UNION ALL SELECT run_id, 5, 0, 'no_listing_pattern', unread, NULL, CASE WHEN moved THEN 'noticeListUrl=' || home || 'new' ELSE '' END, 'discover_routes' || CASE WHEN sitemap THEN '' ELSE ',detect_sitemap' END FROM c WHERE unread > 0 AND dead = 0
      UNION ALL SELECT run_id, 6, 1, 'rows_rejected', rejected, NULL, '', 'edit_source' FROM c WHERE found = 0 AND rejected >= 3 AND unread = 0
      UNION ALL SELECT run_id, 7, 1, 'rows_untitled', untitled, NULL, '', 'retry,discover_routes' FROM c WHERE found = 0 AND untitled >= 3
      UNION ALL SELECT run_id, 8, 1, 'detail_pages_failing', details, NULL, '', 'retry' FROM c WHERE found > 0 AND details >= greatest(3, found // 2)
      UNION ALL SELECT run_id, 9, 2, 'pagination_mismatch', 0, NULL, 'paginationType=PATH_TEMPLATE,paginationParam=page' || CASE WHEN pages = 3 THEN ',startPage=0' ELSE '' END, 'apply_patch' FROM c WHERE pages IN (2, 3)),
    e AS (
      FROM d UNION ALL SELECT run_id, 10, 2, 'up_to_date', 0, NULL, '', '' FROM c WHERE found > 0 AND new = 0 AND run_id NOT IN (SELECT run_id FROM d)
      UNION ALL SELECT run_id, 11, 1, 'empty_no_errors', 0, NULL, '', CASE WHEN sitemap THEN '' ELSE 'detect_sitemap,' END || 'discover_routes' FROM c WHERE found = 0 AND issues = 0 AND run_id NOT IN (SELECT run_id FROM d)
      UNION ALL SELECT run_id, 12, 2, 'discovery_note', 0, 'nothing listed', '', '' FROM c WHERE noted)
    SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY rank, i) - 1)::INT AS place, code, ['error', 'warning', 'info'][rank + 1] AS severity, n, note, patch, actions FROM e""",
)
def run_diagnosis(spark, path):
    """Each customer is a run; events are its issues, of two kinds that follow from both ids."""
    k = F.col("c_custkey")
    home = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".org/"))
    scheme = lambda kind, start: F.struct(F.lit(kind).alias("type"), F.lit("page").alias("param"), start.cast("int").alias("start_page"))
    none = F.lit(None)
    runs = table(spark, path, "customer").select(
        k.alias("run_id"), (k % 5 * 3).alias("items_found"), F.when(k % 5 == 1, 1).otherwise(0).alias("items_new"), (k % 2 == 0).alias("has_sitemap"),
        F.create_map(F.lit("NOTICE"), F.concat(home, F.lit("list/"))).alias("listings"), F.when(k % 3 == 0, F.create_map(F.lit("NOTICE"), F.concat(home, F.lit("new")))).alias("best_routes"),
        F.when(k % 7 == 0, F.array(F.lit("nothing listed"))).alias("notes"), F.when(k % 4 > 0, scheme("QUERY_PARAM", none)).alias("pagination"),
        F.when(k % 4 == 1, scheme("QUERY_PARAM", none)).when(k % 4 == 2, scheme("PATH_TEMPLATE", none)).when(k % 4 == 3, scheme("PATH_TEMPLATE", F.lit(0))).alias("detected"),
    )
    last = table(spark, path, "customer").count()
    event = F.col("event_id")
    rows = table(spark, path, "events").select(event, (event % last + 1).alias("run_id"))
    kind = ((F.col("run_id") % 12 + F.floor(event / 7) % 2 * 5) % 14).cast("int")
    kinds = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(("stage", "outcome", "reason", "error"), x)]) for x in ISSUES])
    url = F.when(event % 2 == 0, F.concat(F.lit("https://s"), F.col("run_id").cast("string"), F.lit(".org/list"))).otherwise("https://elsewhere.org")
    issues = rows.where(kind < len(ISSUES)).select("run_id", F.get(kinds, kind).alias("x"), url.alias("url")).select("run_id", "x.*", "url")
    found = diagnosis.diagnoses(runs, issues)
    patch = F.array_join(F.transform(F.map_entries("patch"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("run_id", "place", "code", "severity", "n", "note", patch.alias("patch"), F.array_join("actions", ",").alias("actions"))
