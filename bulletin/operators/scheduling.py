"""Run history, due sources, retry queues and stale-run recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The retry ladder in seconds; after it an item has failed.
RETRY_SECONDS = [120, 600, 1800, 7200, 21600]
FAILURE_WINDOW_S = 7200


def latest_run(runs: DataFrame) -> DataFrame:
    """The latest run of each source, of equals that with the largest id."""
    best = runs.groupBy("source_id").agg(F.max_by(F.struct("run_id", "status", "started_at"), F.struct("started_at", "run_id")).alias("r"))
    return best.select("source_id", "r.*")


def failures_since_success(runs: DataFrame, as_of: Column | None = None, window_s: int | None = None) -> DataFrame:
    """Failed runs after the last success, or in the last ``window_s`` seconds if that is later.

    Two aggregates and a join: the last success of each source, then its later failures.
    """
    last = runs.where("status = 'SUCCESS'").groupBy("source_id").agg(F.max("started_at").alias("last_success"))
    joined = runs.where("status = 'FAILED'").join(last, "source_id", "left")
    start = F.col("last_success")
    if window_s is not None:
        start = F.greatest(start, as_of - F.expr(f"INTERVAL {window_s} SECONDS"))
    failed = joined.where(start.isNull() | (F.col("started_at") > start)).groupBy("source_id").agg(F.count(F.lit(1)).alias("failures"))
    sources = runs.select("source_id").distinct()
    return sources.join(failed, "source_id", "left").select("source_id", F.coalesce("failures", F.lit(0)).alias("failures"))


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Islands of consecutive failures: source, number of the island, length."""
    w = Window.partitionBy("source_id").orderBy("started_at", "run_id")
    island = F.sum(F.when(F.col("status") == "SUCCESS", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    failed = runs.where("status IN ('SUCCESS', 'FAILED')").withColumn("island", island.cast("long")).where("status = 'FAILED'")
    return failed.groupBy("source_id", "island").agg(F.count(F.lit(1)).alias("length"))


def wait_seconds(poll: Column, failures: Column, least: int = 60, most: int = 21600) -> Column:
    """Poll interval, at least ``least``, doubled by failure up to ten times, at most ``most``."""
    return F.least(F.greatest(poll, F.lit(least)) * F.pow(F.lit(2.0), F.least(failures, F.lit(10))), F.lit(most)).cast("long")


def due(sources: DataFrame, runs: DataFrame, as_of: str, limit: int | None = 50) -> DataFrame:
    """Enabled sources whose interval with backoff is over and of which no run is live, oldest first.

    ``sources``: source_id, enabled, poll_seconds.  A source that never ran is due.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    last = runs.groupBy("source_id").agg(F.max("started_at").alias("last_run"))
    live = latest_run(runs).where("status = 'RUNNING'").select("source_id")
    rows = (
        sources.where("enabled")
        .join(last, "source_id", "left")
        .join(failures_since_success(runs, now, FAILURE_WINDOW_S), "source_id", "left")
        .join(live, "source_id", "left_anti")
        .withColumn("wait_s", wait_seconds(F.col("poll_seconds"), F.coalesce("failures", F.lit(0))))
    )
    over = F.col("last_run").isNull() | (F.col("last_run") + F.make_dt_interval(secs=F.col("wait_s")) <= now)
    rows = rows.where(over).orderBy(F.asc_nulls_first("last_run"), "source_id")
    return rows.limit(limit) if limit else rows


def poll_action(row_recheck: Column, has_sitemap: Column, sitemap_ok: Column) -> Column:
    return F.when(row_recheck, "recheck").when(~has_sitemap, "listing").when(sitemap_ok, "sitemap").otherwise("detect")


def stale(runs: DataFrame, as_of: str, after_s: int = 3600) -> DataFrame:
    """Runs with those that have been RUNNING for too long marked as failed."""
    now = F.lit(as_of).cast("timestamp_ntz")
    old = (F.col("status") == "RUNNING") & (F.col("started_at") < now - F.expr(f"INTERVAL {after_s} SECONDS"))
    return runs.withColumns({"recovered": F.coalesce(old, F.lit(False)), "status": F.when(old, "FAILED").otherwise(F.col("status"))})


def retried(status: Column, attempts: Column) -> dict[str, Column]:
    """State of a queued item after another failed attempt: status and seconds until the next."""
    step = F.get(F.array(*map(F.lit, RETRY_SECONDS)), (attempts - 1).cast("int"))
    return {"status": F.when(attempts > len(RETRY_SECONDS), "failed").otherwise("retry"), "wait_s": F.when(attempts >= 1, step)}


def queue(items: DataFrame, as_of: str, size: int = 25) -> DataFrame:
    """Pending items and those to retry whose time has come, with content, newest first."""
    now = F.lit(as_of).cast("timestamp_ntz")
    ready = F.col("status").isin("pending", "retry") & (F.col("next_at").isNull() | (F.col("next_at") <= now))
    return items.where(ready & (F.length("content") > 20)).orderBy(F.desc("created_at"), F.desc("id")).limit(size)


def queue_state(latest_status: Column, enabled: Column) -> Column:
    """What a request to run a source becomes."""
    return F.when(~enabled, "disabled").when(latest_status == "RUNNING", "already-running").otherwise("scheduled")


def final_status(error: Column, found: Column, hard_failures: Column) -> Column:
    """A run failed if it has an error, or found nothing while something failed hard."""
    return F.when(error.isNotNull() | ((found == 0) & (hard_failures > 0)), "FAILED").otherwise("SUCCESS")
