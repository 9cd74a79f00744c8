"""Aggregations behind the health, usage and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the latency buckets in seconds; longer ones are in the total only.
LATENCY_BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
LIVE = ["ACTIVE", "TRIALING"]


def health(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of attachments and text classes in one pass; ``rows`` have ``class`` and ``attached``."""
    of = lambda c: F.count_if(F.col("class") == c)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("attached").alias("with_attachment"),
        F.count_if(~F.col("attached")).alias("without_attachment"),
        of("clean").alias("clean"),
        of("messy").alias("messy"),
        of("broken").alias("broken"),
        F.count_if((F.col("class") != "clean") & F.col("attached")).alias("fixable"),
        F.round(100.0 * of("clean") / F.count(F.lit(1)), 1).alias("clean_percent"),
    )


def monthly_usage(events: DataFrame) -> DataFrame:
    """Sum of ``quantity`` per user, metric and month."""
    return events.groupBy("user_id", "metric", F.date_trunc("month", "ts").alias("month")).agg(F.sum("quantity").alias("quantity"))


def by_metric(usage: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics as columns, 0 where a user has none."""
    return usage.groupBy("user_id", "month").pivot("metric", metrics).sum("quantity").fillna(0.0, metrics)


def effective_tier(tier: str, status: str, in_period: str) -> Column:
    """The tier of a live subscription or one past due inside its period; else FREE."""
    live = F.col(status).isin(LIVE) | ((F.col(status) == "PAST_DUE") & F.col(in_period))
    return F.when(F.col(tier).isNotNull() & live, F.col(tier)).otherwise("FREE")


def meter(tiers: DataFrame, used: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """Used, limit, remaining and exceeded; a null limit is unlimited."""
    limit = F.lit(None).cast("long")
    for tier, n in limits.items():
        limit = F.when(F.col("tier") == tier, F.lit(n).cast("long")).otherwise(limit)
    rows = tiers.join(used, "user_id", "left").withColumns({"used": F.coalesce("used", F.lit(0)), "limit": limit})
    return rows.withColumns(
        {
            "remaining": F.when(F.col("limit").isNotNull(), F.greatest(F.col("limit") - F.col("used"), F.lit(0))),
            "exceeded": F.coalesce(F.col("used") >= F.col("limit"), F.lit(False)),
        }
    )


def daily_viewers(views: DataFrame) -> DataFrame:
    """Distinct viewers per announcement and day; repeated views are dropped before they are counted."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return views.select(day, "notice_id", "viewer").distinct().groupBy("day", "notice_id").agg(F.count(F.lit(1)).alias("viewers"))


def bucket(c: Column, bounds: list[float] = LATENCY_BOUNDS) -> Column:
    """The least bound that is not under the value; null beyond the last."""
    return F.coalesce(*(F.when(c <= b, F.lit(b)) for b in bounds))


def histogram(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by, bucket(F.col(value)).alias("bound")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(hist: DataFrame, by: str, percents: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """Bound of the bucket in which each percentile falls; the last bound for what lies beyond."""
    w = Window.partitionBy(by)
    cumulative = F.sum("n").over(w.orderBy(F.asc_nulls_last("bound")).rowsBetween(Window.unboundedPreceding, 0))
    rows = hist.withColumns({"cum": cumulative, "total": F.sum("n").over(w)})
    rows = rows.withColumn("p", F.explode(F.array(*map(F.lit, percents))))
    reached = F.min(F.when(F.col("cum") >= F.col("p") * F.col("total") / 100, F.col("bound")))
    return rows.groupBy(by, "p").agg(F.coalesce(reached, F.lit(LATENCY_BOUNDS[-1])).alias("seconds"))


def transitions(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent pairs of old and new."""
    return rows.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "old", "new").limit(k)


def most_common(rows: DataFrame, by: str, value: str, place: str) -> DataFrame:
    """Each group's most frequent value; of equals the one seen first."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    best = counts.groupBy(by).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("best"))
    return best.select(by, f"best.{value}", "best.n")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Of (``doc_id``, ``content``): documents with chunks, chunks, least and largest mean size of a document, and the mean of all chunks.

    Sizes are characters; without chunks the means are null.
    """
    a = F.col("chars") / F.col("n")
    sizes = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    return sizes.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.round(F.min(a), 6).alias("least_average"),
        F.round(F.max(a), 6).alias("largest_average"), F.round(F.sum("chars") / F.sum("n"), 6).alias("average"),
    )
