"""Queries that run as streams over the events and must equal their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ingest import upsert_batches
from ..sources.folders import shared_folder
from ..sources.tables import notices, table
from ..streaming import views
from .registry import query


def copied(df, name):
    """The rows as files that a stream can pick up."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


@query(
    "views_stream_daily",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 50 AS notice_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2""",
)
def views_stream_daily(spark, path):
    rows = table(spark, path, "events").where("event_type = 'view'").select((F.col("user_id") % 50).alias("notice_id"), "ts")
    stream = views.read(spark, copied(rows, "views-in"))
    totals = stream.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "notice_id").agg(F.count(F.lit(1)).alias("views"))
    return views.upserted(totals, shared_folder(spark, "views-out"), shared_folder(spark, "views-state"), ["day", "notice_id"])


@query(
    "views_stream_closed_days",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 50 AS notice_id, count(*) AS views FROM events
    WHERE event_type = 'view' AND ts < date_trunc('day', (SELECT max(ts) FROM events WHERE event_type = 'view') - INTERVAL 2 DAY) GROUP BY 1, 2""",
)
def views_stream_closed_days(spark, path):
    rows = table(spark, path, "events").where("event_type = 'view'").select((F.col("user_id") % 50).alias("notice_id"), "ts")
    stream = views.daily_views(views.read(spark, copied(rows, "views-in")))
    return views.appended(stream, shared_folder(spark, "views-out"), shared_folder(spark, "views-state"))


@query("ingest_stream_dedupe", "SELECT DISTINCT user_id AS url FROM events")
def ingest_stream_dedupe(spark, path):
    rows = table(spark, path, "events").select(F.col("user_id").alias("url"), "ts")
    stream = views.distinct_items(views.read(spark, copied(rows, "items-in")), late="60 days")
    return views.appended(stream, shared_folder(spark, "items-out"), shared_folder(spark, "items-state")).select("url")


@query("ingest_stream_upsert", "SELECT min(doc_id) AS position, doc_id // 2 AS url FROM documents GROUP BY doc_id // 2")
def ingest_stream_upsert(spark, path):
    rows = notices(spark, path).select(F.col("id").alias("position"), F.floor(F.col("id") / 2).alias("url"))
    stream = views.read(spark, copied(rows, "upsert-in"))
    out, state = shared_folder(spark, "upsert-out"), shared_folder(spark, "upsert-state")
    upsert_batches(stream, out, state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
