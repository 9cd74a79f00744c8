"""Readers: the tables of a directory, and the announcement views that the queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "INTERVAL 1 DAY"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def effective_date(published: str | Column = "published_at", scraped: str | Column = "scraped_at") -> Column:
    """The date to order by: the discovery date if none is published or it is over a year ahead."""
    p, s = (F.col(c) if isinstance(c, str) else c for c in (published, scraped))
    return F.when(p.isNull() | (p > s + F.expr("INTERVAL 1 YEAR")), s).otherwise(p)


def notices(spark: SparkSession, path: str) -> DataFrame:
    """Documents as announcements: a dated title and content of a source, with urgency and category.

    The test tables hold no announcements; dates, category and urgency follow from the id.
    """
    i = F.col("doc_id")
    published = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id % 400 AS INT))")
    published = F.when(i % 9 == 0, F.lit(None)).when(i % 50 == 7, published + F.expr("INTERVAL 2 YEARS")).otherwise(published)
    return (
        table(spark, path, "documents")
        .select(
            i.alias("id"),
            F.col("source").alias("source_label"),
            F.col("lang").alias("language"),
            F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"),
            F.col("text").alias("content"),
            F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % 9 + 1).cast("int")).alias("category"),
            F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (i % 3 + 1).cast("int")).alias("urgency"),
            published.alias("published_at"),
            F.expr("timestamp_ntz'2024-06-01 00:00:00' + make_dt_interval(CAST(doc_id % 100 AS INT))").alias("scraped_at"),
        )
        .withColumn("effective_at", effective_date())
    )


#: The fixed categories of announcements.
CATEGORIES = ["NOTICE", "NEWS", "PRESS_RELEASE", "TENDER", "VACANCY", "RESULT", "CIRCULAR", "ACT", "REPORT"]

NOTICES_SQL = """
n0 AS (
  SELECT doc_id AS id, source AS source_label, lang AS language, text AS content,
         substring(split_part(text, chr(10), 1), 1, 120) AS title,
         ['NOTICE','NEWS','PRESS_RELEASE','TENDER','VACANCY','RESULT','CIRCULAR','ACT','REPORT'][doc_id % 9 + 1] AS category,
         ['LOW','MEDIUM','HIGH'][doc_id % 3 + 1] AS urgency,
         CASE WHEN doc_id % 9 = 0 THEN NULL
              WHEN doc_id % 50 = 7 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 400)::INT) + INTERVAL 2 YEAR
              ELSE TIMESTAMP '2024-01-01' + to_days((doc_id % 400)::INT) END AS published_at,
         TIMESTAMP '2024-06-01' + to_days((doc_id % 100)::INT) AS scraped_at
  FROM documents),
notices AS (
  SELECT *, CASE WHEN published_at IS NULL OR published_at > scraped_at + INTERVAL 1 YEAR THEN scraped_at ELSE published_at END AS effective_at
  FROM n0)
"""


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Events as crawl runs: twenty sources, with error FAILED, purchase SUCCESS, view RUNNING, the rest SKIPPED."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "FAILED").when(kind == "purchase", "SUCCESS").when(kind == "view", "RUNNING").otherwise("SKIPPED")
    return table(spark, path, "events").select(
        F.col("event_id").alias("run_id"), (F.col("user_id") % 20).alias("source_id"), status.alias("status"),
        F.col("ts").alias("started_at"), F.col("value"),
    )


RUNS_SQL = """
runs AS (
  SELECT event_id AS run_id, user_id % 20 AS source_id, ts AS started_at, value,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' WHEN 'view' THEN 'RUNNING' ELSE 'SKIPPED' END AS status
  FROM events)
"""


def day_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
