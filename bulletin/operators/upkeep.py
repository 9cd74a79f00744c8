"""Small operators around the catalogue: paging tests, gates, plans of change, labels, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def adds_new(pages: DataFrame, least: int = 3, share: float = 0.25, deep: bool = False) -> DataFrame:
    """Whether a page still brings rows: ``least`` new ones and that share, or any one in a deep crawl.

    ``pages``: source, page, items, fresh (as ``ingest.overlap`` gives them).
    """
    enough = F.col("fresh") > 0 if deep else (F.col("fresh") >= least) & (F.col("fresh") / F.greatest("items", F.lit(1)) >= share)
    return pages.withColumn("goes_on", enough)


def sitemap_gate(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Why each sitemap URL (``position``, ``url``) is skipped; null if it is taken.

    In order: seen earlier in the run, scraped before, no article URL, no title.
    """
    n = rows.withColumn("target", urls.normalised("url"))
    seen = known.select(urls.normalised("url").alias("target")).distinct().withColumn("__old", F.lit(True))
    first = F.row_number().over(Window.partitionBy("target").orderBy("position"))
    reason = (
        F.when(F.col("__first") > 1, "duplicate_in_run").when(F.col("__old"), "already_scraped")
        .when(~urls.is_article(urls.article_reason("url")), "not_article_url").when(F.col("title").isNull(), "no_title")
    )
    return n.withColumn("__first", first).join(seen, "target", "left").withColumn("reason", reason).drop("__first", "__old")


def route_changes(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Sources whose proposed URL differs by more than a slash at the end."""
    strip = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "/+$", "")
    rows = current.withColumnRenamed("url", "old").join(proposed.withColumnRenamed("url", "new"), "source_id")
    return rows.where(F.col("new").isNotNull() & (strip("old") != strip("new")))


def updated_sources(sources: DataFrame, manifest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Sources with the manifest's values where it has some."""
    m = manifest.select(key, *(F.col(f).alias(f"m_{f}") for f in fields))
    return sources.join(m, key, "left").withColumns({f: F.coalesce(f"m_{f}", f) for f in fields}).drop(*(f"m_{f}" for f in fields))


def synced_subscriptions(events: DataFrame, stored: DataFrame) -> DataFrame:
    """The latest event of each user as the subscription; one that was granted by hand stays."""
    latest = events.groupBy("user_id").agg(F.max_by(F.struct("tier", "status"), F.struct("at", "event_id")).alias("e"))
    rows = stored.join(latest, "user_id", "full_outer")
    keep = F.coalesce(F.col("granted"), F.lit(False)) | F.col("e").isNull()
    return rows.select("user_id", *(F.when(keep, F.col(c)).otherwise(F.col(f"e.{c}")).alias(c) for c in ("tier", "status")))


def attachments(label: Column, items: Column, legacy: Column) -> Column:
    """Names of all attachments with the single legacy URL at the end if it is not among them."""
    urls_ = F.array_union(F.coalesce(items, F.array().cast("array<string>")), F.array_compact(F.array(legacy)))
    return F.transform(urls_, lambda u: F.coalesce(F.when(label != "", label), F.element_at(F.split(u, "/"), -1)))


def context_label(title: Column, pages: Column, section: Column) -> Column:
    """Title, page or page range, and section."""
    low, high = F.array_min(pages), F.array_max(pages)
    page = F.when(low == high, F.concat(F.lit("page "), low.cast("string"))).when(low < high, F.concat(F.lit("pages "), low.cast("string"), F.lit("-"), high.cast("string")))
    return F.concat_ws(", ", title, page, F.when(section != "", section))


def answer_key(question: Column, language: Column, contexts: Column) -> Column:
    """Cache key of an answer: question, language and the first 500 characters of each context."""
    heads = F.array_join(F.transform(contexts, lambda c: F.substring(c, 1, 500)), "\x1f")
    return F.sha2(F.concat_ws("\x1e", F.lower(F.trim(question)), language, heads), 256)


def embedding_payload(title: Column, summary: Column, content: Column) -> Column:
    """Text to embed: title, summary and the content's first 1200 characters; null without a title."""
    return F.when(F.trim(title) != "", F.concat_ws("\n", title, F.when(summary != "", summary), F.substring(content, 1, 1200)))


def run_view(status: Column, started: Column, now: Column, found: Column, fresh_s: int = 3600) -> Column:
    """What to show of a run: running while it is fresh, done, failed, else nothing."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp"))
    return (
        F.when((status == "RUNNING") & (age <= fresh_s), "running").when(status == "SUCCESS", F.concat(F.lit("done: "), found.cast("string")))
        .when(status == "FAILED", "failed")
    )


def garbled_scope(quality: Column, scope: str) -> Column:
    """Rows that a bulk re-extraction takes: garbled, messy, broken or all."""
    return {"broken": quality == 0, "messy": (quality > 0) & (quality < 0.55), "garbled": quality < 0.55, "all": F.lit(True)}[scope]
