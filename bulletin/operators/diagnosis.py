"""What went wrong in a crawl run and what to change: rules over its counters, failures and configuration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

# Words of refused, unresolved, uncertified and unreachable requests, statuses of dead
# pages, settings that hold the address of a category's list.
BLOCKED = ["403", "forbidden", "access denied", "cloudflare", "captcha", "just a moment", "attention required", "bot detect", "rate limit", "429"]
DNS = ["err_name_not_resolved", "nxdomain", "getaddrinfo", "dns"]
TLS = ["err_cert", "ssl", "certificate", "handshake", "err_ssl_protocol_error"]
UNREACHABLE = [
    "err_connection_refused", "err_connection_timed_out", "err_address_unreachable", "err_connection_reset", "err_empty_response", "timed out", "timeout",
    "502", "503", "504",
]
DEAD = ["400", "401", "404", "410"]
FIELDS = {"NOTICE": "noticeListUrl", "NEWS": "newsListUrl", "PRESS_RELEASE": "pressReleaseListUrl"}
SEVERITIES = ["error", "warning", "info"]

TEXTS, PAIRS = "array<string>", "map<string,string>"


def bare(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", "")


def counters(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """``runs`` with the number of issues of each kind; tasks count before anything moves."""
    listed = F.map_entries(F.coalesce("listings", F.create_map().cast(PAIRS)))
    of_run = runs.select("run_id", F.transform(listed, lambda e: F.struct(e["key"].alias("category"), bare(e["value"]).alias("url"))).alias("lists"))
    rows = issues.join(of_run, "run_id")
    failed = F.coalesce(F.nullif("outcome", F.lit("")), F.lit("failed")) == "failed"
    stage = lambda *names: F.coalesce(failed & F.col("stage").isin(*names), F.lit(False))
    marked = lambda words: failed & F.lower(F.coalesce("error", F.lit(""))).rlike("|".join(map(re.escape, words)))
    skipped = lambda reason: F.coalesce((F.col("outcome") == "skipped") & (F.col("reason") == reason), F.lit(False))
    status = F.regexp_extract(F.coalesce("error", F.lit("")), r"HTTP (\d{3})", 1)
    dead = stage("listing_url", "raw_fetch", "listing") & status.isin(DEAD)
    category = F.get(F.filter("lists", lambda e: (e["url"] != "") & (e["url"] == bare(F.col("issues_url")))), F.lit(0))["category"]
    rows = rows.withColumnRenamed("url", "issues_url").withColumns({"dead": dead, "status": status, "category": category})
    n = lambda c, name: F.count_if(c).alias(name)
    counted = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("issues"), n("dead", "dead"), F.array_sort(F.collect_set(F.when(F.col("dead"), F.col("status")))).alias("statuses"),
        F.collect_set(F.when(F.col("dead"), F.col("category"))).alias("dead_lists"), n(marked(BLOCKED), "blocked"), n(marked(DNS), "dns"), n(marked(TLS), "tls"),
        n(marked(UNREACHABLE), "unreachable"), n(stage("schema_detection"), "unread"), n(skipped("not_article_url"), "rejected"), n(skipped("no_title"), "untitled"),
        n(stage("detail"), "details"),
    )
    zero = ["issues", "dead", "blocked", "dns", "tls", "unreachable", "unread", "rejected", "untitled", "details"]
    out = runs.join(counted, "run_id", "left").fillna(0, zero)
    return out.withColumns({c: F.coalesce(c, F.array().cast(TEXTS)) for c in ("statuses", "dead_lists")})


def diagnoses(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """The diagnoses of each run, worst severity first, else in the order of the rules.

    ``runs``: ``run_id``, ``items_found``, ``items_new``, ``has_sitemap``, ``listings`` (category to
    address), ``best_routes`` (category to discovered address), ``notes`` (of discovery), and
    ``pagination`` and ``detected`` (struct of type, param, start_page, or null).  ``issues``:
    ``run_id``, ``stage``, ``outcome`` (failed if missing), ``reason``, ``error``, ``url``.

    One row a diagnosis: ``run_id``, ``place`` (from 0), ``code``, ``severity``, ``n`` (issues it
    rests on), ``note``, ``patch`` (settings to change) and ``actions``.  A run without any has no
    row.  Issues of unknown runs are left out; null maps and notes are empty.
    """
    df = counters(runs, issues)
    best = F.coalesce("best_routes", F.create_map().cast(PAIRS))
    fields = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    empty, nothing = F.create_map().cast(PAIRS), F.array().cast(TEXTS)
    found, new = F.coalesce("items_found", F.lit(0)), F.coalesce("items_new", F.lit(0))
    texts = lambda *names: F.array(*map(F.lit, names)) if names else nothing
    sitemap = F.when(F.coalesce("has_sitemap", F.lit(False)), nothing).otherwise(texts("detect_sitemap"))

    def said(when: Column, code: str, severity: str, n: Column | None = None, patch: Column = empty, actions: Column = nothing, note: Column | None = None) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(SEVERITIES.index(severity)).alias("rank"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(0) if n is None else n).cast("long").alias("n"),
                (F.lit(None).cast("string") if note is None else note).alias("note"), patch.alias("patch"), actions.alias("actions"),
            ),
        )

    moved = F.map_filter(best, lambda k, v: F.array_contains("dead_lists", k) & F.map_contains_key(fields, k) & (F.coalesce(v, F.lit("")) != ""))
    as_patch = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.try_element_at(fields, e["key"]), e["value"])))
    listings = F.coalesce("listings", empty)
    others = F.map_filter(best, lambda k, v: (F.coalesce(v, F.lit("")) != "") & (bare(v) != bare(F.try_element_at(listings, k))))
    named = F.map_filter(best, lambda k, v: F.map_contains_key(fields, k))
    p, d = F.col("pagination"), F.col("detected")
    differs = ~(d["type"].eqNullSafe(p["type"]) & d["param"].eqNullSafe(p["param"])) & (F.coalesce(d["type"], F.lit("")) != "")
    scheme = F.create_map(F.lit("paginationType"), d["type"], F.lit("paginationParam"), d["param"])
    start = F.when(d["start_page"].isNotNull(), F.create_map(F.lit("startPage"), d["start_page"].cast("string"))).otherwise(empty)
    c = F.col
    rules = F.array(
        said(c("dead") > 0, "listing_url_dead", "error", c("dead"), let(moved, as_patch), F.when(F.size(moved) > 0, texts("apply_patch")).otherwise(texts("discover_routes")), F.array_join("statuses", ", ")),
        said(c("blocked") > 0, "blocked", "error", c("blocked"), F.create_map(F.lit("pollIntervalSeconds"), F.lit("3600")), texts("apply_patch")),
        said(c("dns") > 0, "dns_failure", "error", c("dns"), actions=texts("edit_source")),
        said(c("tls") > 0, "tls_failure", "error", c("tls"), actions=texts("edit_source")),
        said((c("unreachable") > 0) & (c("dns") + c("tls") + c("blocked") == 0), "site_unreachable", "warning", c("unreachable"), actions=texts("retry")),
        said((c("unread") > 0) & (c("dead") == 0), "no_listing_pattern", "error", c("unread"), F.when(F.size(others) > 0, let(named, as_patch)).otherwise(empty), F.concat(texts("discover_routes"), sitemap)),
        said((found == 0) & (c("rejected") >= 3) & (c("unread") == 0), "rows_rejected", "warning", c("rejected"), actions=texts("edit_source")),
        said((found == 0) & (c("untitled") >= 3), "rows_untitled", "warning", c("untitled"), actions=texts("retry", "discover_routes")),
        said((found > 0) & (c("details") >= F.greatest(F.lit(3), F.floor(found / 2))), "detail_pages_failing", "warning", c("details"), actions=texts("retry")),
        said(p.isNotNull() & d.isNotNull() & differs, "pagination_mismatch", "info", patch=F.map_concat(scheme, start), actions=texts("apply_patch")),
    )
    df = df.withColumn("said_", F.filter(rules, lambda x: x.isNotNull()))
    none = F.size("said_") == 0
    quiet = F.array(
        said(none & (found > 0) & (new == 0), "up_to_date", "info"),
        said(none & (found == 0) & (c("issues") == 0), "empty_no_errors", "warning", actions=F.concat(sitemap, texts("discover_routes"))),
    )
    notes = F.transform(F.coalesce("notes", nothing), lambda x: said(F.lit(True), "discovery_note", "info", note=x))
    every = F.filter(F.concat("said_", quiet, notes), lambda x: x.isNotNull())
    # The place in the list keeps the order within a severity.
    placed = F.array_sort(F.transform(every, lambda x, i: F.struct(x["rank"].alias("rank"), i.alias("i"))))
    ordered = let(F.struct(every.alias("every"), placed.alias("placed")), lambda v: F.transform(v["placed"], lambda y: F.get(v["every"], y["i"])))
    out = df.select("run_id", F.posexplode_outer(ordered).alias("place", "d")).where("d IS NOT NULL")
    return out.select("run_id", "place", "d.code", "d.severity", "d.n", "d.note", "d.patch", "d.actions")
