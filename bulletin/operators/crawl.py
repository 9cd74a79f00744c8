"""Crawl bookkeeping: sitemaps, listing routes, picked sources, changed settings, issues of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.folders import shared_folder
from .catalogue import placed

# Parts of a sitemap's path that speak for and against articles, and what each one counts.
PREFERRED = ["news", "post", "content", "article", "notice", "press"]
SKIPPED = ["page", "category", "tag", "gallery", "image", "media", "author", "archive", "product", "video", "attachment"]
PREFERRED_POINTS, SKIPPED_POINTS = 3, -5
# Words of a path that speak for an article; so does a run of three digits.
ARTICLE_WORDS = ["content", "article", "post", "news", "notice", "press", "detail", "item"]
# A usable sitemap lists so many addresses of its own site, and that share of articles.
LEAST_ADDRESSES, LEAST_SHARE = 10, 0.5
# The names that routes and slugs give a category.
ROUTE_CATEGORIES = {
    "NOTICE": "NOTICE", "NOTICES": "NOTICE", "BULLETIN": "NOTICE", "SUCHANA": "NOTICE",
    "NEWS": "NEWS", "SAMACHAAR": "NEWS", "SAMACHAR": "NEWS",
    "PRESS": "PRESS_RELEASE", "PRESS_RELEASE": "PRESS_RELEASE", "PRESSRELEASE": "PRESS_RELEASE",
    "CIRCULAR": "CIRCULAR", "PARIPATRA": "CIRCULAR",
    "TENDER": "TENDER", "BID": "TENDER", "BOLI": "TENDER",
    "VACANCY": "VACANCY", "JOB": "JOB", "CAREER": "JOB", "RECRUITMENT": "JOB",
    "INTERN": "INTERNSHIP", "INTERNSHIP": "INTERNSHIP", "TRAINEE": "INTERNSHIP", "OTHER": "OTHER",
}
# Fixed value: characters of an error that are kept.
ERROR_CHARS = 500


def sitemap_score(url: str | Column) -> Column:
    """How much a sitemap's path promises articles; an address without a path scores 0."""
    path = F.lower(F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"//[^/?#]*([^?#]*)", 1))
    points = [F.when(F.contains(path, F.lit(w)), n).otherwise(0) for words, n in ((PREFERRED, PREFERRED_POINTS), (SKIPPED, SKIPPED_POINTS)) for w in words]
    total = F.lit(0)
    for p in points:
        total = total + p
    return total


def article_like(url: str | Column) -> Column:
    """Whether a URL's path looks like one article rather than a section: a word for it, or a number of three digits."""
    path = F.lower(F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"//[^/?#]*([^?#]*)", 1))
    return F.coalesce(path.rlike("[0-9]{3}|" + "|".join(ARTICLE_WORDS)), F.lit(False))


def usable_sitemaps(entries: DataFrame) -> DataFrame:
    """One sitemap a source (``source``, ``base``, ``sitemap``, ``loc``): the best scored that lists articles of its own site.

    It must hold ten addresses of the source's site, half of them articles.  Equal scores go to the
    smaller address.  A source without such a sitemap gets no row.
    """
    own = F.coalesce(urls.same_origin("loc", "base"), F.lit(False))
    counted = (
        entries.where(own).withColumn("article", article_like("loc"))
        .groupBy("source", "sitemap").agg(F.count(F.lit(1)).alias("addresses"), F.count_if("article").alias("articles"))
        .where((F.col("addresses") >= LEAST_ADDRESSES) & (F.col("articles") >= LEAST_SHARE * F.col("addresses")))
    )
    best = F.min_by(F.struct("sitemap", "addresses", "articles"), F.struct(-sitemap_score("sitemap"), F.col("sitemap")))
    return counted.groupBy("source").agg(best.alias("b")).select("source", "b.*")


def walked_sitemaps(files: DataFrame, roots: DataFrame, most: int = 20) -> DataFrame:
    """The sitemap files that a walk from each root reads, breadth first: source, file, place (from 0).

    ``files``: file, position, child, lastmod, one row an entry; ``child`` is null for an entry that
    is no sitemap.  ``roots``: source, file, since.  Children last changed before ``since`` are
    skipped, files already read are not read again, and ``most`` files a source are read: a level
    holds at most so many, so each step joins few rows with the files.  The levels are written to
    the shared folder.
    """
    spark = files.sparkSession
    known = files.select("file").distinct()
    level = roots.select("source", "file", "since", F.lit(0).alias("depth"), F.array(F.lit(0)).alias("trail")).join(known, "file", "left_semi")
    path, read = shared_folder(spark, "sitemap-walk"), None
    for depth in range(most):
        level.select("source", "file", "since", "depth", "trail").write.mode("append").parquet(f"{path}/depth={depth}")
        now = spark.read.parquet(f"{path}/depth={depth}")
        if now.isEmpty():
            break
        read = now if read is None else read.unionByName(now)
        fresh = F.col("lastmod").isNull() | F.col("since").isNull() | (F.col("lastmod") >= F.col("since"))
        children = now.join(files.where("child IS NOT NULL"), "file").where(fresh).select(
            "source", F.col("child").alias("file"), "since", F.lit(depth + 1).alias("depth"), F.concat("trail", F.array(F.col("position").cast("int"))).alias("trail")
        )
        first = children.groupBy("source", "file").agg(F.min_by(F.struct("since", "depth", "trail"), "trail").alias("c")).select("source", "file", "c.*")
        new = first.join(known, "file", "left_semi").join(read.select("source", "file"), ["source", "file"], "left_anti")
        level = _first(new, "trail", most)
    if read is None:
        return roots.select("source", "file", F.lit(0).alias("place")).limit(0)
    return _first(read, "struct(depth, trail)", most).select("source", "file", (F.col("n") - 1).alias("place"))


def _first(rows: DataFrame, order: str, most: int) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.expr(order)))).where(F.col("n") <= most)


def route_category(c: str | Column) -> Column:
    """The category that a route's or slug's name stands for: the whole name, else what precedes ``_``, else NOTICE."""
    known = F.create_map(*(F.lit(x) for pair in ROUTE_CATEGORIES.items() for x in pair))
    name = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.coalesce(F.try_element_at(known, name), F.try_element_at(known, F.substring_index(name, "_", 1)), F.lit("NOTICE"))


def reportable_routes(routes: DataFrame, least: float = 5.0) -> DataFrame:
    """Routes (``source``, ``url``, ``score``, ``verified``) worth a look, with their ``place`` from 1: verified ones first, then by score."""
    order = Window.partitionBy("source").orderBy(F.desc("verified"), F.desc("score"), "url")
    return routes.where(F.col("verified") | (F.col("score") >= least)).withColumn("place", F.row_number().over(order))


def listing_routes(manifest: DataFrame, columns: DataFrame, discovered: DataFrame) -> DataFrame:
    """Listing pages of each source (``source``, ``kind``, ``url``): the manifest's, else the columns', else discovered ones.

    A source takes all its rows from the first of the three that gives it a URL.
    """
    given = [t.select("source", F.upper(F.coalesce("kind", F.lit("NOTICE"))).alias("kind"), "url", F.lit(i).alias("__from")) for i, t in enumerate((manifest, columns, discovered))]
    rows = given[0].unionByName(given[1]).unionByName(given[2]).where("url <> ''")
    best = rows.groupBy("source").agg(F.min("__from").alias("__from"))
    return rows.join(best, ["source", "__from"]).withColumn("origin", F.element_at(F.array(*map(F.lit, ("manifest", "columns", "discovery"))), F.col("__from") + 1)).drop("__from")


def picked_sources(sources: DataFrame, needle: str | None = None) -> DataFrame:
    """Sources whose name, id or base URL holds the needle, by name; without one the enabled sources, longest not run first.

    Adds ``place``, from 1, by a range exchange.
    """
    if needle:
        hit = [F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.lower())) for c in ("name", "source", "base_url")]
        rows, order = sources.where(hit[0] | hit[1] | hit[2]), [F.asc("name"), F.asc("source")]
    else:
        rows, order = sources.where("enabled"), [F.asc_nulls_first("last_run_at"), F.asc("name"), F.asc("source")]
    return placed(rows, *order)


def updated_settings(sources: DataFrame, updates: DataFrame, caches: dict[str, list[str]]) -> DataFrame:
    """Sources with the updates' values; what is cached for a changed column becomes null.

    ``caches`` names the cached columns of each column.  Null in an update means that it does not
    touch the column.
    """
    new = updates.select("source", *(F.col(c).alias(f"__{c}") for c in caches))
    cached = sorted({x for names in caches.values() for x in names})
    stale = {x: [F.col(f"__{c}").isNotNull() for c, names in caches.items() if x in names] for x in cached}
    rows = sources.join(new, "source", "left")
    for x in cached:
        hit = stale[x][0]
        for other in stale[x][1:]:
            hit = hit | other
        rows = rows.withColumn(x, F.when(~hit, F.col(x)))
    return rows.withColumns({c: F.coalesce(f"__{c}", c) for c in caches}).drop(*(f"__{c}" for c in caches))


def clean_error(c: str | Column, n: int = ERROR_CHARS) -> Column:
    """An error on one line of at most ``n`` characters and a mark where it was cut."""
    c = F.col(c) if isinstance(c, str) else c
    line = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    cut = F.concat(F.rtrim(F.substring(line, 1, n)), F.lit(" … (truncated)"))
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown error").when(F.length(line) <= n, line).otherwise(cut)


def issue_summary(issues: DataFrame, by: str) -> DataFrame:
    """Failed and skipped issues of each run (``outcome`` null counts as failed) and the line that tells them."""
    failed = F.coalesce("outcome", F.lit("failed")) == "failed"
    counts = issues.groupBy(by).agg(F.count_if(failed).alias("failed"), F.count_if(~failed).alias("skipped"))
    told = lambda c: F.when(F.col(c) > 0, F.concat(F.lit(", "), F.col(c).cast("string"), F.lit(f" {c}")))
    return counts.withColumn("summary", F.concat_ws("", told("failed"), told("skipped")))


def unstreamed(items: DataFrame) -> DataFrame:
    """What is left to store when a run closes: items that were not stored while it ran."""
    return items.where(~F.coalesce("streamed", F.lit(False)))
