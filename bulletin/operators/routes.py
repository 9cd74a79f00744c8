"""Route discovery: links of home pages scored by their words, verified by the rows of the fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.columns import let
from ..sources.folders import shuffled, written
from . import page_tree

# Words of lists in addresses and link texts with their categories, words of pages that
# are no list, addresses tried where nothing better is linked.
KEYWORDS = {
    "details-of-printed-licenses": "NOTICE", "printed-licenses": "NOTICE", "driving-license": "NOTICE", "license": "NOTICE", "smart-card": "NOTICE",
    "notice-board": "NOTICE", "noticeboard": "NOTICE", "public-notice": "NOTICE", "notices": "NOTICE", "notice": "NOTICE", "suchana": "NOTICE",
    "soochana": "NOTICE", "announcement": "NOTICE", "announcements": "NOTICE", "सार्वजनिक सूचना": "NOTICE", "सूचना पाटी": "NOTICE",
    "सूचना तथा जानकारी": "NOTICE", "सूचना": "NOTICE", "सुचना": "NOTICE", "जानकारी": "NOTICE", "अत्यावश्यक": "NOTICE", "सवारी चालक अनुमतिपत्र": "NOTICE",
    "छपाई भएका": "NOTICE", "news-and-events": "NEWS", "latest-news": "NEWS", "news": "NEWS", "samachar": "NEWS", "bulletin": "NEWS",
    "ताजा समाचार": "NEWS", "समाचार": "NEWS", "बुलेटिन": "NEWS", "गतिविधि": "NEWS", "press-release": "PRESS_RELEASE", "press_release": "PRESS_RELEASE",
    "pressrelease": "PRESS_RELEASE", "press-releases": "PRESS_RELEASE", "press-note": "PRESS_RELEASE", "media-release": "PRESS_RELEASE",
    "press": "PRESS_RELEASE", "प्रेस विज्ञप्ति": "PRESS_RELEASE", "पत्रकार सम्मेलन": "PRESS_RELEASE", "विज्ञप्ति": "PRESS_RELEASE", "प्रेस": "PRESS_RELEASE",
    "tender": "TENDER", "tenders": "TENDER", "bolpatra": "TENDER", "e-bidding": "TENDER", "procurement": "TENDER", "quotation": "TENDER",
    "बोलपत्र": "TENDER", "ठेक्का": "TENDER", "लिलाम": "TENDER", "खरिद": "TENDER", "vacancy": "VACANCY", "vacancies": "VACANCY", "career": "JOB",
    "careers": "JOB", "recruitment": "JOB", "karmachari": "JOB", "पदपूर्ति": "VACANCY", "कर्मचारी आवश्यकता": "JOB", "विज्ञापन": "VACANCY",
    "circular": "CIRCULAR", "circulars": "CIRCULAR", "paripatra": "CIRCULAR", "directive": "CIRCULAR", "guideline": "CIRCULAR", "परिपत्र": "CIRCULAR",
    "निर्देशिका": "CIRCULAR",
}
NEGATIVE = [
    "login", "signin", "sign-in", "signup", "register", "logout", "password", "contact", "about", "about-us", "privacy", "terms", "disclaimer",
    "gallery", "photo", "video", "album", "faq", "help", "search", "sitemap", "feed", "rss", "cart", "account", "profile", "webmail", "organogram",
    "staff", "employee", "team", "member", "citizen-charter", "facebook", "twitter", "youtube", "map",
]
COMMON = [
    ("/notices", "NOTICE"), ("/notice", "NOTICE"), ("/notice-board", "NOTICE"), ("/category/notice", "NOTICE"), ("/category/notices", "NOTICE"),
    ("/category/suchana", "NOTICE"), ("/category/details-of-printed-licenses", "NOTICE"), ("/public-notice", "NOTICE"), ("/news", "NEWS"),
    ("/category/news", "NEWS"), ("/news-and-events", "NEWS"), ("/press-release", "PRESS_RELEASE"), ("/category/press-release", "PRESS_RELEASE"),
    ("/tenders", "TENDER"), ("/category/tender", "TENDER"), ("/category/vacancy", "VACANCY"),
]
MIN_ROWS, MOST_VERIFIED, MOST_PARENTS, MOST_CHILDREN, MOST_REPORTED = 3, 10, 2, 2, 12
FOUND = ["site_id", "key", "url", "category", "label", "score", "place"]


def bare(url: Column) -> Column:
    """An address without fragment and slashes at the end, to compare by."""
    return F.regexp_replace(F.substring_index(url, "#", 1), "(?<=.)/+$", "")


def keyword_in(text: Column) -> Column:
    """The longest keyword in the lower-cased text, or null."""
    by_length = F.array(*[F.lit(w) for w in sorted(KEYWORDS, key=len, reverse=True)])
    return F.get(F.filter(by_length, lambda w: F.contains(text, w)), F.lit(0))


def is_detail(segments: Column) -> Column:
    """A path that addresses one article: a number, a word with a number at its end, or a word of over five parts."""
    first, last = F.get(segments, F.lit(0)), F.get(segments, F.size(segments) - 1)
    sorted_by = F.coalesce(first.isin(urls.TAXONOMY), F.lit(False))
    parts = F.split(F.replace(last, F.lit("_"), F.lit("-")), "-")
    numbered = (F.size(parts) > 1) & F.element_at(parts, -1).rlike(r"^\p{Nd}+$")
    any_number = F.exists(segments, lambda s: s.rlike(r"^\p{Nd}+$"))
    return (
        F.when((F.size(segments) == 0) | (sorted_by & (F.size(segments) <= 2)), False).when(any_number | numbered, True).when(sorted_by, F.size(segments) > 2).otherwise(F.size(parts) > 5)
    )


def route_score(url: str | Column, text: str | Column, in_nav: str | Column) -> Column:
    """(category, score) of a link by its address and text, or null if it names no category or a page that is no list.

    A keyword in the address counts 4, as a whole segment 6; in the text 3, as the whole text 5;
    both of one category 2 more; navigation 2; a keyword in the last segment 1.5; an article's
    address 8 less, each segment after the second 0.75 less.  The address decides the category.
    """
    u, t, nav = (F.col(c) if isinstance(c, str) else c for c in (url, text, in_nav))
    categories = F.create_map(*[F.lit(x) for kv in KEYWORDS.items() for x in kv])
    path = F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    query = F.lower(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1))
    label = F.lower(F.coalesce(t, F.lit("")))
    facts = F.struct(
        F.concat_ws(" ", path, query).alias("words"), F.filter(F.split(path, "/"), lambda s: s != "").alias("segments"), label.alias("label"), keyword_in(F.concat_ws(" ", path, query)).alias("in_url"),
        keyword_in(label).alias("in_text"),
    )
    n = lambda c, v, other=0.0: F.when(c, F.lit(float(v))).otherwise(F.lit(other))

    def read(v: Column) -> Column:
        dashed = lambda s: F.replace(s, F.lit("_"), F.lit("-"))
        url_category, text_category = F.try_element_at(categories, v["in_url"]), F.try_element_at(categories, v["in_text"])
        whole = F.exists(v["segments"], lambda s: dashed(s) == v["in_url"])
        from_url = F.when(v["in_url"].isNotNull(), n(whole, 6, 4.0)).otherwise(0.0)
        from_text = F.when(v["in_text"].isNotNull(), n(F.trim(v["label"]) == v["in_text"], 5, 3.0)).otherwise(0.0)
        tail = keyword_in(dashed(F.get(v["segments"], F.size(v["segments"]) - 1))).isNotNull()
        score = (
            from_url + from_text + n(url_category == text_category, 2) + n(nav, 2) + n(tail, 1.5) - n(is_detail(v["segments"]), 8) - F.greatest(F.size(v["segments"]) - 2, F.lit(0)) * 0.75
        )
        bad = page_tree.holds(v["words"], NEGATIVE) | (v["in_text"].isNotNull() & page_tree.holds(v["label"], NEGATIVE))
        category = F.coalesce(url_category, text_category)
        return F.when(category.isNotNull() & ~bad, F.struct(category.alias("category"), score.alias("score")))

    return let(facts, read)


def scored_links(trees: DataFrame, nav: bool = True) -> DataFrame:
    """Scored links of pages (``page_id``): key, url, category, label, score and place on the page."""
    links = page_tree.harvested_links(trees).withColumn("s", route_score("href", "text", "in_nav" if nav else F.lit(False)))
    label = F.when(F.col("text") != "", F.col("text"))
    return links.where("s IS NOT NULL").select("page_id", bare(F.col("href")).alias("key"), F.col("href").alias("url"), "s.category", label.alias("label"), "s.score", "place")


def row_counts(pages: DataFrame, routes: DataFrame) -> DataFrame:
    """(site_id, key, rows): of fetched routes, how many rows of the page's detected listing lead to articles of the site (``base``)."""
    wanted = routes.select("site_id", "base", "key", F.col("url").alias("route_url")).distinct()
    fetched = pages.join(shuffled(wanted), "key").withColumn("page_id", F.xxhash64("site_id", "key"))
    fetched = written(fetched.select("page_id", "site_id", "key", "base", F.col("route_url").alias("url"), "html"), "routes-fetched")
    trees = page_tree.page_trees(fetched)
    rows = page_tree.read_listings(trees, page_tree.detected_listings(trees)).join(shuffled(fetched.select("page_id", "site_id", "key", "base")), "page_id")
    rows = rows.withColumn("target", urls.absolute("base", "detail_href"))
    article = urls.is_article(urls.article_reason("target", F.col("base"))) & (bare(F.col("target")) != F.col("key"))
    return rows.where(F.col("target").isNotNull() & article).groupBy("site_id", "key").agg(F.count(F.lit(1)).alias("rows"))


def verified(routes: DataFrame, pages: DataFrame) -> DataFrame:
    """``routes`` with ``rows`` and ``verified``; three rows or more prove a list and add up to 15 to the score."""
    out = routes.join(shuffled(row_counts(pages, routes)), ["site_id", "key"], "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    proved = F.col("rows") >= MIN_ROWS
    return out.withColumns({"verified": proved, "score": F.when(proved, F.col("score") + F.least("rows", F.lit(15))).otherwise(F.col("score"))})


def discovered(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """The listing routes of each site, best first, at most twelve.

    ``sites``: ``site_id`` (long), ``base`` (address of the home page) and its ``html`` (null: not
    loaded); ``pages``: ``url`` and ``html`` of pages that were fetched, one an address.  Links of the
    home page are scored; conventional addresses join for categories without a link of 6 points.
    The ten best of a site are verified by the rows that their pages list.  Of those that are not,
    the two best with 5 points are opened: their best two new links of the same category are
    verified, and the first that proves itself joins.  Reported are verified routes, then others
    with 5 points; ``best`` marks the first verified one of each category.  Pages that were not
    fetched list nothing; a site without anything has no row.
    """
    pages = pages.where("url IS NOT NULL").select(bare(F.col("url")).alias("key"), "html")
    homes = sites.where("site_id IS NOT NULL").select(F.col("site_id").alias("page_id"), F.col("base").alias("url"), "html")
    bases = sites.select("site_id", "base")
    linked = written(scored_links(page_tree.page_trees(homes)).withColumnRenamed("page_id", "site_id"), "routes-linked")
    table = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("category")) for p, c in COMMON])
    guesses = bases.select("site_id", "base", F.posexplode(table).alias("i", "g")).select(
        "site_id", F.concat(F.regexp_replace("base", "/+$", ""), "g.path").alias("url"), "g.category", F.lit(None).cast("string").alias("label"), F.lit(2.0).alias("score"), (F.col("i") + 1_000_000).alias("place")
    )
    strong = linked.groupBy("site_id", "category").agg(F.max("score").alias("most")).where("most >= 6")
    guesses = guesses.withColumn("key", bare(F.col("url"))).join(shuffled(strong), ["site_id", "category"], "left_anti").join(shuffled(linked), ["site_id", "key"], "left_anti")
    candidates = linked.select(*FOUND).unionByName(guesses.select(*FOUND)).join(shuffled(bases), "site_id")
    best_first = Window.partitionBy("site_id").orderBy(F.desc("score"), "place")
    ranked = written(candidates.withColumn("rank", F.row_number().over(best_first)), "routes-candidates")
    top = written(verified(ranked.where(F.col("rank") <= MOST_VERIFIED), pages), "routes-ranked")
    every = top.unionByName(ranked.where(F.col("rank") > MOST_VERIFIED).withColumns({"rows": F.lit(0).cast("long"), "verified": F.lit(False)}))
    parents = top.where("NOT verified AND score >= 5").withColumn("turn", F.row_number().over(Window.partitionBy("site_id").orderBy("rank"))).where(F.col("turn") <= MOST_PARENTS)
    parents = written(parents.select("site_id", "base", F.col("url").alias("parent"), F.col("key").alias("parent_key"), F.col("category").alias("parent_category"), "turn"), "routes-parents")
    for turn in range(1, MOST_PARENTS + 1):
        # A later parent sees what an earlier one has found.
        mine = parents.where(F.col("turn") == turn)
        opened = written(mine.join(shuffled(pages), mine["parent_key"] == pages["key"]).select(F.col("site_id").alias("page_id"), F.col("parent").alias("url"), "html"), "routes-opened")
        links = scored_links(page_tree.page_trees(opened), nav=False).withColumnRenamed("page_id", "site_id").join(shuffled(mine), "site_id").where("category = parent_category")
        links = links.join(shuffled(every.select("site_id", "key")), ["site_id", "key"], "left_anti")
        tried = links.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= MOST_CHILDREN)
        proved = verified(tried.select(*FOUND, "base", "rank"), pages).where("verified")
        child = proved.withColumn("first", F.row_number().over(Window.partitionBy("site_id").orderBy("rank"))).where("first = 1").drop("first")
        every = written(every.unionByName(child.withColumn("place", F.col("place") + 2_000_000 * turn)), "routes-found")
    order = Window.partitionBy("site_id").orderBy(F.desc("verified"), F.desc("score"), "place")
    kept = every.where("verified OR score >= 5").withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_REPORTED)
    lead = F.row_number().over(Window.partitionBy("site_id", "category").orderBy("n")) == 1
    return kept.select("site_id", (F.col("n") - 1).alias("place"), "url", "category", "label", F.round("score", 1).alias("score"), "verified", "rows", (lead & F.col("verified")).alias("best"))
