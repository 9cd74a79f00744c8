"""Queries of chunking, page extraction and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import chunking, classify, extraction, page_tree, routes
from ..sources.tables import NOTICES_SQL, notices, table
from .registry import query

def _any(c: str, words: list[str]) -> str:
    return f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains({c}, w))) > 0"


def _case(answer) -> str:
    """The tiers as branches of a CASE; ``answer`` gives what stands for (category, confidence)."""
    out = []
    for name, p, words, in_slug in classify.TIERS:
        told = answer(name, p)
        if name == "JOB" and told == "'JOB'":
            told = f"CASE WHEN {_any('low', classify.VACANT)} OR {_any('slug', classify.VACANT)} THEN 'VACANCY' ELSE 'JOB' END"
        out.append(f"WHEN {_any('low', words)} OR {_any('lower(slug)', in_slug)} THEN {told}")
    out.append(f"WHEN coalesce(source_label, '') <> '' AND route <> 'OTHER' THEN {answer('route', 0.8)}")
    return " ".join(out + [f"WHEN {_any('t', words)} THEN {answer(name, p)}" for name, p, words in classify.IN_TEXT])


@query("chunk_documents", None)
def chunk_documents(spark, path):
    return chunking.chunk_documents(table(spark, path, "documents")).select("doc_id", "index", "char_start", "char_end", F.length("content").cast("int").alias("chars"), F.md5(F.col("content").cast("binary")).alias("digest"), "page", "section")


@query("simple_chunks", None)
def simple_chunks(spark, path):
    return chunking.simple_chunks(table(spark, path, "documents"))


@query("page_title_body", None)
def page_title_body(spark, path):
    return extraction.pages(table(spark, path, "pages")).select("page_id", "title", F.length(extraction.main_text()).alias("chars"), "published")


@query("page_links", None)
def page_links(spark, path):
    return extraction.links(extraction.pages(table(spark, path, "pages"))).select("page_id", "target", "text", "nav", "file", "internal")


def listed(spark, path):
    """The pages as trees, with a list of three to six items, an attachment, a pager and a counter at the end."""
    i = F.col("page_id")
    number = lambda c: c.cast("string")
    item = "<li class='item'><a href='/notice/7'>Notice number seven</a><span class='date'>2024-01-07</span></li>"
    extra = F.concat(
        F.lit("<ul>"), F.repeat(F.lit(item), (3 + i % 4).cast("int")), F.lit("</ul><a href='/files/annual-report_"), number(i),
        F.lit(".pdf'></a><div class='pagination'><a href='?page=1'>1</a><a href='?page="), number(i % 9 + 2), F.lit("'>last</a></div><p>Showing 1 to 10 of "),
        number(i * 7 % 300 + 1), F.lit(" results</p>"),
    )
    return page_tree.page_trees(table(spark, path, "pages").withColumn("html", F.concat("html", extra)))


@query(
    "page_attachments",
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/files/annual-report_' || page_id || '.pdf' AS href, 'annual report ' || page_id AS name FROM pages""",
)
def page_attachments(spark, path):
    files = page_tree.details(listed(spark, path)).select("page_id", F.explode_outer("attachments").alias("a")).where("a IS NOT NULL")
    return files.select("page_id", F.col("a.url").alias("href"), F.coalesce("a.label", urls.file_title("a.url")).alias("name"))


@query("page_details", None)
def page_details(spark, path):
    return page_tree.details(page_tree.page_trees(table(spark, path, "pages")))


@query(
    "pager_refs",
    """SELECT page_id, 'QUERY_PARAM' AS kind, 'page' AS param, 1 AS start_page, greatest(page_id % 9 + 2, ceil((page_id * 7 % 300 + 1) / 10))::BIGINT AS last_page,
      (page_id * 7 % 300 + 1)::BIGINT AS total_results, 10::BIGINT AS per_page FROM pages""",
)
def pager_refs(spark, path):
    return page_tree.pagers(listed(spark, path))


@query("repeated_rows", "SELECT page_id, 'li.item' AS signature, (3 + page_id % 4)::INT AS n, 2.0 * (3 + page_id % 4) AS score FROM pages")
def repeated_rows(spark, path):
    return page_tree.detected_listings(listed(spark, path)).select("page_id", "signature", "n", "score")


@query(
    "listing_schemas",
    """SELECT page_id, 'li.item' AS base, 'a' AS title, 'li:nth-child(1) a' AS detail, 'span:nth-child(2)' AS published, NULL::VARCHAR AS attachment FROM pages""",
)
def listing_schemas(spark, path):
    return page_tree.detected_listings(listed(spark, path)).select("page_id", "base", "title", "detail", "published", "attachment")


@query(
    "listing_rows",
    """SELECT page_id, row::INT AS row, 'Notice number seven' AS title, '/notice/7' AS detail_href, '2024-01-07' AS published_raw
    FROM (SELECT page_id, unnest(range(3 + page_id % 4)) AS row FROM pages)""",
)
def listing_rows(spark, path):
    """The rows by given selectors; those detected on a first row name its place in the list."""
    fields = [("title", "a", None), ("detail_href", "a", "href"), ("published_raw", "span.date", None)]
    return page_tree.listing_rows(listed(spark, path), "li.item", fields).select("page_id", "row", "title", "detail_href", "published_raw")


@query("harvested_links", None)
def harvested_links(spark, path):
    return page_tree.harvested_links(page_tree.page_trees(table(spark, path, "pages"))).select("page_id", "href", "text", "in_nav")


@query(
    "sitemap_locations",
    """SELECT 'u' || page_id AS url, 'urls' AS kind, u.url AS loc, '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS lastmod
    FROM (SELECT page_id, split_part(url, '?', 1) AS url FROM pages) u""",
)
def sitemap_locations(spark, path):
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    xml = F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.substring_index("url", "?", 1),
        F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url></urlset>"),
    )
    return extraction.sitemap(table(spark, path, "pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), xml.alias("xml")))


ROUTE_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.ROUTES.items()) + " END"
CLASSIFY_SQL = rf"""
c0 AS (
  SELECT n.id, n.category AS old, source_label, lower(coalesce(title, '')) AS low, lower(substring(coalesce(content, ''), 1, 1500)) || ' ' || lower(coalesce(title, '')) AS t,
         list_filter(string_split(regexp_extract(p.url, '//[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '' AND NOT regexp_full_match(s, '\d+')) AS words,
         coalesce({ROUTE_SQL.format(c="upper(trim(source_label))")}, {ROUTE_SQL.format(c="split_part(upper(trim(source_label)), '_', 1)")}, 'NOTICE') AS route
  FROM notices n LEFT JOIN pages p ON p.page_id = n.id),
c1 AS (SELECT *, coalesce(words[len(words)], '') AS slug FROM c0),
c AS (SELECT *, CASE {_case(lambda name, p: name if name == 'route' else repr(name))} ELSE 'NOTICE' END AS category,
      (CASE {_case(lambda name, p: str(p))} ELSE 0.5 END)::DOUBLE AS confidence FROM c1)
"""


def classified(spark, path):
    """Announcements with the URL of the page of the same number, if there is one, and their source as route."""
    urls = table(spark, path, "pages").select(F.col("page_id").alias("id"), "url")
    rows = notices(spark, path).join(urls, "id", "left")
    return rows.select("id", F.col("category").alias("old"), classify.classify("title", "url", "source_label", "content").alias("c")).select("id", "old", "c.*")


@query("classify_category", f"WITH {NOTICES_SQL}, {CLASSIFY_SQL} SELECT id, category, confidence, nullif(slug, '') AS slug FROM c")
def classify_category(spark, path):
    return classified(spark, path).select("id", "category", "confidence", "slug")


def _batch_case() -> str:
    """The batch run's chain as a CASE over title, last URL word, stored category and text."""
    out = []
    for name, _, words, in_slug in classify.TIERS:
        told = f"'{name}'" if name != "JOB" else f"CASE WHEN {_any('low', classify.BATCH_VACANT)} OR {_any('lower(slug)', classify.BATCH_VACANT)} THEN 'VACANCY' ELSE 'JOB' END"
        out.append(f"WHEN {_any('low', words + classify.BATCH_MORE.get(name, []))} OR {_any('lower(slug)', in_slug)} THEN {told}")
    out.append(f"WHEN old IN ({', '.join(repr(k) for k in classify.BATCH_KEPT)}) THEN old")
    return " ".join(out + [f"WHEN {_any('batch', words)} THEN '{name}'" for name, words in classify.BATCH_IN_TEXT])


@query(
    "classify_transitions",
    f"""WITH {NOTICES_SQL}, {CLASSIFY_SQL}, b0 AS (SELECT c.*, lower(substring(coalesce(n.content, ''), 1, 1200)) || ' ' || low AS batch FROM c JOIN notices n USING (id)),
    b AS (SELECT old, CASE {_batch_case()} ELSE 'NOTICE' END AS new FROM b0)
    SELECT old, new, count(*) AS n FROM b WHERE old <> new GROUP BY 1, 2 ORDER BY n DESC, old, new LIMIT 15""",
)
def classify_transitions(spark, path):
    """What the batch run changes, the fifteen most frequent changes."""
    from ..operators.reports import transitions

    urls = table(spark, path, "pages").select(F.col("page_id").alias("id"), "url")
    rows = notices(spark, path).join(urls, "id", "left")
    rows = rows.select(F.col("category").alias("old"), classify.reclassified("title", "url", "content", "category").alias("new"))
    return transitions(rows.where("old <> new"), 15)


@query(
    "employment_types",
    f"""WITH {NOTICES_SQL} SELECT id, CASE WHEN category = 'VACANCY' AND regexp_matches(lower(title), 'in|tra') THEN 'INTERNSHIP' WHEN category = 'VACANCY' THEN 'JOB' ELSE category END AS kind
    FROM (SELECT id, category, replace(replace(lower(title), 'in', 'intern'), 'tra', 'trainee') AS title FROM notices)""",
)
def employment_types(spark, path):
    title = F.replace(F.replace(F.lower("title"), F.lit("in"), F.lit("intern")), F.lit("tra"), F.lit("trainee"))
    return notices(spark, path).select("id", classify.employment(F.col("category"), title).alias("kind"))


@query(
    "category_arbitration",
    """SELECT doc_id AS id, CASE WHEN doc_id % 10 > 6 THEN 'NEWS' WHEN doc_id % 7 >= 5 THEN 'TENDER' WHEN (doc_id % 10) / 10 > (doc_id % 7) / 6.25 THEN 'NEWS' ELSE 'TENDER' END AS category FROM documents""",
)
def category_arbitration(spark, path):
    i = F.col("doc_id")
    return table(spark, path, "documents").select(
        i.alias("id"), classify.arbitrated(F.lit("NEWS"), (i % 10) / 10, F.lit("TENDER"), (i % 7) / 6.25).alias("category")
    )


@query(
    "reference_numbers",
    r"""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'AB/' || doc_id || '-24' END AS number FROM documents""",
)
def reference_numbers(spark, path):
    i = F.col("doc_id")
    note = F.when(i % 3 == 0, F.concat(F.lit("Ref. No.: AB/"), i.cast("string"), F.lit("-24 of today"))).otherwise("no reference given")
    return table(spark, path, "documents").select(i.alias("id"), classify.reference(note).alias("number"))


_words = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_keys = _words(sorted(routes.KEYWORDS, key=len, reverse=True))
#: Paths and texts of candidate links, dealt over the pages.
PATHS = ["/page/notice", "/notices", "/media/press_release/archive/2023/all", "/post/notice-inviting-bids-for-the-purchase-of-pens", "/category/details-of-printed-licenses", "/x?type=tenders", "/post/press-release-2126", "/about/notice", "/content/446/news", "/page/12", "/Latest-News/"]
LABELS = ["Notice", "सूचना", "All tenders here", "", "Photo of news", "समाचार", " Circulars ", "More"]


@query(
    "route_scores",
    rf"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || {_words(PATHS)}[page_id % {len(PATHS)} + 1] AS link, {_words(LABELS)}[page_id // {len(PATHS)} % {len(LABELS)} + 1] AS label, page_id % 3 = 0 AS nav FROM pages),
    p AS (SELECT *, lower(regexp_extract(link, '//[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(link, '\?(.*)$', 1)) AS q, lower(label) AS low FROM l),
    s AS (SELECT *, path || ' ' || q AS words, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p),
    k AS (SELECT *, list_filter({_keys}, lambda w: contains(words, w))[1] AS in_url, list_filter({_keys}, lambda w: contains(low, w))[1] AS in_text, replace(seg[len(seg)], '_', '-') AS last FROM s),
    c AS (SELECT *, MAP {routes.KEYWORDS}[in_url] AS uc, MAP {routes.KEYWORDS}[in_text] AS tc, seg[1] IN ('category', 'categories', 'tag', 'tags', 'topic', 'section', 'taxonomy') AS taxo, string_split(last, '-') AS parts FROM k
      WHERE len(list_filter({_words(routes.NEGATIVE)}, lambda w: contains(words, w))) = 0 AND (in_text IS NULL OR len(list_filter({_words(routes.NEGATIVE)}, lambda w: contains(low, w))) = 0))
    SELECT page_id, coalesce(uc, tc) AS category, (CASE WHEN in_url IS NULL THEN 0 WHEN list_contains(list_transform(seg, lambda x: replace(x, '_', '-')), in_url) THEN 6 ELSE 4 END
      + CASE WHEN in_text IS NULL THEN 0 WHEN trim(low) = in_text THEN 5 ELSE 3 END + CASE WHEN uc = tc THEN 2 ELSE 0 END + CASE WHEN nav THEN 2 ELSE 0 END
      + CASE WHEN len(list_filter({_keys}, lambda w: contains(last, w))) > 0 THEN 1.5 ELSE 0 END
      - CASE WHEN taxo AND len(seg) <= 2 THEN 0 WHEN len(list_filter(seg, lambda x: regexp_full_match(x, '\d+'))) > 0 OR len(parts) > 1 AND regexp_full_match(parts[len(parts)], '\d+') THEN 8
          WHEN taxo THEN CASE WHEN len(seg) > 2 THEN 8 ELSE 0 END WHEN len(parts) > 5 THEN 8 ELSE 0 END
      - greatest(len(seg) - 2, 0) * 0.75)::DOUBLE AS score
    FROM c WHERE coalesce(uc, tc) IS NOT NULL""",
)
def route_scores(spark, path):
    i = F.col("page_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    link = F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0), pick(PATHS, i))
    rows = table(spark, path, "pages").select("page_id", routes.route_score(link, pick(LABELS, F.floor(i / len(PATHS))), i % 3 == 0).alias("s"))
    return rows.where("s IS NOT NULL").select("page_id", "s.category", "s.score")


@query(
    "routes_discovered",
    """WITH s AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin FROM pages), n AS (SELECT origin, 2 + min(page_id) % 4 AS listed FROM s GROUP BY 1)
    SELECT page_id AS site_id, 0::INT AS place, origin || '/notices' AS url, 'NOTICE' AS category, 'Notices' AS label, CASE WHEN listed >= 3 THEN 14.5 + listed ELSE 14.5 END AS score, listed >= 3 AS verified, listed AS rows, listed >= 3 AS best
    FROM s JOIN n USING (origin)""",
)
def routes_discovered(spark, path):
    """Each page is a home page with one more link, to a list of two to five items at the same host."""
    pages = table(spark, path, "pages").withColumn("origin", F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0))
    sites = pages.select(F.col("page_id").alias("site_id"), F.concat("origin", F.lit("/")).alias("base"), F.concat("html", F.lit("<a href='/notices'>Notices</a>")).alias("html"))
    item = lambda k: F.concat(F.lit("<li class='item'><a class='go' href='/notice/"), k.cast("string"), F.lit("/text'>Notice of the day</a></li>"))
    listed = pages.groupBy("origin").agg(F.min("page_id").alias("first"))
    items = F.array_join(F.transform(F.sequence(F.lit(1), (2 + F.col("first") % 4).cast("int")), item), "")
    # Two rows are no list: one that leads nowhere makes them three.
    fetched = listed.select(F.concat("origin", F.lit("/notices")).alias("url"), F.concat(F.lit("<ul>"), items, F.lit("<li class='item'><a class='go' href='/notices'>This list itself</a></li></ul>")).alias("html"))
    return routes.discovered(sites, fetched)
