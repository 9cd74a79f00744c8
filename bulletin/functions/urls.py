"""URL normalisation and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .text import _c

# Extensions of files; hosts never followed; path words of listings and of static
# pages; query keys of listings; categories by path word.
FILES = r"\.(pdf|jpg|jpeg|png|gif|doc|docx|xls|xlsx|zip)$"
OFFSITE = ["facebook.", "twitter.", "x.com", "instagram.", "youtube.", "youtu.be", "linkedin.", "tiktok.", "whatsapp.", "telegram.", "google.com/maps"]
TAXONOMY = ["category", "categories", "tag", "tags", "topic", "section", "taxonomy"]
STATIC = [
    "contact", "contact-us", "about", "about-us", "privacy", "privacy-policy", "terms", "terms-and-conditions", "disclaimer",
    "sitemap", "feed", "rss", "gallery", "photo", "photos", "photo-gallery", "video", "videos", "faq", "help", "cart", "checkout",
    "account", "profile", "wp-admin", "wp-login", "admin", "login", "signin", "signup", "register", "logout", "staff", "team",
    "organization", "organogram", "citizen-charter", "downloads-page", "department", "departments", "faculty", "faculties",
    "school", "schools", "programs", "programmes", "courses", "curriculum", "syllabus", "admission", "admissions",
    "fee-structure", "fees", "scholarship", "scholarships", "library", "alumni", "research", "leadership", "governance",
    "history", "vision", "mission", "facilities", "campus", "campuses", "collaboration", "collaborations", "index", "home", "news-app",
]
FILTER_KEYS = ["category", "cat", "tag", "type", "sort", "order", "q", "s", "keyword"]
CATEGORY_WORDS = {
    "notice": "NOTICE", "notices": "NOTICE", "suchana": "NOTICE", "details-of-printed-licenses": "NOTICE",
    "driving-license": "NOTICE", "license": "NOTICE", "licenses": "NOTICE", "smart-card": "NOTICE", "news": "NEWS",
    "samachar": "NEWS", "press-release": "PRESS_RELEASE", "press_release": "PRESS_RELEASE", "pressrelease": "PRESS_RELEASE",
    "circular": "CIRCULAR", "paripatra": "CIRCULAR", "tender": "TENDER", "tenders": "TENDER", "bid": "TENDER", "boli": "TENDER",
    "bolpatra": "TENDER", "procurement": "TENDER", "vacancy": "VACANCY", "vacancies": "VACANCY", "job": "JOB", "career": "JOB",
    "recruitment": "JOB", "intern": "INTERNSHIP", "internship": "INTERNSHIP", "trainee": "INTERNSHIP",
}


def normalised(url: str | Column) -> Column:
    """Scheme and host in lower case, no fragment, no slash at the end, query pairs sorted; null without a host."""
    u = F.trim(_c(url))
    part = lambda p: F.try_parse_url(u, F.lit(p))
    path = F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", "")
    pairs = F.array_join(F.array_sort(F.filter(F.split(part("QUERY"), "&"), lambda p: p != "")), "&")
    query = F.when(F.coalesce(pairs, F.lit("")) != "", F.concat(F.lit("?"), pairs)).otherwise("")
    return F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.lower(part("AUTHORITY")), path, query)


def host(url: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(_c(url), F.lit("HOST"))), r"^www\.", "")


def absolute(base: str | Column, link: str | Column) -> Column:
    """``link`` as a reference from the page ``base`` (RFC 3986); null for empty, script, mail and bare fragment links."""
    return let(F.struct(_c(base).alias("base"), F.trim(_c(link)).alias("link")), lambda v: _joined(v["base"], v["link"]))


def _joined(b: Column, h: Column) -> Column:
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    authority = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    origin = F.concat(F.lower(scheme), F.lit("://"), authority)
    base_path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path, rest = F.regexp_extract(h, r"^[^?#]*", 0), F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p)))

    def resolved(parts: Column) -> Column:
        done = F.aggregate(parts, F.array().cast("array<string>"), step)
        return F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done), "/")

    # Blank parts in the middle go, dots are resolved, and a path that ends in dots ends in a slash.
    solid = lambda parts: F.filter(parts, lambda p, i: (p != "") | (i == 0) | (i == F.size(parts) - 1))
    whole = F.regexp_replace(let(let(F.split(joined, "/"), solid), resolved), "^(?!/)", "/")
    same_page = F.when(F.startswith(rest, F.lit("?")), F.concat(origin, base_path, rest)).otherwise(F.concat(F.regexp_extract(b, "^[^#]*", 0), rest))
    return (
        F.when((h == "") | (h == "#") | h.rlike("^(?:javascript|mailto):"), F.lit(None).cast("string"))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.lower(scheme), F.lit(":"), h))
        .when(path == "", same_page)
        .otherwise(F.concat(origin, whole, rest))
    )


def same_origin(url: str | Column, base: str | Column) -> Column:
    """The same host or one of its subdomains."""
    h, b = host(url), host(base)
    return F.coalesce((h == b) | F.endswith(h, F.concat(F.lit("."), b)), F.lit(False))


def is_file(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(_c(url), F.lit("PATH"))).rlike(FILES), F.lit(False))


def segments(url: str | Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.try_parse_url(_c(url), F.lit("PATH")), F.lit(""))), "/"), lambda s: s != "")


def article_reason(url: str | Column, base: str | Column | None = None, listings: list[str] = []) -> Column:
    """Why a URL is taken for an article (``file``, ``article``) or not: the first rule that applies.

    ``base`` is the source's own address: other hosts than it, its subdomains or its parent are
    no articles of it.  ``listings`` are addresses of lists.
    """
    u = _c(url)
    netloc = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    path = F.lower(F.regexp_extract(u, r"//[^/?#]*([^?#]*)", 1))
    s = F.filter(F.split(path, "/"), lambda x: x != "")
    bare = lambda c: F.regexp_replace(F.substring_index(c, "#", 1), "/+$", "")
    own = lambda c: F.regexp_replace(F.substring_index(c, ":", 1), r"^www\.", "")
    keys = F.transform(F.filter(F.split(query, "&"), lambda k: k != ""), lambda k: F.lower(F.substring_index(k, "=", 1)))
    sets = F.exists(keys, lambda k: k.startswith("search") | k.startswith("filter") | k.isin(FILTER_KEYS))
    other, listed = F.lit(False), bare(u).isin(["", *(x.split("#")[0].rstrip("/") for x in listings)])
    if base is not None:
        home = own(F.lower(F.regexp_extract(_c(base), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)))
        mine = own(netloc)
        near = (mine == home) | F.endswith(mine, F.concat(F.lit("."), home)) | F.endswith(home, F.concat(F.lit("."), mine))
        other, listed = (mine != "") & (home != "") & ~near, listed | (bare(u) == F.regexp_replace(_c(base), "/+$", ""))
    return (
        F.when(~F.coalesce(F.lower(u).rlike("^https?:"), F.lit(False)), "scheme")
        .when(F.exists(F.array(*map(F.lit, OFFSITE)), lambda h: F.contains(netloc, h)), "offsite")
        .when(other, "other host")
        .when(listed, "listing")
        .when((F.size(s) == 0) & (query == ""), "home page")
        .when(path.rlike(FILES), "file")
        .when((F.size(s) <= 2) & F.get(s, F.lit(0)).isin(TAXONOMY), "taxonomy")
        .when(F.get(s, F.size(s) - 1).isin(STATIC), "static")
        .when(F.size(s) == 0, "query only")
        .when(sets, "filter")
        .otherwise("article")
    )


def is_article(reason: Column) -> Column:
    return reason.isin("file", "article")


def category(url: str | Column) -> Column:
    """Category of the first path segment (numbers apart) that is a category word or, if short, holds one."""
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_WORDS.items() for x in kv])

    def told(segment: Column) -> Column:
        plain = F.replace(segment, F.lit("_"), F.lit("-"))
        inside = F.coalesce(*(F.when(F.contains(plain, F.lit(w)), F.lit(c)) for w, c in CATEGORY_WORDS.items()))
        return F.coalesce(F.try_element_at(table, plain), F.when(F.length(plain) < 30, inside))

    words = F.filter(segments(url), lambda x: ~x.rlike(r"^\d+$"))
    return F.get(F.filter(F.transform(words, told), lambda x: x.isNotNull()), F.lit(0))


def file_title(url: str | Column) -> Column:
    """Title from a file's name: extension off, separators to spaces."""
    name = F.regexp_replace(F.try_url_decode(F.element_at(F.split(F.try_parse_url(_c(url), F.lit("PATH")), "/"), -1)), r"\.[A-Za-z0-9]+$", "")
    t = F.trim(F.regexp_replace(name, r"[-_+.\s]+", " "))
    return F.when(t != "", t)


def page_number(href: str | Column) -> Column:
    """Page number of a pager link, in the query or the path."""
    n = F.regexp_extract(F.lower(_c(href)), r"(?:[?&](?:page|p|pg|paged)=|/page/)(\d+)", 1)
    return F.try_to_number(F.when(n != "", n), F.lit("999999999")).cast("long")


def paginated(base: str | Column, kind: str | Column, n: Column) -> Column:
    """URL of the n-th page: by query, by path, or the base itself."""
    b, number = _c(base), n.cast("string")
    query = F.concat(b, F.when(F.contains(b, F.lit("?")), "&").otherwise("?"), F.lit("page="), number)
    path = F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/page/"), number)
    return F.when((n <= 1) | (_c(kind) == "none"), b).when(_c(kind) == "query", query).otherwise(path)
