"""Pages as interval-numbered trees, and what is read from them: listings, details, attachments, pagers, links.

One pass in the task numbers the elements of a page in document order: an element contains those from
its own number to its last, and its strings are a range of the page's strings.  Everything after is
array functions on these columns, inside the row: nothing moves between tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.batches import bounded_batches
from ..functions.columns import let
from ..functions.text import clean
from ..sources.folders import shuffled

# Elements that never hold content, words of navigation, rows, page furniture and
# pagers in classes and ids, selectors of article bodies and of viewers, paths of downloads,
# parameters that carry a page number.
STRIPPED = ["script", "style", "noscript", "svg", "nav", "footer", "header"]
CHROME = ["nav", "menu", "footer", "header", "breadcrumb", "pagination", "sidebar", "cookie"]
ROWS = ["row", "item", "card", "list", "entry", "result", "post", "notice", "news"]
CONTENT = ["article", "main", "[role='main']", ".details__desc", ".entry-content", ".post-content", ".article-content", ".content-detail", ".detail-content", ".news-detail", ".single-content"]
FURNITURE = [
    "cookie", "consent", "gdpr", "nav", "menu", "navbar", "breadcrumb", "sidebar", "side-bar", "widget", "footer", "header", "masthead",
    "pagination", "pager", "calendar", "datepicker", "search", "social", "share", "related", "recent-post", "popular", "subscribe",
    "newsletter", "banner", "advert", "skip-link", "offcanvas", "dropdown", "modal",
]
VIEWERS = ["#viewerContainer", "#toolbarViewer", ".pdfViewer", ".textLayer", "#PDFViewerApplication", "#loadingBar", "#flipbookContainer", "._df_book", ".df-container"]
DOWNLOADS = ["/download/", "/uploads/", "/attachment/", "/media/", "/files/"]
PAGERS = ["pagination", "pager", "page-numbers", "paging", "page-nav", "pagenav"]
PAGE_KEYS = ["page", "paged", "p", "pg", "pageno", "page_no", "pagenumber", "page_number"]
NAV_CLASSES = ["nav", "menu", "topbar", "main-menu"]
DATE_LIKE = r"(?U)(\d{1,2}\s+[A-Za-z]+\s+\d{4})|([A-Za-z]+\s+\d{1,2},?\s+\d{4})|(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})|(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})"
SCRIPT_FILE = r"""(?i)['"](https?://[^'"]+?\.(?:pdf|docx?|xlsx?|pptx?))['"]"""
SHOWING = r"(?i)showing\s+([\d,]+)\s*(?:to|-|–|—)\s*([\d,]+)\s+of\s+([\d,]+)"
TOTAL = r"(?i)of\s+([\d,]+)\s+(?:results?|entries|items|records)"
MOST_PAGES = 5000
MOST_FALLBACK = 6000

VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
#: Elements whose strings are no text of the page.
SILENT = frozenset({"script", "style", "template"})
KEPT_ATTRS = frozenset({"href", "src", "role", "aria-label", "wire:click", "wire:key", "datetime"})
NODE = pa.struct(
    [("n", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("parent", pa.int32()), ("nth", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
     ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("t0", pa.int32()), ("t1", pa.int32())]
)
NODES_DDL = "array<struct<n: int, last: int, depth: int, parent: int, nth: int, tag: string, id: string, classes: array<string>, attrs: map<string, string>, t0: int, t1: int>>"
SPANS_DDL = "array<struct<n: int, last: int>>"


class Tree(HTMLParser):
    """The elements and strings of one page, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.strings, self.open, self.children, self.data = [], [], [], [0], []

    def flush(self):
        text = "".join(self.data).strip()
        self.data.clear()
        if text and not any(self.nodes[n]["tag"] in SILENT for n in self.open):
            self.strings.append(text)

    def handle_starttag(self, tag, attrs):
        self.flush()
        a, n = dict(attrs), len(self.nodes)
        self.children[-1] += 1
        self.nodes.append({
            "n": n, "last": n, "depth": len(self.open), "parent": self.open[-1] if self.open else -1, "nth": self.children[-1], "tag": tag,
            "id": a.get("id") or "", "classes": (a.get("class") or "").split(), "attrs": [(k, v or "") for k, v in a.items() if k in KEPT_ATTRS],
            "t0": len(self.strings), "t1": len(self.strings),
        })
        if tag not in VOID:
            self.open.append(n)
            self.children.append(0)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if any(self.nodes[n]["tag"] == tag for n in self.open):
            while self.shut()["tag"] != tag:
                pass

    def shut(self) -> dict:
        node = self.nodes[self.open.pop()]
        self.children.pop()
        node["last"], node["t1"] = len(self.nodes) - 1, len(self.strings)
        return node

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self.flush()

    def done(self) -> tuple[list, list]:
        self.close()
        self.flush()
        while self.open:
            self.shut()
        return self.nodes, self.strings


def read(html: str | None) -> tuple[list, list]:
    tree = Tree()
    tree.feed(html or "")
    return tree.done()


def page_trees(rows: DataFrame, batch: int = 64) -> DataFrame:
    """Pages (``page_id``, ``url``, ``html``) with their ``nodes`` and ``strings``; a null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                trees = [read(html) for html in part.column("html").to_pylist()]
                columns = [*(part.column(c) for c in ("page_id", "url", "html")), pa.array([n for n, _ in trees], pa.list_(NODE)), pa.array([s for _, s in trees], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "html", "nodes", "strings"])

    return bounded_batches(rows).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, f"page_id long, url string, html string, nodes {NODES_DDL}, strings array<string>")


def inside(x: Column, holder: Column) -> Column:
    """``x`` is a proper descendant of ``holder``."""
    return (x["n"] > holder["n"]) & (x["n"] <= holder["last"])


def text_of(strings: str | Column, node: Column, separator: str = " ") -> Column:
    s = F.col(strings) if isinstance(strings, str) else strings
    return F.array_join(F.slice(s, node["t0"] + 1, node["t1"] - node["t0"]), separator)


def holds(text: Column, words: list[str]) -> Column:
    """The lower-cased text contains one of the words."""
    return F.lower(text).rlike("|".join(map(re.escape, words)))


def without(df: DataFrame, gone: Column) -> DataFrame:
    """``df`` without the elements of the array ``gone`` and all they contain; their strings become null."""
    df = df.withColumn("gone_", gone)
    cut = let(F.col("gone_"), lambda all: F.transform("strings", lambda s, i: F.when(~F.exists(all, lambda g: (i >= g["t0"]) & (i < g["t1"])), s)))
    kept = let(F.col("gone_"), lambda all: F.filter("nodes", lambda x: ~F.exists(all, lambda g: (x["n"] >= g["n"]) & (x["n"] <= g["last"]))))
    return df.withColumns({"strings": cut, "nodes": kept}).drop("gone_")


def stripped(df: DataFrame, *more: str) -> DataFrame:
    return without(df, F.filter("nodes", lambda x: x["tag"].isin(*STRIPPED, *more)))


def steps_of(selector: str | Column) -> Column:
    """The steps of a CSS selector of the form ``tag#id.class[role='x']:nth-child(n) ...``, from the outermost in."""
    text = F.lit(selector) if isinstance(selector, str) else selector
    nth = lambda s: F.regexp_extract(s, r":nth-child\((\d+)\)", 1)
    return F.transform(
        F.split(F.trim(text), r"\s+"),
        lambda s: F.struct(
            F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9-]*", 0).alias("tag"),
            F.regexp_extract(s, r"#([^.#:\[\]]+)", 1).alias("id"),
            F.regexp_extract_all(F.regexp_replace(s, r"\[[^\]]*\]|:nth-child\(\d+\)", ""), F.lit(r"\.([^.#\[\]]+)"), 1).alias("classes"),
            F.regexp_extract(s, r"\[([a-z:-]+)=", 1).alias("attr"),
            F.regexp_extract(s, r"=['\"]?([^'\"\]]*)['\"]?\]", 1).alias("value"),
            F.when(nth(s) != "", nth(s).cast("int")).alias("nth"),
        ),
    )


def matches(x: Column, step: Column) -> Column:
    return (
        ((step["tag"] == "") | (x["tag"] == F.lower(step["tag"])))
        & ((step["id"] == "") | (x["id"] == step["id"]))
        & F.forall(step["classes"], lambda c: F.array_contains(x["classes"], c))
        & (step["nth"].isNull() | (x["nth"] == step["nth"]))
        & ((step["attr"] == "") | F.coalesce(F.try_element_at(x["attrs"], step["attr"]) == step["value"], F.lit(False)))
    )


def selected(nodes: str | Column, selector: str | Column, scope: Column | None = None) -> Column:
    """The elements that a selector matches, in document order; with ``scope`` those it contains.

    As with the usual libraries the outer steps may match the scope itself or elements around it.
    """
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    everything = F.array(F.struct(F.lit(-1).alias("n"), F.lit(2**31 - 1).alias("last"))).cast(SPANS_DDL)
    here = lambda x: F.lit(True) if scope is None else inside(x, scope)

    def deeper(found: Column, step: Column) -> Column:
        hit = F.filter(nodes, lambda x: matches(x, step) & F.exists(found, lambda h: inside(x, h)))
        return F.transform(hit, lambda x: F.struct(x["n"].alias("n"), x["last"].alias("last"))).cast(SPANS_DDL)

    def hits(steps: Column) -> Column:
        outer = F.aggregate(F.slice(steps, 1, F.size(steps) - 1), everything, deeper)
        return let(
            F.struct(outer.alias("outer"), F.element_at(steps, -1).alias("step")),
            lambda v: F.filter(nodes, lambda x: here(x) & matches(x, v["step"]) & F.exists(v["outer"], lambda h: inside(x, h))),
        )

    return let(steps_of(selector), hits)


def listing_rows(trees: DataFrame, base: str | Column, fields: list[tuple[str, str | Column, str | None]]) -> DataFrame:
    """One row for each element that ``base`` selects, with its fields: (name, selector, attribute or None for text).

    ``page_id``, ``url``, ``row`` (place on the page, from 0) and the fields; an element that the
    selector does not find gives null, as does a null selector.  Selectors are strings or columns.
    Rows without any value are left out.
    """
    trees = trees.withColumn("bases_", selected("nodes", base))

    def value(holder: Column, selector: str | Column, attribute: str | None) -> Column:
        first = F.get(selected("nodes", selector, holder), F.lit(0))
        told = text_of("strings", first, "") if attribute is None else F.try_element_at(first["attrs"], F.lit(attribute))
        return F.when(first.isNotNull(), told)

    rows = F.transform("bases_", lambda b: F.struct(*[value(b, s, a).alias(name) for name, s, a in fields]))
    # An outer explode: the optimizer would copy the whole expression into a filter below an inner one.
    out = trees.select("page_id", "url", F.posexplode_outer(rows).alias("row", "f")).select("page_id", "url", "row", "f.*")
    return out.where(F.coalesce(*[F.col(name) for name, _, _ in fields]).isNotNull())


def nth_selector(x: Column) -> Column:
    """``tag:nth-child(n)`` of an element, among the siblings that were kept."""
    before = lambda v: F.filter("nodes", lambda y: (y["parent"] == v["parent"]) & (y["n"] <= v["n"]))
    return let(x, lambda v: F.concat(v["tag"], F.lit(":nth-child("), F.size(before(v)).cast("string"), F.lit(")")))


def classed(x: Column) -> Column:
    """The element's tag with its classes in order."""
    return F.when(F.size(x["classes"]) > 0, F.concat(x["tag"], F.lit("."), F.array_join(F.array_sort(x["classes"]), "."))).otherwise(x["tag"])


def href(x: Column) -> Column:
    return F.try_element_at(x["attrs"], F.lit("href"))


def is_anchor(x: Column) -> Column:
    return (x["tag"] == "a") & href(x).isNotNull()


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def dead(link: Column) -> Column:
    return link.isin("", "#", "javascript:void(0)")


def detected_listings(trees: DataFrame) -> DataFrame:
    """The most repeated kind of row of each page, and the selectors of its title, detail link, date and attachment.

    A kind is a tag with its sorted classes; its rows contain a link and 8 characters or more, and
    are 3 to 300.  Their number is the score, doubled for words of rows (or ``tr``), a fifth if words
    of navigation are in the kind or in the classes and ids of its first row or three levels around;
    ties go to the kind met first.  Pages without a kind, or whose first row has no usable link,
    have no row here.
    """
    df = stripped(trees)
    anchors = F.transform(F.filter("nodes", is_anchor), lambda a: a["n"])
    linked = let(anchors, lambda all: F.filter("nodes", lambda x: F.exists(all, lambda a: (a > x["n"]) & (a <= x["last"])) & (F.length(text_of("strings", x)) >= 8)))
    df = df.withColumn("rows_", F.transform(linked, lambda x: F.struct(x["n"].alias("n"), classed(x).alias("signature"))))
    places = lambda rows, s: F.transform(F.filter(rows, lambda r: r["signature"] == s), lambda r: r["n"])
    counted = let(F.col("rows_"), lambda rows: F.transform(F.array_distinct(rows["signature"]), lambda s: F.struct(s.alias("signature"), places(rows, s).alias("at"))))
    df = df.withColumn("kinds_", F.filter(counted, lambda k: F.size(k["at"]).between(3, 300)))

    def around(first: Column) -> Column:
        near = F.filter("nodes", lambda a: (a["n"] <= first["n"]) & (first["n"] <= a["last"]) & (a["depth"] >= first["depth"] - 3))
        return F.array_join(F.transform(near, lambda a: F.concat_ws(" ", a["classes"], a["id"])), " ")

    def score(kind: Column) -> Column:
        first = let(kind["at"][0], lambda n: F.get(F.filter("nodes", lambda x: x["n"] == n), F.lit(0)))
        names = let(first, around)
        double = F.when(holds(kind["signature"], ROWS) | (F.lower(kind["signature"]) == "tr"), 2.0).otherwise(1.0)
        fifth = F.when(holds(kind["signature"], CHROME) | holds(names, CHROME), 0.2).otherwise(1.0)
        return F.size(kind["at"]).cast("double") * double * fifth

    ranked = F.transform("kinds_", lambda k, i: F.struct(score(k).alias("score"), (-i).alias("order"), k["signature"].alias("signature"), k["at"].alias("at")))
    df = df.withColumn("best_", F.array_max(ranked))
    df = df.withColumn("sample_", F.get(F.filter("nodes", lambda x: x["n"] == F.col("best_.at")[0]), F.lit(0)))
    sample, base = F.col("sample_"), netloc(F.col("url"))
    own = let(sample, lambda v: F.filter("nodes", lambda x: is_anchor(x) & inside(x, v) & ~dead(F.trim(href(x)))))
    df = df.withColumn("links_", F.transform(own, lambda x: F.struct(x["n"].alias("n"), x["parent"].alias("parent"), F.trim(href(x)).alias("href"))))

    def detail(link: Column) -> Column:
        u = link["href"]
        away = (netloc(u) != "") & (netloc(u) != base)
        slashes = F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))
        n = lambda c, v: F.when(c, v).otherwise(0)
        return n(F.lower(u).rlike(urls.FILES), -10) + n(away, -5) + n(u.rlike(r"\p{Nd}"), 2) + n(slashes > 1, 1)

    # The last of the best links, and the first of the best files.
    df = df.withColumn("anchor_n_", F.array_max(F.transform("links_", lambda x: F.struct(detail(x).alias("score"), x["n"].alias("n"))))["n"])
    files = F.filter("links_", lambda x: (x["n"] != F.col("anchor_n_")) & F.substring_index(F.lower(x["href"]), "?", 1).rlike(urls.FILES))
    outside = lambda x: F.when((netloc(x["href"]) != "") & (netloc(x["href"]) != base), 2).otherwise(1)
    df = df.withColumn("file_n_", -F.array_max(F.transform(files, lambda x: F.struct(outside(x).alias("score"), (-x["n"]).alias("n"))))["n"])
    at = lambda n: let(n, lambda k: F.get(F.filter("nodes", lambda x: x["n"] == k), F.lit(0)))
    df = df.withColumns({"anchor_": at(F.col("anchor_n_")), "file_": at(F.col("file_n_"))})
    df = df.withColumns({"cell_": at(F.col("anchor_.parent")), "file_cell_": at(F.col("file_.parent"))})

    def anchor_selector(anchor: str, cell: str) -> Column:
        a, c = F.col(anchor), F.col(cell)
        plain = F.when(c.isNotNull() & (c["tag"] != "a"), F.concat(nth_selector(c), F.lit(" a"))).otherwise("a")
        return F.when(a.isNotNull(), F.when(F.size(a["classes"]) > 0, classed(a)).otherwise(plain))

    skipped = F.when(F.col("cell_.tag").isin("td", "th"), F.col("cell_.n")).otherwise(F.col("anchor_n_"))
    children = F.filter("nodes", lambda x: x["parent"] == sample["n"])
    told = F.transform(children, lambda x: F.struct(x["n"].alias("n"), text_of("strings", x).alias("text")))
    df = df.withColumn("children_", told)
    titles = F.filter("children_", lambda c: (c["n"] != skipped) & (c["text"] != "") & ~c["text"].rlike(r"^\p{Nd}+$") & ~c["text"].rlike(f"^(?:{DATE_LIKE})$"))
    longest = F.array_max(F.transform(titles, lambda c: F.struct(F.length(c["text"]).alias("chars"), (-c["n"]).alias("minus_n"))))
    heading = F.get(F.filter("nodes", lambda x: inside(x, sample) & x["tag"].isin("h1", "h2", "h3", "h4")), F.lit(0))
    title = F.when(longest["chars"] >= 8, nth_selector(at(-longest["minus_n"]))).when(F.coalesce(text_of("strings", heading) != "", F.lit(False)), heading["tag"]).otherwise("a")
    within = let(sample, lambda v: F.filter("nodes", lambda x: inside(x, v)))
    dated = F.get(F.filter(within, lambda x: holds(F.array_join(x["classes"], " "), ["date"]) | (holds(F.array_join(x["classes"], " "), ["time"]) & (x["tag"] != "time"))), F.lit(0))
    shaped = F.get(F.filter("children_", lambda c: c["text"].rlike(DATE_LIKE)), F.lit(0))
    date = F.when(F.exists(within, lambda x: x["tag"] == "time"), "time").when(dated.isNotNull(), nth_selector(dated)).when(shaped.isNotNull(), nth_selector(at(shaped["n"])))
    kind = F.col("best_.signature")
    schema = F.struct(
        kind.alias("signature"),
        F.size("best_.at").alias("n"),
        F.col("best_.score").alias("score"),
        F.when(kind == "tr", "table tbody tr").otherwise(kind).alias("base"),
        title.alias("title"),
        anchor_selector("anchor_", "cell_").alias("detail"),
        date.alias("published"),
        anchor_selector("file_", "file_cell_").alias("attachment"),
    )
    # A filter here would be copied, with all it depends on, to below the steps above; it stays above an explode.
    found = df.select("page_id", F.explode_outer(F.array(F.when(F.col("anchor_n_").isNotNull(), schema))).alias("s"))
    return found.where("s IS NOT NULL").select("page_id", "s.*")


def read_listings(trees: DataFrame, schemas: DataFrame) -> DataFrame:
    """The rows of each page by its own detected selectors: title, detail link, date, attachment."""
    schemas = schemas.select("page_id", *[F.col(c).alias(f"{c}_") for c in ("base", "title", "detail", "published", "attachment")])
    both = trees.join(shuffled(schemas), "page_id")
    fields = [("title", F.col("title_"), None), ("detail_href", F.col("detail_"), "href"), ("published_raw", F.col("published_"), None), ("attachment_href", F.col("attachment_"), "href")]
    return listing_rows(both, F.col("base_"), fields)


def details(trees: DataFrame) -> DataFrame:
    """Title, date, main text and attachments of article pages.

    ``title`` is the first h1, ``published_raw`` the first time element.  The main text is that of
    the first of the content selectors with over 80 characters, else of the body; elements inside
    it whose classes or id name page furniture go, unless they hold over 60 % of it.  A body of over
    6000 characters is no text, and a page that embeds a viewer has none.  ``attachment_url`` is the
    first file linked in the main text, else on the page, else named in a script; ``attachments``
    are all of these and links of download paths, the first of each URL, with their link texts.
    """
    df = stripped(trees, "aside")
    found = F.array(*[F.get(selected("nodes", s), F.lit(0)) for s in CONTENT])
    span = lambda x: F.when(x.isNotNull(), F.struct(x["n"].alias("n"), x["last"].alias("last"), x["t0"].alias("t0"), x["t1"].alias("t1")))
    long = lambda x: F.length(text_of("strings", x, "")) > 80
    whole = F.struct(F.lit(-1).alias("n"), F.lit(2**31 - 1).alias("last"), F.lit(0).alias("t0"), F.size("strings").alias("t1"))
    named = let(F.get(F.filter(found, lambda x: x.isNotNull() & long(x)), F.lit(0)), span)
    body = F.get(F.filter("nodes", lambda x: x["tag"] == "body"), F.lit(0))
    df = df.withColumn("named_", named).withColumn("main_", F.coalesce("named_", span(body), whole))
    total = F.length(text_of("strings", F.col("main_"), ""))
    names = lambda x: F.concat_ws(" ", x["id"], x["classes"])
    df = df.withColumn("total_", total)
    heading = F.get(F.filter("nodes", lambda x: x["tag"] == "h1"), F.lit(0))
    time = F.get(F.filter("nodes", lambda x: x["tag"] == "time"), F.lit(0))
    df = df.withColumns({"title": clean(text_of("strings", heading)), "published_raw": text_of("strings", time)})
    furniture = F.filter("nodes", lambda x: inside(x, F.col("main_")) & holds(names(x), FURNITURE) & ((F.col("total_") == 0) | (F.length(text_of("strings", x, "")) <= F.col("total_") * 0.6)))
    df = without(df, furniture)
    ids, classes = ([v[1:] for v in VIEWERS if v[0] == mark] for mark in "#.")
    viewer = F.exists("nodes", lambda x: x["id"].isin(ids) | F.arrays_overlap(x["classes"], F.array(*map(F.lit, classes))))
    text = clean(text_of("strings", F.col("main_")))
    text = F.when(~viewer & ~(F.col("named_").isNull() & (F.length(text) > MOST_FALLBACK)), text)
    links = F.transform(F.filter("nodes", is_anchor), lambda x: F.struct(x["n"].alias("n"), F.trim(href(x)).alias("href"), clean(text_of("strings", x)).alias("label")))
    df = df.withColumn("text_", text).withColumn("links_", F.filter(links, lambda x: ~dead(x["href"])))
    is_file = lambda x: F.substring_index(F.lower(x["href"]), "?", 1).rlike(urls.FILES)
    absolute = lambda x: urls.absolute(F.col("url"), x["href"])
    scripted = F.transform(F.regexp_extract_all("html", F.lit(SCRIPT_FILE), 1), lambda u: F.struct(urls.absolute(F.col("url"), u).alias("url"), F.lit(None).cast("string").alias("label")))
    df = df.withColumn("files_", F.filter("links_", is_file)).withColumn("scripted_", F.coalesce(scripted, F.array().cast("array<struct<url: string, label: string>>")))
    first = lambda c: F.get(c, F.lit(0))
    one = F.coalesce(absolute(first(F.filter("files_", lambda x: inside(x, F.col("main_"))))), absolute(first(F.col("files_"))), first(F.col("scripted_"))["url"])
    listed = F.transform(F.filter("links_", lambda x: is_file(x) | holds(x["href"], DOWNLOADS)), lambda x: F.struct(absolute(x).alias("url"), x["label"].alias("label")))
    every = F.filter(F.concat(listed, F.col("scripted_")), lambda a: a["url"].isNotNull())
    unique = let(every, lambda all: F.filter(all, lambda a, i: F.array_position(all["url"], a["url"]) == i + 1))
    return df.select("page_id", "url", "title", "published_raw", F.col("text_").alias("content_text"), one.alias("attachment_url"), unique.alias("attachments"))


def page_reference(link: Column, listing: Column) -> Column:
    """(kind, param, number) of the page that a pager link leads to, or null: a page parameter of the query or ``/page/n`` under the listing's own path."""
    path_of = lambda u: F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    number = lambda c: F.when(F.replace(c, F.lit(","), F.lit("")).rlike(r"^\d{1,9}$"), F.replace(c, F.lit(","), F.lit("")).cast("int"))

    def by_query(pairs: Column) -> Column:
        # Of a key that comes several times the first value counts.
        firsts = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
        kept = F.filter(firsts, lambda p: F.lower(p["key"]).isin(PAGE_KEYS) & F.coalesce(number(p["value"]) <= MOST_PAGES, F.lit(False)))
        return F.get(F.transform(kept, lambda p: F.struct(F.lit("QUERY_PARAM").alias("kind"), p["key"].alias("param"), number(p["value"]).alias("number"))), F.lit(0))

    def by_path(path: Column) -> Column:
        n = number(F.regexp_extract(path, r"(?i)/page/(\d+)/?$", 1))
        prefix = F.regexp_replace(F.regexp_extract(path, r"(?i)^(.*)/page/\d+/?$", 1), "/+$", "")
        under = (n <= MOST_PAGES) & (prefix != "") & F.endswith(F.regexp_replace(path_of(listing), "/+$", ""), prefix)
        return F.when(under, F.struct(F.lit("PATH_TEMPLATE").alias("kind"), F.lit("page").alias("param"), n.alias("number")))

    def read(target: Column) -> Column:
        pairs = F.transform(
            F.split(F.regexp_extract(target, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, "=(.*)$", 1).alias("value"))
        )
        told = F.coalesce(let(F.filter(pairs, lambda p: p["value"] != ""), by_query), let(path_of(target), by_path))
        return F.when(urls.same_origin(target, listing), told)

    return let(urls.absolute(listing, link), read)


def pagers(trees: DataFrame) -> DataFrame:
    """What each page says of its own pages: ``kind``, ``param``, ``start_page``, ``last_page``, ``total_results``, ``per_page``.

    Links, ``gotoPage`` clicks and paginator keys inside pager elements vote for a scheme (in nested
    pager elements once for each); without such elements links whose text is a number do.  Most
    votes win, then the larger last page, then the scheme met first; a scheme that names page 1
    only is none.  "Showing a to b of n" gives the total and, on a first window, rows a page and so
    the number of pages, if that is larger.  Every page has a row; what is not said is null.
    """
    df = trees.withColumn("pagers_", F.filter("nodes", lambda x: holds(F.concat_ws(" ", x["classes"], x["id"], F.try_element_at(x["attrs"], F.lit("aria-label"))), PAGERS)))

    def attr(x: Column, name: str) -> Column:
        return F.try_element_at(x["attrs"], F.lit(name))

    def small(c: Column) -> Column:
        n = F.when(c.rlike(r"^\d{1,9}$"), c.cast("int"))
        return F.when(n <= MOST_PAGES, n)

    def said(param: Column, number: Column) -> Column:
        return F.when(number.isNotNull(), F.struct(F.lit("QUERY_PARAM").alias("kind"), param.alias("param"), number.alias("number")))

    click, key = r"gotoPage\(\s*(\d+)\s*,\s*['\"]([^'\"]+)['\"]", r"^paginator-page-(.+)-(\d+)$"
    sorts: list[tuple[Callable, Callable]] = [
        (is_anchor, lambda x: page_reference(href(x), F.col("url"))),
        (lambda x: attr(x, "wire:click").isNotNull(), lambda x: said(F.regexp_extract(attr(x, "wire:click"), click, 2), small(F.regexp_extract(attr(x, "wire:click"), click, 1)))),
        (lambda x: attr(x, "wire:key").isNotNull(), lambda x: said(F.regexp_extract(attr(x, "wire:key"), key, 1), small(F.regexp_extract(attr(x, "wire:key"), key, 2)))),
    ]

    def in_pager(pager: Column, test: Callable, say: Callable) -> Column:
        return F.transform(F.filter("nodes", lambda x: test(x) & inside(x, pager)), say)

    votes = F.flatten(F.transform("pagers_", lambda p: F.concat(*[in_pager(p, test, say) for test, say in sorts])))
    numbered = F.transform(F.filter("nodes", lambda x: is_anchor(x) & text_of("strings", x, "").rlike(r"^\p{Nd}+$")), lambda x: page_reference(href(x), F.col("url")))
    df = df.withColumn("votes_", F.filter(F.when(F.size("pagers_") > 0, votes).otherwise(numbered), lambda v: v.isNotNull()))
    schemes = F.array_distinct(F.transform("votes_", lambda v: F.struct(v["kind"].alias("kind"), v["param"].alias("param"))))

    def weighed(s: Column, i: Column) -> Column:
        numbers = F.transform(F.filter("votes_", lambda v: (v["kind"] == s["kind"]) & (v["param"] == s["param"])), lambda v: v["number"])
        return F.struct(F.size(numbers).alias("votes"), F.array_max(numbers).alias("top"), (-i).alias("order"), F.array_min(numbers).alias("least"), s["kind"].alias("kind"), s["param"].alias("param"))

    df = df.withColumn("scheme_", F.array_max(F.transform(schemes, weighed)))
    df = df.withColumn("scheme_", F.when(F.col("scheme_.top") > 1, F.col("scheme_")).when(F.col("scheme_.top") > F.col("scheme_.least"), F.col("scheme_")))
    text = F.array_join("strings", " ")
    count = lambda rx, k: F.try_to_number(F.when(F.regexp_extract(text, rx, k) != "", F.replace(F.regexp_extract(text, rx, k), F.lit(","), F.lit(""))), F.lit("999999999")).cast("long")
    df = df.withColumns({"from_": count(SHOWING, 1), "to_": count(SHOWING, 2), "of_": count(SHOWING, 3), "shown_": text.rlike(SHOWING)})
    total = F.when(F.col("shown_"), F.when(text.rlike(TOTAL), count(TOTAL, 1)).otherwise(F.col("of_")))
    per_page = F.when(F.col("shown_") & (F.col("from_") == 1) & (F.col("to_") >= 1), F.col("to_"))
    df = df.withColumns({"total_results": total, "per_page": per_page})
    counted = F.when((F.col("total_results") > 0) & (F.col("per_page") > 0), F.ceil(F.col("total_results") / F.col("per_page")))
    last = F.greatest(F.col("scheme_.top").cast("long"), F.when(counted <= MOST_PAGES, counted))
    return df.select(
        "page_id", F.col("scheme_.kind").alias("kind"), F.col("scheme_.param").alias("param"), F.when(F.col("scheme_").isNotNull(), F.when(F.col("scheme_.least") == 0, 0).otherwise(1)).alias("start_page"),
        last.alias("last_page"), "total_results", "per_page",
    )


def harvested_links(trees: DataFrame) -> DataFrame:
    """Links of a page to other pages of its site: ``place``, ``href``, ``text`` (120 characters) and ``in_nav``, the first of each address.

    Files, fragments, scripts, mail and telephone links, and links to the page itself are left out;
    addresses are compared without fragment and slash at the end.  ``in_nav``: inside nav or header
    elements or elements with a class of navigation.
    """
    bare = lambda c: F.regexp_replace(F.substring_index(c, "#", 1), "(?<=[^/])/+$", "")
    navs = F.filter("nodes", lambda x: x["tag"].isin("nav", "header") | holds(F.array_join(x["classes"], " "), NAV_CLASSES))
    spans = F.transform(navs, lambda x: F.struct(x["n"].alias("n"), x["last"].alias("last")))
    usable = F.filter("nodes", lambda x: is_anchor(x) & (F.trim(href(x)) != "") & ~F.trim(href(x)).rlike("^(#|javascript:|mailto:|tel:)"))
    rows = lambda navs: F.transform(
        usable,
        lambda x: F.struct(urls.absolute(F.col("url"), href(x)).alias("href"), F.substring(F.coalesce(clean(text_of("strings", x)), F.lit("")), 1, 120).alias("text"), F.exists(navs, lambda v: inside(x, v)).alias("in_nav")),
    )
    df = trees.withColumn("links_", F.transform(let(spans, rows), lambda r: F.struct(r["href"].alias("href"), r["text"].alias("text"), r["in_nav"].alias("in_nav"), bare(r["href"]).alias("address"))))
    kept = F.filter("links_", lambda r: r["href"].isNotNull() & urls.same_origin(r["href"], F.col("url")) & ~F.lower(r["href"]).rlike(urls.FILES) & (r["address"] != bare(F.col("url"))))
    df = df.withColumn("links_", kept)
    first = let(F.col("links_"), lambda all: F.filter(all, lambda r, i: F.array_position(all["address"], r["address"]) == i + 1))
    return df.select("page_id", "url", F.posexplode_outer(first).alias("place", "l")).where("l IS NOT NULL").select("page_id", "url", "place", "l.href", "l.text", "l.in_nav")
