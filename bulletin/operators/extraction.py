"""Pages to records: title, main text and links; sitemaps.

A small parser walks each page once where its row lies; everything after is columns.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches

SKIPPED = {"script", "style", "noscript", "template"}
CHROME = {"nav", "header", "footer", "aside", "form"}
MAIN = {"article", "main"}
BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "section", "article"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PAGE_SCHEMA = (
    "title string, main string, body string, published string, "
    "links array<struct<href:string,text:string,nav:boolean>>"
)


class Page(HTMLParser):
    """Title, texts and links of one page."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.open = url, []
        self.title, self.heading, self.published = [], [], None
        self.main, self.body, self.links = [], [], []
        self.link = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in BREAKS:
            self.text("\n")
        if tag == "time" and self.published is None:
            self.published = a.get("datetime") or None
        if tag == "a" and a.get("href"):
            self.link = [a["href"], []]
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag == "a" and self.link:
            try:
                href = urljoin(self.url, self.link[0].strip())
            except ValueError:
                href = None
            if href:
                self.links.append((href, squeeze("".join(self.link[1])), bool(CHROME & set(self.open))))
            self.link = None
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in BREAKS:
            self.text("\n")

    def handle_data(self, data):
        inside = set(self.open)
        if inside & SKIPPED:
            return
        if "title" in inside:
            self.title.append(data)
            return
        if "h1" in inside:
            self.heading.append(data)
        if self.link:
            self.link[1].append(data)
        self.text(data)

    def text(self, data):
        inside = set(self.open)
        if inside & SKIPPED or "title" in inside:
            return
        if not inside & CHROME:
            self.body.append(data)
            if inside & MAIN:
                self.main.append(data)


def squeeze(text: str) -> str:
    return "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in text.split("\n")) if x)


def read_page(url: str | None, html: str | None) -> dict:
    page = Page(url or "")
    page.feed(html or "")
    page.close()
    title = squeeze("".join(page.heading)) or squeeze("".join(page.title))
    return {
        "title": title.replace("\n", " ") or None, "main": squeeze("".join(page.main)) or None, "body": squeeze("".join(page.body)) or None,
        "published": page.published, "links": page.links,
    }


def page_frame(urls: pd.Series, htmls: pd.Series) -> pd.DataFrame:
    names = ["title", "main", "body", "published", "links"]
    return pd.DataFrame([read_page(u, h) for u, h in zip(urls, htmls)], columns=names)


def pages(rows: DataFrame) -> DataFrame:
    """Pages (``page_id``, ``url``, ``html``) with what they hold."""
    page_struct = F.pandas_udf(page_frame, PAGE_SCHEMA)
    return bounded_batches(rows).withColumn("p", page_struct("url", "html")).select("page_id", "url", "p.*")


def main_text(least: int = 80) -> Column:
    """The main element's text if it is long enough, else the body's unless that is over 6000 characters."""
    return F.when(F.length("main") > least, F.col("main")).otherwise(F.when(F.length("body") <= 6000, F.col("body")))


def links(read: DataFrame) -> DataFrame:
    """One row per link, the first of each normalised URL of a page."""
    from ..functions import urls

    rows = read.select("page_id", "url", F.posexplode("links").alias("pos", "l")).select("page_id", "url", "pos", "l.*")
    rows = rows.withColumn("target", urls.normalised("href")).where("target IS NOT NULL")
    first = rows.groupBy("page_id", "target").agg(F.min(F.struct("pos", "url", "href", "text", "nav")).alias("f"))
    return first.select("page_id", "target", "f.*").withColumns(
        {"file": urls.is_file("href"), "internal": urls.same_origin("href", F.col("url")), "number": urls.page_number("href")}
    )


def sitemap(rows: DataFrame) -> DataFrame:
    """Locations and dates of sitemap documents (``url``, ``xml``), whatever their namespaces."""
    at = lambda name: F.xpath("xml", F.lit(f"//*[local-name()='{name}']/text()"))
    kind = F.when(F.contains("xml", F.lit("<sitemapindex")), "index").otherwise("urls")
    return rows.select("url", kind.alias("kind"), F.explode(F.arrays_zip(at("loc").alias("loc"), at("lastmod").alias("lastmod"))).alias("e")).select("url", "kind", "e.*")
