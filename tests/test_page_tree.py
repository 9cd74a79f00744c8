"""Listings, details, pagers and links of pages against a plain nested tree, on hand-made pages and the pages table."""

import plain_pages as plain
import pytest
from oracle import DATA

from bulletin.operators import page_tree

TABLE = """<html><head><title>List</title></head><body><nav><ul class="menu"><li><a href="/a1">Long label one</a></li><li><a href="/a2">Long label two</a></li><li><a href="/a3">Long label 3</a></li></ul></nav>
<table><thead><tr><th>No</th><th>Title of it</th></tr></thead><tbody>
<tr><td>1</td><td>Notice about water supply</td><td>2024-01-02</td><td><a href="/notice/11">View</a></td><td><a href="/f/a.pdf">PDF</a></td></tr>
<tr><td>2</td><td>Notice about <b>road</b> works</td><td>2 May 2024</td><td><a href="/notice/12">View</a></td><td><a href="/f/b.pdf">PDF</a></td></tr>
<tr><td>3</td><td>Short</td><td></td><td><a href="/notice/13">View</a></td></tr><tr><td>no link here at all</td></tr></tbody></table>
<ul class="pagination" aria-label="Pager"><li><a href="?page=1">1</a><li><a href="?page=2">2</a><li><a href="?page=7&page=9">7</a></ul><p>Showing 1 to 10 of 95 results</p></body></html>"""
CARDS = """<body><div id="sidebar-menu"><ul><li class="x"><a href="/s/1">sidebar entry 1</a></li><li class="x"><a href="/s/2">sidebar entry 2</a></li><li class="x"><a href="/s/3">sidebar entry 3</a></li><li class="x"><a href="/s/4">sidebar 4</a></li></ul></div>
<div class="grid"><div class="card news b"><h3>Heading one</h3><span class="Post-Date">yesterday</span><a class="more z" href="https://cdn.org/one.pdf"></a><a href="https://other.org/1/2">off site</a><a class="more z" href="/news/21/x">read</a></div>
<div class="b card news"><h3>Heading two</h3><span class="Post-Date">today</span><a class="more z" href="/news/22/x">read</a></div><div class="news card b"><h3>Heading three</h3><time>2024-05-06</time><a href="/news/23/x">read</a></div></div>
<div class="pager"><div class="paging"><a href="/list/page/2">2</a><a href="/list/page/3/">3</a></div><a href="?p=9">last</a></div>Showing 21-23 of 1,023 entries, of 24 items</body>"""
ARTICLE = """<html><body><header><h1>Site</h1></header><main id="m"><h1> The  real
 title </h1><time datetime="2024-01-01">1 Jan 2024</time><div class="share-links">Share this page on everything <a href="/files/x">file x</a></div>
<p>The text of the notice is long enough to count as the content of this page, which has more than eighty characters.</p><a href="/doc/a.PDF">  the
 paper </a><a href="/doc/a.PDF">again</a><a href="javascript:void(0)">x</a><a href="mailto:a@b/uploads/">m</a></main><aside>aside <a href="/y.pdf">y</a></aside><a href="/z.doc">z</a>
<script>var pdf = 'https://cdn.org/p.pdf', two = "https://cdn.org/q.docx";</script><div class="cookie">We use cookies</div></body></html>"""
VIEWER = '<body><article>' + "viewer chrome " * 10 + '<div class="pdfViewer">Zoom</div></article><script>x="https://a.org/in.pdf"</script></body>'
SOUP = "<body><div class='navbar'>short</div>" + "<p>word word</p>" * 900 + "</body>"
WRAPPED = '<body><div class="search-page"><p>' + "content that is nearly all of it " * 5 + '</p></div><div class="widget">w</div>tail</body>'
LIVEWIRE = """<div class="pagination"><button wire:click="gotoPage(2, 'pg')">2</button><button wire:click="gotoPage( 4 , 'pg')">4</button><li wire:key="paginator-page-pg-1">1</li><a href="?page=0">0</a></div> Showing 1 to 20 of 61"""
BARE = '<p><a href="/l?paged=2">2</a><a href="/l?paged=99999&p=3">३</a><a href="https://elsewhere.org/l?page=8">8</a><a href="?page=1">next</a></p>'
FIRST_ONLY = '<div id="pager"><a href="?page=1">1</a></div>'
UNCLOSED = "<ul><li class=item><a href=/1>item number one<li class=item><a href=/2>item number two<li class=item><a href=../3?q#f>item number three</ul><p>a < b &amp; c<br/>d<!-- c -->e</p></b>"
HAND = [TABLE, CARDS, ARTICLE, VIEWER, SOUP, WRAPPED, LIVEWIRE, BARE, FIRST_ONLY, UNCLOSED, "", "no markup at all", "<body></body>", None]
URLS = ["https://www.a.org/list/", "http://a.org/list?x=1#y", "https://a.org/list"]


@pytest.fixture(scope="module")
def pages(spark):
    hand = [(10_000 + 10 * i + j, u, h) for i, h in enumerate(HAND) for j, u in enumerate(URLS)]
    made = spark.createDataFrame(hand, "page_id long, url string, html string")
    rows = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").select("page_id", "url", "html").unionByName(made)
    return {r.page_id: (r.url, r.html) for r in rows.collect()}, page_tree.page_trees(rows).cache()


def test_listings(pages):
    known, trees = pages
    got = {r[0]: tuple(r[1:]) for r in page_tree.detected_listings(trees).collect()}
    want = {i: x for i, p in known.items() if (x := plain.listing(*p))}
    assert got == want and len({x[0] for x in want.values()}) == 3


def test_rows_by_detected_selectors(pages):
    known, trees = pages
    got = sorted((r.page_id, r.row, r.title, r.detail_href, r.published_raw, r.attachment_href) for r in page_tree.read_listings(trees, page_tree.detected_listings(trees)).collect())
    want = sorted((i, *r) for i, p in known.items() for r in plain.rows(*p))
    assert got == want
    table = [r[2:] for r in got if r[0] == 10_000]
    assert table[:2] == [("Notice about water supply", "/notice/11", "2024-01-02", "/f/a.pdf"), ("Notice aboutroadworks", "/notice/12", "2 May 2024", "/f/b.pdf")]


def test_rows_by_given_selectors(pages):
    known, trees = pages
    fields = [("title", "h3", None), ("link", "a.more", "href"), ("when", "[class='x'] b", None)]
    got = sorted(tuple(r)[2:] for r in page_tree.listing_rows(trees.where("page_id = 10010"), "div.card.news", fields).collect())
    assert got == [(0, "Heading one", "https://cdn.org/one.pdf", None), (1, "Heading two", "/news/22/x", None), (2, "Heading three", None, None)]


def test_details(pages):
    known, trees = pages
    got = {r.page_id: (r.title, r.published_raw, r.content_text, r.attachment_url, [tuple(a) for a in r.attachments]) for r in page_tree.details(trees).collect()}
    want = {i: plain.detail(*p) for i, p in known.items()}
    assert got == want
    assert got[10_020][0] == "The real title" and got[10_020][3] == "https://www.a.org/doc/a.PDF" and "Share" not in got[10_020][2]
    assert got[10_030][2:4] == (None, "https://a.org/in.pdf") and got[10_040][2] is None and got[10_050][2].startswith("content that")


def test_pagers(pages):
    known, trees = pages
    got = {r[0]: tuple(r[1:]) for r in page_tree.pagers(trees).collect()}
    assert got == {i: plain.pager(*p) for i, p in known.items()}
    assert got[10_000] == ("QUERY_PARAM", "page", 1, 10, 95, 10) and got[10_010][:4] == ("PATH_TEMPLATE", "page", 1, 3)
    assert got[10_060] == ("QUERY_PARAM", "pg", 1, 4, 61, 20) and got[10_070][:4] == ("QUERY_PARAM", "p", 1, 3) and got[10_080][0] is None


def test_links(pages):
    known, trees = pages
    got = sorted((r.page_id, r.href, r.text, r.in_nav) for r in page_tree.harvested_links(trees).collect())
    assert got == sorted((i, *x) for i, p in known.items() for x in plain.links(*p))
