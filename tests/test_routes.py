"""Route scores and discovery on a hand-made site."""

from pyspark.sql import functions as F

from bulletin.operators import routes


def listing(*hrefs):
    return "<ul>" + "".join(f"<li class='row'><a class='t' href='{h}'>An item of the list</a></li>" for h in hrefs) + "</ul>"


def test_scores(spark):
    cases = {
        ("https://a.org/notices", "Notices", True): ("NOTICE", 6 + 5 + 2 + 2 + 1.5),
        ("https://a.org/page/12", "सूचना", False): ("NOTICE", 5 - 8),
        ("https://a.org/x/my-news/", "read all tenders", False): ("NEWS", 4 + 3 + 1.5),
        ("https://a.org/press_release/archive/old", None, False): ("PRESS_RELEASE", 4 - 0.75),
        ("https://a.org/category/details-of-printed-licenses", "", False): ("NOTICE", 6 + 1.5),
        ("https://a.org/post/press-note-21", "", False): ("PRESS_RELEASE", 4 + 1.5 - 8),
        ("https://a.org/a-b-c-d-e-notice", "", False): ("NOTICE", 4 + 1.5 - 8),
        ("https://a.org/?type=career", "careers", False): ("JOB", 4 + 5 + 2),
        ("https://a.org/about/news", "", True): None,
        ("https://a.org/x", "video news", True): None,
        ("https://a.org/x", "nothing", True): None,
    }
    df = spark.createDataFrame([(*k,) for k in cases], "u string, t string, n boolean").select("u", "t", "n", routes.route_score("u", "t", "n").alias("s"))
    got = {(r.u, r.t, r.n): r.s and tuple(r.s) for r in df.collect()}
    assert got == cases


def test_discovery(spark):
    home = """<nav><a href="/notice">Notice</a><a href="/news/">News</a><a href="/tenders">Tenders</a><a href="/about">About us</a></nav><a href="/post/notice-9">Old notice</a><a href="/circular#x">c</a><a href="https://b.org/news">other</a>"""
    pages = {
        "/notice": '<a href="/notice/local">Local notices</a><a href="/notice/central">Central notice</a><a href="/news/x">News</a><a href="/notice/deep/er/still">Notice deep</a>',
        "/notice/local": listing("/n/1", "/n/2"),
        "/notice/central": listing("/n/3/a", "/n/4/b", "/n/5/c", "https://facebook.com/x", "/notice/central"),
        "/news": listing(*(f"/news/{i}/t" for i in range(20))),
        "/tenders": listing("/t/1", "/t/2"),
        "/category/vacancy": listing("/v/1", "/v/2", "/v/3", "/v/4"),
    }
    sites = spark.createDataFrame([(1, "https://a.org/", home), (2, "https://c.org", None), (None, "https://d.org", home)], "site_id long, base string, html string")
    fetched = spark.createDataFrame([("https://a.org" + p, h) for p, h in pages.items()] + [(None, "x")], "url string, html string")
    rows = routes.discovered(sites, fetched).orderBy("site_id", "place").collect()
    got = [(r.url.removeprefix("https://a.org"), r.category, r.label, r.score, r.verified, r.rows, r.best) for r in rows if r.site_id == 1]
    assert got == [
        ("/news/", "NEWS", "News", 6 + 5 + 2 + 2 + 1.5 + 15, True, 20, True),
        ("/notice/central", "NOTICE", "Central notice", 6 + 3 + 2 + 3, True, 3, True),
        ("/category/vacancy", "VACANCY", None, 2.0 + 4, True, 4, True),
        ("/notice", "NOTICE", "Notice", 16.5, False, 0, False),
        ("/tenders", "TENDER", "Tenders", 16.5, False, 0, False),
        ("/circular#x", "CIRCULAR", "c", 7.5, False, 0, False),
    ]
    assert not [r for r in rows if r.site_id != 1]
    assert routes.discovered(sites.limit(0), fetched).count() == 0 and routes.discovered(sites.where(F.lit(False)), fetched.limit(0)).count() == 0


def test_no_table_is_broadcast(spark, monkeypatch):
    plans, write = [], routes.written
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(routes, "written", lambda df, name: planned(df) or write(df, name))
    sites = spark.range(300).select(F.col("id").alias("site_id"), F.lit("https://a.org/").alias("base"), F.lit("<a href='/notices'>Notices</a>").alias("html"))
    fetched = spark.createDataFrame([("https://a.org/notices", listing("/n/1/a", "/n/2/b"))], "url string, html string")
    found = routes.discovered(sites, fetched)
    planned(found)
    assert found.count() == 300 and len(plans) > 8
    assert not [p for p in plans if "Broadcast" in p]
