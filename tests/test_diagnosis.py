"""Run diagnoses: one case a rule and threshold."""

from bulletin.operators import diagnosis

RUN = "run_id long, items_found int, items_new int, has_sitemap boolean, listings map<string,string>, best_routes map<string,string>, notes array<string>, pagination struct<type:string,param:string,start_page:int>, detected struct<type:string,param:string,start_page:int>"
ISSUE = "run_id long, stage string, outcome string, reason string, error string, url string"


def told(spark, issues, found=0, new=0, sitemap=False, listings=None, best=None, notes=None, pagination=None, detected=None):
    runs = spark.createDataFrame([(1, found, new, sitemap, listings, best, notes, pagination, detected)], RUN)
    rows = diagnosis.diagnoses(runs, spark.createDataFrame([(1, *i) for i in issues] + [(2, "detail", "failed", None, "403", None)], ISSUE)).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(len(rows)))
    return rows


def codes(*args, **named):
    return [r.code for r in told(*args, **named)]


def fails(stage, error="", url=None, n=1):
    return [(stage, "failed", None, error, url)] * n


def skips(reason, n):
    return [(None, "skipped", reason, None, None)] * n


def test_dead_lists(spark):
    lists, best = {"NEWS": "https://a.org/news/", "TENDER": "https://a.org/t"}, {"NEWS": "https://a.org/latest", "TENDER": "https://a.org/tt"}
    (r,) = told(spark, fails("listing", "HTTP 404 x", "https://a.org/news") + fails("raw_fetch", "HTTP 410", "https://a.org/t/"), listings=lists, best=best)
    assert (r.code, r.severity, r.n, r.note, r.patch, r.actions) == ("listing_url_dead", "error", 2, "404, 410", {"newsListUrl": "https://a.org/latest"}, ["apply_patch"])
    (r,) = told(spark, fails("listing_url", "HTTP 401", "https://b.org"), listings=lists, best=best)
    assert (r.code, r.patch, r.actions) == ("listing_url_dead", {}, ["discover_routes"])
    assert codes(spark, fails("detail", "HTTP 404")) == [] and codes(spark, fails("listing", "HTTP 500")) == []


def test_requests(spark):
    assert codes(spark, fails("x", "Just a Moment...") + fails("x", "getaddrinfo") + fails("x", "bad Certificate") + fails("x", "timeout")) == ["blocked", "dns_failure", "tls_failure"]
    assert codes(spark, [("x", None, None, "Read timed out", None), ("x", "", None, "503", None)]) == ["site_unreachable"]
    assert codes(spark, [("x", "skipped", "y", "403 timed out", None)]) == []


def test_rows(spark):
    assert codes(spark, skips("not_article_url", 3)) == ["rows_rejected"] and codes(spark, skips("not_article_url", 2)) == []
    assert codes(spark, skips("not_article_url", 3), found=1, new=1) == [] and codes(spark, skips("no_title", 3)) == ["rows_untitled"]
    (r,) = told(spark, fails("schema_detection") + skips("not_article_url", 3), listings={"NEWS": "u/"}, best={"NEWS": "u"})
    assert (r.code, r.patch, r.actions) == ("no_listing_pattern", {}, ["discover_routes", "detect_sitemap"])
    (r,) = told(spark, fails("schema_detection"), sitemap=True, listings={"NEWS": "u"}, best={"NEWS": "u", "NOTICE": "v", "JOB": "w"})
    assert (r.patch, r.actions) == ({"newsListUrl": "u", "noticeListUrl": "v"}, ["discover_routes"])
    assert codes(spark, fails("schema_detection") + fails("listing", "HTTP 400")) == ["listing_url_dead"]


def test_details(spark):
    assert codes(spark, fails("detail", n=3), found=1, new=1) == ["detail_pages_failing"] and codes(spark, fails("detail", n=2), found=1, new=1) == []
    assert codes(spark, fails("detail", n=4), found=9, new=1) == ["detail_pages_failing"] and codes(spark, fails("detail", n=4), found=10, new=1) == []
    assert codes(spark, fails("detail", n=9)) == []


def test_pagination_and_quiet_runs(spark):
    (r,) = told(spark, [], found=3, pagination=("QUERY_PARAM", "page", None), detected=("QUERY_PARAM", "p", 0))
    assert (r.code, r.patch) == ("pagination_mismatch", {"paginationType": "QUERY_PARAM", "paginationParam": "p", "startPage": "0"})
    for detected in (None, ("QUERY_PARAM", "page", 1), ("", "p", None), (None, "p", None)):
        assert codes(spark, [], found=3, pagination=("QUERY_PARAM", "page", None), detected=detected) == ["up_to_date"]
    assert codes(spark, [], found=3, new=1) == [] and codes(spark, [], notes=["a", "b"]) == ["empty_no_errors", "discovery_note", "discovery_note"]
    assert codes(spark, skips("x", 1)) == []


def test_order_by_severity(spark):
    got = told(spark, fails("x", "timeout") + skips("no_title", 3) + fails("schema_detection"), pagination=("A", "p", None), detected=("B", "p", None), notes=["n"])
    assert [r.code for r in got] == ["no_listing_pattern", "site_unreachable", "rows_untitled", "pagination_mismatch", "discovery_note"]
    assert got[-1].note == "n"
