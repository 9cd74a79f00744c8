"""Hand-computed cases of the operators."""

import datetime as dt
import random
import re

import numpy as np
from pyspark.sql import functions as F

from bulletin.functions import dates, hashing, text, urls
from bulletin.operators import accounts, catalogue, chunking, classify, extraction, ingest, keyword, retrieval, rules, scheduling
from bulletin.sources.tables import effective_date


def values(spark, column, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(column("x")).collect()]


def test_effective_date(spark):
    d = dt.datetime
    rows = spark.createDataFrame(
        [(None, d(2024, 1, 5)), (d(2026, 1, 6), d(2024, 1, 5)), (d(2023, 1, 1), d(2024, 1, 5))], "published_at timestamp_ntz, scraped_at timestamp_ntz"
    )
    assert [r[0] for r in rows.select(effective_date()).collect()] == [d(2024, 1, 5), d(2024, 1, 5), d(2023, 1, 1)]


def test_quality(spark):
    latin = "zebra quokka " * 12
    deva = "अआइईउऊऋ " * 10
    got = values(spark, text.quality, "short", latin, deva, None)
    assert got == [0.0, 0.6, 1.0, 0.0]


def test_quality_thresholds(spark):
    prose = "the tender of water " * 10  # 40 words, half of them stop words, a quarter of two letters
    split = "to at zebra quokka " * 10  # half of the words have two letters
    mixed = "अ" * 60 + "b" * 40
    got = values(spark, text.quality, prose, split, mixed, " " * 60 + "x", "x " * 30)
    assert [round(x, 6) for x in got] == [0.85, 0.4, 0.5, 0.0, 0.6]
    assert values(spark, text.readable, "O:12(3.5A " * 10, "अ१२३ " * 20, "short") == [False, True, False]


def test_titles_and_squeeze(spark):
    assert values(spark, text.storable_title, "(untitled)", "अआइईउऊऋ", "Tender notice", None) == [False, False, True, False]
    assert values(spark, text.squeezed, "Helllloooooo") == ["helo"]
    assert values(spark, text.title_like, " - Read more - ", "Budget speech:") == [False, True]


def test_sentences_and_trim(spark):
    assert values(spark, text.sentences, "This is a full sentence here. tiny. Another sentence of good length!") == [
        ["This is a full sentence here.", "Another sentence of good length!"]
    ]
    assert values(spark, lambda c: text.trimmed_words(c, 10), "short", "a longer text", "unbreakabletext") == ["short", "a longer…", "unbreakabl…"]


def test_urls(spark):
    assert values(spark, urls.normalised, "https://Example.COM/path/?b=2&a=1#x", "nothing", None) == ["https://example.com/path?a=1&b=2", None, None]
    assert values(spark, urls.article_reason, "https://a.b/news/x", "https://a.b/f.pdf", "https://a.b/", "https://a.b/tag/x", "https://a.b/en/about-us", "https://a.b/?page_id=4", "https://a.b/n?search_x=2", "ftp://a.b/x", "https://facebook.com/a", None) == [
        "article", "file", "home page", "taxonomy", "static", "query only", "filter", "scheme", "offsite", "scheme"]
    near = lambda c: urls.article_reason(c, F.lit("https://www.nrb.org/list"), ["https://www.nrb.org/all/"])
    assert values(spark, near, "https://bfr.nrb.org/x/1", "https://other.org/x/1", "https://www.nrb.org/list/", "https://www.nrb.org/all#x") == ["article", "other host", "listing", "listing"]
    assert values(spark, urls.page_number, "/x?page=12", "/page/3", "/x") == [12, 3, None]
    assert values(spark, urls.category, "https://a.b/tender/1", "https://a.b/my-vacancy-list", "https://a.b/x") == ["TENDER", "VACANCY", None]


def test_dates(spark):
    assert [str(v)[:10] for v in values(spark, dates.parsed, "२०२४-०२-०३", "3 Feb 2024", "nonsense")] == ["2024-02-03", "2024-02-03", "None"]


def test_sentence_units_by_line(spark):
    text_of = "NOTICE FACTS:\n- deadline: the fifth of May 2024\n• short\n  ● lower case facts stay as they are\nThe office is closed on Monday. and this part starts small! Everyone else has to come back later on.\nélan at the start of a line is lower case\nA heading that is long enough to be one:"
    assert values(spark, text.sentences, text_of, None) == [["deadline: the fifth of May 2024", "lower case facts stay as they are", "The office is closed on Monday.", "Everyone else has to come back later on."], None]


def test_accepted_text(spark):
    rows = [(0.5, 10, 0.9, 0, "EMPTY"), (0.9, 10, 0.55, 5, "CLEAN"), (0.5, 39, 0.5, 40, "IMPROVED"), (0.5, 40, 0.5, 40, "LOW_QUALITY"), (0.54, 10, 0.5, 60, "IMPROVED"), (0.54, 10, 0.49, 60, "LOW_QUALITY"), (None, None, 0.1, 1, "IMPROVED")]
    df = spark.createDataFrame(rows, "a double, b int, c double, d int, want string").select(ingest.accepted_text(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_setting_kinds(spark):
    good = [("boolean", "true"), ("number", "25"), ("number", " "), ("select", "a"), ("text", " x"), ("secret", " 0123456789"), ("order", "b, a"), ("cron", "0 3 * * 1"), ("other", "")]
    bad = [("boolean", "TRUE"), ("number", "-1"), ("number", "101"), ("number", "7"), ("number", "Infinity"), ("number", "x"), ("select", ""), ("textarea", " \n"), ("secret", "012345678"), ("order", ","), ("order", "a,a"), ("order", "z"), ("cron", "* *")]
    df = spark.createDataFrame(good + bad, "k string, v string")
    fits = accounts.valid(F.col("k"), F.col("v"), F.array(F.lit("a"), F.lit("b")), F.lit(0.0), F.lit(100.0), F.lit(5.0))
    assert [(r.k, r.v, r.ok) for r in df.select("k", "v", fits.alias("ok")).collect()] == [(*x, True) for x in good] + [(*x, False) for x in bad]


def test_batch_run_keeps_known_categories(spark):
    rows = [("सहायक स्तर", None, None, None, "JOB"), ("पदपूर्ति", None, None, None, "VACANCY"), ("x", "https://a.b/Tender-4", None, "NEWS", "TENDER"), ("x", None, "the tender", "NEWS", "NEWS"), ("x", None, "ठेक्का", "OTHER", "TENDER"),
            ("x", None, "x" * 1200 + "ठेक्का", "OTHER", "NOTICE"), ("x", None, "समाचार", None, "NEWS"), ("x", None, "news", None, "NOTICE"), (None, None, None, None, "NOTICE")]
    df = spark.createDataFrame(rows, "t string, u string, c string, k string, want string").select("t", classify.reclassified("t", "u", "c", "k").alias("got"), "want")
    assert [r.got for r in df.collect()] == [r[-1] for r in rows]


def plain_window(q, now):
    """(as_of, from, to) by the rules of question windows, with Python's own dates."""
    token = r"(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|[a-z]{3,9}\.?\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?|\d{1,2}(?:st|nd|rd|th)?\s+[a-z]{3,9}\.?(?:,?\s+\d{4})?)"
    ago = dt.timedelta

    def make(y, m, d):
        try:
            return dt.date(int(y), int(m), int(d))
        except ValueError:
            return None

    def read(t):
        if re.fullmatch(r"\d+[-/]\d+[-/]\d+", t):
            return make(*re.split("[-/]", t))
        month, day = re.search("[a-z]{3,9}", re.sub(r"(?<=\d)(st|nd|rd|th)", "", t))[0], re.search(r"(?<!\d)\d{1,2}(?!\d)", t)[0]
        year, m = re.search(r"\d{4}$", t), dates.MONTHS.get(month)
        if not m:
            return None
        if year:
            return make(year[0], m, day)
        d = make(now.year, m, day)
        return make(now.year - 1, m, day) if d and d > (now + ago(3)).date() else d

    about, today, q = lambda d: (d, d - ago(30), d + ago(3)), now.date(), q.lower()
    if (m := re.search(rf"between\s+({token})\s+and\s+({token})", q)) and read(m[1]) and read(m[2]):
        return None, *sorted((read(m[1]), read(m[2])))
    if (m := re.search(rf"(?:since|after|from)\s+({token})", q)) and read(m[1]):
        return None, read(m[1]), None
    if (m := re.search(rf"(?:before|until|till|up to)\s+({token})", q)) and read(m[1]):
        return None, None, read(m[1])
    for word, back in (("yesterday", 1), ("today", 0)):
        if re.search(rf"\b{word}\b", q):
            return about(today - ago(back))
    if m := re.search(r"\b(?:last|past|previous)\s+(\d{1,2}\s+days?|week|month)\b", q):
        return None, today - ago({"week": 7, "month": 30}.get(m[1]) or int(m[1].split()[0])), None
    return next((about(d) for m in re.findall(token, q) if (d := read(m))), (None, None, None))


def test_question_windows(spark):
    now, rng = dt.datetime(2024, 3, 1, 9), random.Random(1)
    day = lambda: rng.choice(["2024-02-29", "2023/2/29", "feb 30", "29 feb", "Sept. 2nd", "2 september, 2021", "mar 4", "march 5", "flood 2", "31 december", "1st may 2020", "market 7", "12 12"])
    shapes = ["between {} and {}", "since {} {}", "from {} until {}", "before {}", "up to {} today", "yesterday {}", "today's {}", "last 3 days {}", "past  12 day", "previous week", "last month {}", "{} or {}", "todays", "this week", "last 123 days"]
    asked = [rng.choice(shapes).format(day(), day()) for _ in range(300)] + ["what came on feb 30?", "", "latest news"]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", dates.question_window("q", str(now)).alias("w")).collect()
    assert [(r.q, tuple(r.w)) for r in rows] == [(q, plain_window(q, now)) for q in asked]


def test_intent(spark):
    now = "2024-09-04 12:00:00"
    found = keyword.intent(spark, "latest tender notices", now)
    assert (found.terms, found.recent, found.category, found.window) == ([], True, "TENDER", None)
    found = keyword.intent(spark, "Job market decisions, tender marriage since march 5: शिक्षक शिक्षक", now)
    assert (found.terms, found.recent, found.category, found.window) == (["market", "decisions", "tender", "marriage", "since", "शिक्षक"], False, "JOB", (dt.date(2024, 3, 5), None))
    assert keyword.intent(spark, "what happened in march", now).terms == ["happened", "march"]


def test_hashes(spark):
    row = spark.range(1).select(hashing.content_hash(F.lit("a"), F.lit(None)).alias("h"), F.sha2(F.lit("a|"), 256).alias("w")).first()
    assert row.h == row.w
    import uuid

    assert spark.range(1).select(hashing.uuid5(F.lit("doc:1"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:1"))


def test_chunk_sections():
    body = "# A\n\n## B\n\ntext"
    assert chunking.blocks(body)[-1].section == "A > B"
    assert chunking.blocks(body, compat=True)[-1].section == "B"


def test_chunk_bounds():
    words = " ".join(f"word{i}." for i in range(900))
    got = chunking.chunks(words, 200, 40)
    assert all(len(c["content"]) <= 241 for c in got) and len(got) > 30
    assert chunking.chunks("", 200, 40) == [] and [c["index"] for c in got] == list(range(len(got)))


def test_chunk_blocks():
    body = "---PAGE 3---\n| a | b |\n| 1 | 2 |\n\n```\n# not a header\n```\n- one\n- two\n"
    got = chunking.chunks(body, 800, 0)
    assert len(got) == 1 and got[0]["page"] == 3
    assert got[0]["block_types"] == ["code", "list", "table"]


def test_merge_adjacent(spark):
    rows = spark.createDataFrame([(1, 0, "s", "a", 0.9), (1, 2, "s", "c", 0.8), (1, 1, "s", "b", 0.7), (1, 4, "s", "e", 0.9)], "doc int, index int, section string, content string, score double")
    got = sorted((r["first"], r["last"], r["content"]) for r in retrieval.merged(rows).collect())
    assert got == [(0, 2, "a\nb\nc"), (4, 4, "e")]


def test_selected_compares_whole_squeezed_content(spark):
    head = "x" * 60
    rows = [(1, 0, 0.9, f"{head} a  b"), (2, 0, 0.85, f" {head}\n A\tb\u00a0"), (3, 0, 0.8, f"{head} other")]
    got = retrieval.selected(spark.createDataFrame(rows, "doc long, index long, score double, content string"), 10)
    assert [r["doc"] for r in got.collect()] == [1, 3]


def test_fusion(spark):
    leg = lambda *ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, rank long")
    got = retrieval.fused([leg("x", "y"), leg("y")]).orderBy(F.desc("fused")).collect()
    assert [r.id for r in got] == ["y", "x"]


def test_empty_scope_gives_nothing(spark):
    rows = spark.range(5)
    assert retrieval.scoped(rows, spark.range(0), "id").count() == 0


def test_rules(spark):
    notice = spark.createDataFrame([(1, "Tender for water", "body", "TENDER", "src", "HIGH")], "id int, title string, content string, category string, source_label string, urgency string")
    schema = "rule_id int, user_id int, created_at int, categories array<string>, keywords array<string>, sources array<string>, exclude array<string>, min_urgency string, frequency string"
    made = spark.createDataFrame(
        [(1, 1, 1, ["TENDER"], ["Water"], [], [], None, "DAILY"), (2, 1, 0, [], [], [], [], "LOW", "DAILY"), (3, 2, 0, ["TENDER"], [], [], ["WATER"], None, "DAILY"), (4, 3, 0, [], [], [], [], None, "DAILY")],
        schema,
    )
    hits = rules.matches(notice, made)
    assert sorted(r.rule_id for r in hits.collect()) == [1, 2]
    assert [r.rule_id for r in rules.first_per_user(hits).collect()] == [2]


def test_rule_dimensions(spark):
    """Tags, part of the office's name, a deadline ahead, and the order of a rule's own words."""
    notice = spark.sql("""SELECT 1 AS id, 'Road works' AS title, 'call for bids' AS content, 'TENDER' AS category, 'portal' AS source_label, 'low' AS urgency,
        array('Roads', 'Kathmandu') AS tags, 'Department of Roads' AS organisation, timestamp_ntz'2024-01-10 00:00:00' AS deadline""")
    schema = "rule_id int, categories array<string>, tags array<string>, keywords array<string>, sources array<string>, exclude array<string>, min_urgency string, deadline_days int"
    made = spark.createDataFrame(
        [(1, [], ["x", "roads"], [], [], [], None, None), (2, [], [], [], ["OF ROADS"], [], None, None), (3, [], [], [], [], [], None, 5), (4, [], [], [], [], [], None, 4),
         (5, [], [], ["bids", "ROAD"], [], [], None, None), (6, ["NEWS"], [], ["bids"], [], [], None, None), (7, [], [], [], [], [], "MEDIUM", None), (8, [], [], [], [], ["nothing"], "LOW", None)],
        schema,
    )
    got = {r.rule_id: r for r in rules.matches(notice, made, "2024-01-05").collect()}
    assert sorted(got) == [1, 2, 3, 5, 8]
    assert (got[1].hit_tag, got[2].hit_source, got[5].hit_keyword) == ("roads", "OF ROADS", "bids")


def test_classify(spark):
    from bulletin.operators import classify

    rows = [
        ("बोलपत्र आह्वान", None, None, None), ("x", "https://a.b/career/12", None, None), ("x", "https://a.b/vacancy", None, None), ("plain words", "https://a.b/page/7", "press_list", None),
        ("plain words", None, "other", "आजको सूचना: प्रेस नोट जारी"), ("plain words", None, None, None), ("Annual Report", "https://a.b/x", "TENDER", None), (None, None, "Unheard", None),
    ]
    df = spark.createDataFrame(rows, "title string, url string, route string, text string")
    got = [tuple(r[0]) for r in df.select(classify.classify("title", "url", "route", "text")).collect()]
    assert got == [
        ("TENDER", 0.95, None), ("JOB", 0.95, "career"), ("VACANCY", 0.95, "vacancy"), ("PRESS_RELEASE", 0.8, "page"), ("PRESS_RELEASE", 0.75, None),
        ("NOTICE", 0.5, None), ("NEWS", 0.9, "x"), ("NOTICE", 0.8, None),
    ]


def test_simple_chunks_and_paragraphs(spark):
    body = "One two three. Four five six.\n\nseven eight\n \nnine"
    assert list(chunking.simple_pieces(body, 16, 5)) == [(0, "One two three."), (9, "hree.\nFour five six."), (24, "six.\nseven eight"), (35, "eight\nnine")]
    got = list(chunking.simple_pieces(body, 16, 0))
    assert got == [(0, "One two three."), (14, "Four five six."), (28, "seven eight\nnine")]
    assert list(chunking.simple_pieces("a" * 30 + " bb cc", 10, 0)) == [(0, "a" * 30), (30, "bb cc")]
    twice = "A paragraph that is long enough\n\nshort\n\nA  paragraph that is\nlong enough\n\nshort"
    df = spark.createDataFrame([(1, twice)], "id int, text string")
    row = chunking.deduped_paragraphs(df, "id", "text").first()
    assert (row.paragraphs, row.text) == (3, "A paragraph that is long enough\n\nshort\n\nshort")


def test_backoff(spark):
    got = spark.range(1).select(scheduling.wait_seconds(F.lit(60), F.lit(3)), scheduling.wait_seconds(F.lit(900), F.lit(9))).first()
    assert tuple(got) == (480, 21600)


def test_ingest_twice_is_unchanged(spark):
    items = spark.createDataFrame([(1, "u1", "A fine long title", "body", [])], "position int, url string, title string, content string, attachments array<string>")
    known = items.select("url", "attachments", hashing.content_hash(F.col("title"), F.col("content")).alias("content_hash"))
    assert [r.outcome for r in ingest.outcomes(items, known).collect()] == ["unchanged"]
    assert [r.outcome for r in ingest.outcomes(items, known.limit(0)).collect()] == ["new"]


def test_page_parse():
    got = extraction.read_page("https://a.b/x/", "<title>T</title><nav><a href='/n'>N</a></nav><article><h1>Head</h1><p>Body  text<br>more</p><a href='y.pdf'>F</a></article><script>no</script>")
    assert got["title"] == "Head" and got["main"] == "Head\nBody text\nmore\nF"
    assert got["links"] == [("https://a.b/n", "N", True), ("https://a.b/x/y.pdf", "F", False)]
    assert extraction.read_page(None, None)["title"] is None


def test_order_is_checked(spark):
    import pytest

    with pytest.raises(ValueError):
        catalogue.ordered(spark.range(1), "drop table")


def test_dense_topk_equals_brute_force(spark):
    """Many small blocks, ties by copies of a vector, and rows without a vector."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    vectors = {i: base[i % 25 if i < 60 else i - 60 + 20] for i in range(80)}
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    data = spark.createDataFrame([*rows, (99, None)], "id long, vector array<float>").repartition(3)
    queries = spark.createDataFrame([*rows[::7], (98, None)], "query_id long, query array<float>").repartition(2)
    got = {}
    for r in retrieval.dense_topk(queries, data, 5, block=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    want = {}
    for q in range(0, 80, 7):
        scores = sorted((-round(float(vectors[q].astype(float) @ v.astype(float)), 6), i) for i, v in vectors.items())
        want[q] = [(n, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert retrieval.dense_topk(queries.limit(0), data, 5).count() == 0
    assert retrieval.dense_topk(queries, data, 5, floor=1e6).count() == 0


def test_placed_numbers_all_rows(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id")).repartition(9)
    assert {r["id"]: r["place"] for r in catalogue.placed(rows, F.desc("id")).collect()} == {i: 1000 - i for i in range(1000)}
    assert catalogue.placed(rows.limit(0), F.asc("id")).count() == 0


def test_selected_compares_whole_contents(spark):
    """A shared prefix is no copy; white space and case do not matter."""
    head = "x" * 80
    rows = [(1, 0, 0.9, head + " One"), (2, 0, 0.8, head + " two"), (3, 0, 0.79, head + "\t one ")]
    got = retrieval.selected(spark.createDataFrame(rows, "doc long, index long, score double, content string"), 10)
    assert [r["doc"] for r in got.collect()] == [1, 2]
