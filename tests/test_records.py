"""Hand-computed cases of crawl bookkeeping and of stored records: nulls, ties, repeats, cycles, empty tables."""

from pyspark.sql import functions as F

from bulletin.operators import crawl, records


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_walk_with_cycle_cutoff_and_limit(spark):
    entries = [("a", 0, "b", 9), ("a", 1, "c", 1), ("a", 2, "d", None), ("b", 0, "a", 9), ("b", 1, "e", 9), ("d", 0, "e", 9), ("e", 0, None, None), ("c", 0, None, None), ("b", 2, "gone", 9)]
    files = spark.createDataFrame(entries, "file string, position int, child string, lastmod int")
    files = files.unionByName(spark.createDataFrame([("d", 1, None, None)], files.schema))
    roots = spark.createDataFrame([("s", "a", 5), ("t", "nowhere", 5)], "source string, file string, since int")
    walk = lambda most: sorted((r.place, r.file) for r in crawl.walked_sitemaps(files, roots, most).collect())
    assert walk(20) == [(0, "a"), (1, "b"), (2, "d"), (3, "e")]
    assert walk(2) == [(0, "a"), (1, "b")]
    assert crawl.walked_sitemaps(files.limit(0), roots).count() == 0


def test_errors_and_categories(spark):
    assert one(spark, crawl.clean_error("e"), e=None) == one(spark, crawl.clean_error("e"), e="") == "Unknown error"
    assert one(spark, crawl.clean_error("e", 5), e=" ab \n cdefg") == "ab cd … (truncated)"
    assert [one(spark, crawl.route_category("c"), c=c) for c in (None, "jobs", "job_2", " bid ")] == ["NOTICE", "NOTICE", "JOB", "TENDER"]
    refined = records.refined_category(F.col("c"), F.col("t"), F.col("u"))
    assert [one(spark, refined, c=c, t=t, u=None) for c, t in (("OTHER", None), ("NOTICE", "Vacancy and TENDER"), ("ACT", "tender"), (None, "news"))] == ["NOTICE", "TENDER", "ACT", None]


def test_vectors_with_nulls_and_repeats(spark):
    index = spark.createDataFrame([(1, "x", [1.0]), (2, "y", [2.0])], "id long, title string, vector array<double>")
    rows = spark.createDataFrame([(2, "new", [3.0], 0), (2, "newer", [4.0], 1), (3, None, [5.0], 0), (None, "t", [6.0], 0), (4, "t", None, 0)], "id long, title string, vector array<double>, position int")
    done = records.upserted_vectors(index, rows)
    assert sorted((r.id, r.title, r.vector) for r in done.collect()) == [(1, "x", [1.0]), (2, "newer", [4.0])]
    assert sorted(r.id for r in records.upserted_vectors(done, rows.limit(0)).collect()) == [1, 2]


def test_files_and_answers(spark):
    items = spark.createDataFrame([(1,), (2,)], "id long")
    children = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, None)], "id long, n int, url string")
    got = {r.id: [f.url for f in r.files] for r in records.with_children(items, children, "id", "n", "files").collect()}
    assert got == {1: [None, "a", "b"], 2: []}
    s = spark.createDataFrame([(1, 0, "Same", 0.9), (1, 1, "same", 0.9), (1, 2, "low", 0.1), (1, 3, "Other", 0.95)], "question int, position int, sentence string, score double")
    assert sorted((r.place, r.position) for r in records.extracted_answer(s).collect()) == [(1, 1), (2, 3)]


def test_appended_and_tokens(spark):
    row = spark.createDataFrame([(["a", "b", "c"], "d"), (None, "d")], "m array<string>, x string")
    assert [r[0] for r in row.select(records.appended(F.col("m"), F.col("x"), 2)).collect()] == [["c", "d"], ["d"]]
    tokens = spark.createDataFrame([("a", 5), ("b", 20)], "token string, expires_at int")
    new = spark.createDataFrame([("b", 30), ("c", 15), ("c", 15)], "token string, expires_at int")
    assert sorted(map(tuple, records.live_tokens(tokens, new, F.lit(10)).collect())) == [("b", 20), ("c", 15)]
