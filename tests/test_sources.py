"""Files, streams and longer hand-computed cases."""

import hashlib

from pyspark.sql import functions as F

from bulletin.functions import text
from bulletin.operators import ingest, upkeep
from bulletin.sources import files
from bulletin.streaming import views


def test_files(spark, tmp_path):
    made = {"a.txt": "grüß".encode(), "b.txt": "grüß".encode("latin-1"), "c.bin": b"%PDF-1.7 x", "d.html": b"<p>x</p>", "e.dat": b"\x00\x01"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.files(spark, str(tmp_path)).collect()}
    assert {n: r.mime for n, r in got.items()} == {"a.txt": "text/plain", "b.txt": "text/plain", "c.bin": "application/pdf", "d.html": "text/html", "e.dat": None}
    assert got["a.txt"].text == got["b.txt"].text == "grüß" and got["c.bin"].text is None
    assert got["e.dat"].refused == "unknown type" and got["a.txt"].refused is None
    assert got["a.txt"].file_hash == hashlib.sha256(made["a.txt"]).hexdigest()


def test_changed_pages(spark):
    seen = spark.createDataFrame([("u", "1"), ("v", "2"), ("w", None)], "url string, validator string")
    state = spark.createDataFrame([("u", "1"), ("v", "1")], "url string, validator string")
    assert sorted(r.url for r in files.changed(seen, state).collect()) == ["v", "w"]


def test_stream_upsert_twice(spark, tmp_path):
    """A second run over the same folder takes only what is new."""
    schema = "position long, url string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ([(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = views.read(spark, source)
        ingest.upsert_batches(stream, out, state).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (3, "b"), (5, "c")]


def test_template_and_html(spark):
    row = spark.range(1).select(text.template("{{#a}}[{{a}}]{{/a}}{{b}}", a=F.lit(None).cast("string"), b=text.html_escaped(F.lit("<&'\">")))).first()
    assert row[0] == "&lt;&amp;&#39;&quot;&gt;"


def test_small_talk_and_bots(spark):
    rows = spark.createDataFrame([("Helllo!!",), ("thank  you",), ("What is the fee?",), (None,)], "x string")
    assert [r[0] for r in rows.select(text.small_talk("x")).collect()] == [True, True, False, False]
    assert [r[0] for r in rows.select(text.bot_agent("x")).collect()] == [False, False, False, True]


def test_page_adds_new(spark):
    pages = spark.createDataFrame([(1, 2, 10, 3), (1, 3, 10, 2), (1, 4, 20, 4), (1, 5, 0, 0)], "source int, page int, items int, fresh int")
    assert [r.goes_on for r in upkeep.adds_new(pages).orderBy("page").collect()] == [True, False, False, False]
    assert [r.goes_on for r in upkeep.adds_new(pages, deep=True).orderBy("page").collect()] == [True, True, True, False]


def test_stream_totals_twice(spark, tmp_path):
    """A second run over the same folders changes only the keys that it meets."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part, want in (([("a",), ("a",), ("b",)], [("a", 2), ("b", 1)]), ([("a",), ("c",)], [("a", 3), ("b", 1), ("c", 1)])):
        spark.createDataFrame(part, "k string").coalesce(1).write.mode("append").parquet(source)
        totals = views.read(spark, source).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(tuple, views.upserted(totals, out, state, ["k"]).collect())) == want
