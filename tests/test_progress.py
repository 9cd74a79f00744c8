"""Stage progress: its rules by hand, and a stream that reports to it."""

import time

from bulletin.operators import accounts
from bulletin.streaming.progress import StageProgress


def test_percent_never_falls():
    p = StageProgress({"d/extracting": 100, "d/embedding": 10})
    p.started("r1", "d/extracting")
    assert p.shown("d") == ("extracting", 8)  # 2 + 43 * 0.15
    p.advanced("r1", 0, 50)
    assert p.shown("d") == ("extracting", 24)
    p.advanced("r1", 0, 50)  # the batch ran again
    assert p.shown("d") == ("extracting", 24)
    p.started("r2", "d/embedding")
    p.advanced("r1", 1, 50)  # late report of an earlier stage
    assert p.shown("d") == ("embedding", 54)
    p.advanced("r2", 0, 30)  # more than was expected
    assert p.shown("d") == ("embedding", 90)
    p.ended("r1", None)
    p.ended("r2", None)
    assert p.shown("d") == ("embedding", 90)
    p.started("r3", "d/indexing")
    p.ended("r3", None)
    assert p.shown("d") == ("done", 100)


def test_failures_restarts_and_strangers():
    p = StageProgress()
    for name in (None, "x", "d/unknown", "/chunking"):
        p.started("r0", name)
    p.advanced("r0", 0, 5)
    p.ended("r0", "lost")
    assert p.works == {}
    p.started("r1", "a/b/chunking")
    p.advanced("r1", 0, 5)
    assert p.shown("a/b") == ("chunking", 45)
    p.ended("r1", "lost")
    assert p.shown("a/b") == ("failed", 45) and p.works["a/b"].error == "lost"
    p.started("r2", "a/b/queued")
    assert p.shown("a/b") == ("queued", 2)
    p.forget("a/b")
    p.advanced("r2", 0, 1)
    assert p.shown("a/b") is None


def test_stream_reports(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "in"))
    listener = StageProgress({"doc/chunking": 40, "doc/indexing": 40})
    spark.streams.addListener(listener)
    try:
        for stage, want in (("chunking", ("chunking", 48)), ("indexing", ("done", 100))):
            rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            writer = rows.writeStream.format("noop").queryName(f"doc/{stage}").option("checkpointLocation", str(tmp_path / stage))
            writer.trigger(availableNow=True).start().awaitTermination()
            last = time.monotonic() + 20
            while listener.shown("doc") != want and time.monotonic() < last:
                time.sleep(0.1)
            assert listener.shown("doc") == want
        assert listener.works["doc"].rows == {"chunking": 40, "indexing": 40}
    finally:
        spark.streams.removeListener(listener)


def test_batch_progress(spark):
    steps = [("queued", None), ("extracting", 0.5), ("extracting", None), ("odd", 0.5), ("chunking", 0.5), ("extracting", 1.0), ("embedding", 2.0), ("failed", None), ("indexing", 0.05), ("done", None)]
    rows = [("a", i, *s) for i, s in enumerate(steps)] + [("b", 0, "failed", None), ("b", 1, "queued", -1.0)]
    df = spark.createDataFrame(rows, "job string, seq int, stage string, share double")
    got = {(r.job, r.seq): r.percent for r in accounts.progress(df).collect()}
    assert [got["a", i] for i in range(10)] == [0, 24, 24, 24, 46, 46, 90, 90, 90, 100]
    assert [got["b", i] for i in range(2)] == [None, 0]
