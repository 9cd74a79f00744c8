"""Batches to Python stay small, whatever the table."""

import pytest
from pyspark.sql import functions as F

from bulletin.operators import chunking, extraction, page_tree, retrieval

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def limits(spark):
    """The session's own batch limits, as they were before."""
    before = {k: spark.conf.get(k) for k in (ROWS, BYTES)}
    for k in before:
        spark.conf.unset(k)
    yield spark.conf
    for k, v in before.items():
        spark.conf.set(k, v)


def test_pairs_of_blocks_come_in_small_batches(spark, limits, monkeypatch):
    def sizes(k, floor):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([batch.nbytes]), pa.array([0.0])], names=["query_id", "id", "score"])

        return run

    monkeypatch.setattr(retrieval, "nearest", sizes)
    vectors = spark.range(0, 8192, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x.cast("float")).alias("vector"))
    found = retrieval.dense_topk(vectors.toDF("query_id", "query"), vectors, 1000)
    assert 0 < found.agg(F.max("id")).first()[0] < 16 << 20


@pytest.mark.parametrize(
    "build",
    [
        lambda s: extraction.pages(s.createDataFrame([], "page_id long, url string, html string")),
        lambda s: page_tree.page_trees(s.createDataFrame([], "page_id long, url string, html string")),
        lambda s: chunking.chunk_documents(s.createDataFrame([], "doc_id long, text string")),
        lambda s: chunking.simple_chunks(s.createDataFrame([], "doc_id long, text string")),
    ],
)
def test_whole_texts_come_in_small_batches(spark, limits, build):
    assert build(spark).count() == 0
    assert 0 < int(limits.get(ROWS)) <= 1000 and 0 < int(limits.get(BYTES).rstrip("b")) <= 8 << 20
