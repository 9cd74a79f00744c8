"""The corpus pipeline against a plain version built of its stages' own decisions."""

import zlib

import corpus_pipeline as pipeline
from oracle import DATA

from bulletin.llm import language, quality
from bulletin.llm.common import id_bucket, table
from test_copies import brute
from test_tokens import check_packing

PATH = f"{DATA}/sf0.001"


def test_run_equals_plain_version(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, PATH, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    q = quality.train(docs, table(spark, PATH, "labels"), id_bucket("doc_id", 3) != 1)
    rows = {i: t for i, t in rows.items() if q.scores([t])[0] >= 0.5}
    names = {r.doc_id: r.lang for r in docs.collect()}
    learn = [i for i in sorted(rows) if zlib.crc32(str(i).encode()) % 4 != 2]
    model = language.fit([rows[i] for i in learn], [names[i] for i in learn])
    told = dict(zip(rows, zip(*model.predict(list(rows.values())))))
    rows = {i: t for i, t in rows.items() if told[i][0] != "und" and told[i][1] >= 0.5}
    last = {t.encode().lower(): i for i, t in sorted(rows.items())}
    rows = {i: rows[i] for i in last.values()}
    rows = {i: rows[i] for i, _, c in brute(sorted(rows.items())) if i == c}
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pipeline.run(spark, PATH).collect()
    assert check_packing(got, rows, lambda t: encoder.encode(t, add_special_tokens=False).ids, 1024) > 0.95


def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, PATH, "documents")
    labels = table(spark, PATH, "labels").where("quality = 1")
    clean = docs.join(labels, "doc_id", "left_semi").count()
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, PATH)
        assert out.columns == docs.columns
    kept = pipeline.good_quality(spark, docs, PATH)
    assert kept.join(labels, "doc_id", "left_semi").count() > 0.9 * clean
    assert pipeline.known_language(spark, docs, PATH).count() > 0.95 * docs.count()


def test_empty_input(spark):
    docs = table(spark, PATH, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, PATH).count() == 0
