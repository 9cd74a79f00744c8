"""Classifiers and the language model: held-out accuracy, formulas, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
from oracle import DATA
from pyspark.sql import functions as F

from bulletin.llm import brown, language, quality

PATH = f"{DATA}/sf0.01"
ENGLISH = ["The ministry has published the notice for the public of this country", "All citizens are asked to read it with great care and respond"]
GERMAN = ["Das Ministerium hat die Bekanntmachung für die Bürger des Landes veröffentlicht", "Alle Einwohner werden gebeten sie mit Sorgfalt zu lesen und zu antworten"]


def test_language_held_out_accuracy(spark):
    told = language.op7(spark, PATH)
    rows = told.join(spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    sure = [r.lang_pred == r.lang for r in rows if r.lang_pred != "und"]
    assert len(sure) > 200 and np.mean(sure) > 0.9
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def labelled(documents):
    rows = [(i, (ENGLISH if i % 2 else GERMAN)[i // 2 % 2]) for i in range(1, 41)]
    return documents(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))


def test_language_odd_texts(documents, hard_texts):
    model = language.train(labelled(documents), F.lit(True))
    got = language.with_language(documents([*hard_texts, (50, "42 !?"), (51, ENGLISH[0]), (52, GERMAN[1])]), model).collect()
    by = {(r.doc_id, r.text): (r.lang_pred, r.lang_score) for r in got}
    assert len(got) == len(hard_texts) + 3 and got[0].asDict().keys() >= {"file", "label", "word"}
    assert by[1, None] == by[2, ""] == by[3, " \t\n"] == by[50, "42 !?"] == ("und", 0.0)
    assert by[51, ENGLISH[0]][0] == "en" and by[52, GERMAN[1]][0] == "de"


def test_language_learns_nothing_from_nothing(documents):
    for rows in ([], [(1, None)], [(1, "words")]):
        docs = documents(rows).withColumn("lang", F.lit(None).cast("string"))
        model = language.train(docs, F.lit(True))
        assert {r.lang_pred for r in language.with_language(docs, model).collect()} <= {"und"}


def test_quality_held_out(spark):
    scored = quality.op8(spark, PATH).join(spark.read.parquet(f"{PATH}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.score for r in scored if r.quality == 1]
    bad = [r.score for r in scored if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in scored)


def test_quality_odd_rows(spark, documents, hard_texts):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(3, None, 0), (None, 1, 0), (4, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(hard_texts)
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.train(docs, known, F.lit(True))
        got = quality.with_quality(docs, model).collect()
        assert len(got) == len(hard_texts) and all(0 <= r.quality_score <= 1 for r in got)
    assert quality.with_quality(documents([]), model).count() == 0


def test_hinge_model_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 20) + (0 if i % 2 else 40), np.arange(7) + quality.GRAMS])).astype(np.int32) for i in range(60)]
    good = np.arange(60) % 2 == 0
    model = quality.fit(rows, good)
    margins = [float(model.weights[p] @ quality.values(p)) + model.bias for p in rows]
    assert np.mean((np.array(margins) > 0) == good) > 0.95


def test_brown_counts_and_base(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    tokens = {r.doc_id: [*r.text.encode().lower().split(), None] for r in docs}
    learn = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1}
    c = Counter(w for i in learn for w in tokens[i])
    n, v = sum(c.values()), len(c)
    got = brown.op5(spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens[r.doc_id]), sum(w in c for w in tokens[r.doc_id]), n, r.doc_id not in learn)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_brown_table_limit_does_not_change_counts(documents, hard_texts):
    """With a table of three words the others go through the join; counts and base stay."""
    docs = documents(hard_texts)
    learn = F.col("doc_id") % 2 == 0
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6))
    small = brown.score_texts(docs, learn, table_words=3, n_classes=4, clustered=2).collect()
    large = brown.score_texts(docs, learn, n_classes=4).collect()
    assert sorted(map(key, small)) == sorted(map(key, large)) and len(small) == len(hard_texts)
    assert all(np.isfinite(r.score) and r.score < 0 for r in [*small, *large])


def test_brown_probabilities_sum_to_one(documents):
    docs = documents([(i, "a b a c d b a e f g") for i in range(6)])
    texts = docs.selectExpr("doc_id", "true AS learn", "cast(text AS binary) AS text")
    vocabulary = brown.word_counts(texts)
    top = [(brown.END, 6), *brown.frequent_words(vocabulary, 100)]
    words, counts = [w for w, _ in top], np.array([c for _, c in top])
    model = brown.fit(brown.sequences(texts, words), words, counts, (int(counts.sum()), len(words)), n_classes=4)
    for before in range(model.log_next.shape[0]):
        inside = sum(10 ** (model.log_next[before, model.classes[i]] + model.log_word[i]) for i in range(len(words)))
        empty = [k for k in range(5) if k not in model.classes[:-1]]
        assert math.isclose(inside + sum(10 ** model.log_next[before, k] for k in empty), 1, rel_tol=1e-6)


def test_brown_words_beyond_the_table_get_classes(documents):
    """Words that the table does not hold come to the classes of the words in whose place they stand."""
    texts = [(i, f"the {'xy'[i % 2]}{i % 40 // 2} {'runs' if i % 2 else 'of'}") for i in range(400)]
    texts += [(1000 + i, f"the {'ab'[i % 2]} {'runs' if i % 2 else 'of'}") for i in range(400)]
    rows = documents(texts).selectExpr("doc_id", "true AS learn", "cast(text AS binary) AS text")
    words = [brown.END, b"the", b"of", b"runs", b"a", b"b"]
    counts = np.array([800, 800, 400, 400, 200, 200])
    model = brown.fit(brown.sequences(rows, words), words, counts, (3200, 46), n_classes=6, clustered=6)
    found = {(i["before"], i["after"], i["class"]) for r in model.placed.collect() for i in r["rare"]}
    assert found == {(1, 2, model.classes[4]), (1, 3, model.classes[5])}


def test_brown_counts_meet_in_blocks(spark, documents, monkeypatch):
    """Contexts of table words come as one row a task and block, whatever their number, and are summed exactly."""
    monkeypatch.setattr(brown, "CODES", 500)
    rng = np.random.default_rng(2)
    docs = documents([(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 200))) for i in range(40)]).repartition(2)
    words = [brown.END, *(b"w%d" % i for i in range(300))]
    rows = brown.sequences(docs.selectExpr("doc_id", "true AS learn", "cast(text AS binary) AS text"), words).localCheckpoint()
    width, ids = 301, {r.doc_id: np.frombuffer(r.ids, np.int32) for r in rows.collect()}
    expected = Counter(int(b) * width + int(a) for x in ids.values() for a, b in zip([0, *x[:-1]], x))
    blocks = brown.in_blocks(rows.select("ids"), brown.beside(lambda before, own: own.astype(np.int64) * width + before), width)
    assert blocks.groupBy("block").count().count() == brown.BLOCKS
    got = brown.summed_blocks(blocks, brown.code_counts, "code long, n long").collect()
    assert {r.code: r.n for r in got} == expected and len(got) == len(expected)


def test_brown_table_is_filled_when_counts_tie(spark):
    vocabulary = spark.createDataFrame([(b"%d" % i, 3) for i in range(5000)] + [(b"x" * 100, 9)], "word binary, c long")
    got = brown.frequent_words(vocabulary, 2000)
    assert 1900 < len(got) <= 2000 and got[0] == (b"x" * 100, 9)


def test_brown_empty_and_untrained(documents):
    assert brown.score_texts(documents([]), F.lit(True)).count() == 0
    got = brown.score_texts(documents([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0), (1, 0, 0)}
    assert all(np.isfinite(r.score) for r in got)


def test_exchange_groups_alike_words():
    """Words that stand in the same contexts come together."""
    rng = np.random.default_rng(0)
    sequence = [0]
    for _ in range(4000):
        sequence += [1 + rng.integers(3), 4 + rng.integers(3)]
    b = np.zeros((7, 7), np.int64)
    np.add.at(b, (sequence[:-1], sequence[1:]), 1)
    c = brown.exchange(b, 3)
    assert len(set(c[1:4])) == len(set(c[4:7])) == 1 and c[1] != c[4]
