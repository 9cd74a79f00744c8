"""Benchmark decontamination against brute force and hand-made cases."""

import random
import re

from oracle import DATA, connect, differences

from bulletin.llm import decontamination as d

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, size=10):
    """(words, hit words, items, [start, end) of the hit stretches) by trying every item at every place."""
    places = list(WORDS.finditer((text or "").translate(LOWER)))
    words, hit, found = [m[0] for m in places], set(), set()
    for item, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        if item is None or not w:
            continue
        n = min(size, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found), {(places[i].start(), places[i].end()) for i in hit}


def held(spark, documents, rows, items, **options):
    docs, bench = documents(rows), spark.createDataFrame(items, "item_id long, text string")
    got = d.decontaminated(docs, bench, **options).collect()
    assert len(got) == len(rows) and "file" in got[0].asDict()
    for r in got:
        n, n_hit, found, stretches = brute(r.text, items)
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == (n, n_hit, found), r.doc_id
        assert all(any(s.start <= a and b <= s.end for s in r.hits.spans) for a, b in stretches)
        for s in r.hits.spans:
            assert len(WORDS.findall(r.text[s.start : s.end].translate(LOWER))) == s["last"] - s["first"] + 1
        assert all(a["last"] < b["first"] for a, b in zip(r.hits.spans, r.hits.spans[1:]))


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (10, "Ünïcode — wörds, 42!"), (3, None), (4, " .,;"), (None, "one two"),
         (5, "two three four five six seven eight nine ten eleven"), (1, "second row of item one"), (6, "a a a a a a a a a a a a")]
TEXTS = ["", None, "One, two; three four FIVE six seven eight nine ten eleven twelve", "one two three four five six seven eight nine", "x short-item y short  item short", "ünïcode\nwörds 42 ÜNÏCODE wörds 42",
         "a " * 30, "second row of item one", "One two three four five six seven eight nine ten zwei one two three four five six seven eight nine ten eleven", "é中\n🎓 short item 🎓"]


def test_cases(spark, documents):
    rows = [*enumerate(TEXTS, 1), (4, TEXTS[3]), (4, TEXTS[3]), (None, TEXTS[2])]
    held(spark, documents, rows, ITEMS)
    held(spark, documents, rows, ITEMS, most_pairs=3)


def test_random_texts_by_one_and_by_several_automata(spark, documents):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(6)] + ["É", "ß9"]
    some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(40)]
    rows = [(i, some(rng.randrange(0, 60)) + " " + rng.choice(items)[1].upper() + " " + some(5)) for i in range(60)]
    held(spark, documents, rows, items)
    held(spark, documents, rows, items, most_pairs=100)


def test_pieces_keep_the_state():
    found = d.Windows([(b"b c d", ["1"]), (b"c", ["2"]), (b"x" * 50, ["3"])])
    text = b"a b c d " * 1000 + b"x" * 50
    d_pieces, n = d.pieces, found.find(text)
    try:
        d.pieces = lambda t: d_pieces(t, 7)
        m = found.find(text)
    finally:
        d.pieces = d_pieces
    assert n[0] == m[0] == 4001 and (n[1] == m[1]).all() and (n[2] == m[2]).all() and n[1].shape[1] == 2001


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.decontaminated(documents([]), bench).count() == 0
    (row,) = d.decontaminated(documents([(1, "one two")]), bench.limit(0)).collect()
    assert (row.hits.n_words, row.hits.n_hit, row.hits["items"], row.hits.spans) == (2, 0, [], [])
    docs = documents([(1, "short item")]).withColumnsRenamed({"file": "hits", "label": "text_bytes", "word": "row"})
    (row,) = d.decontaminated(docs, bench, most_pairs=2).collect()
    assert (row.hits, row.text_bytes, row.row, row.hits_.n_hit) == ("f", "l", "w", 2)


def test_hard_texts(spark, documents, hard_texts):
    held(spark, documents, hard_texts, ITEMS)


def test_query_equals_sql(spark):
    assert differences(d.op11(spark, f"{DATA}/sf0.001"), connect(f"{DATA}/sf0.001"), d.ORACLE) == []
