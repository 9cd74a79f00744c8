"""Exact dedup and the Jaccard join against brute force."""

import random

from oracle import DATA, connect, differences

from bulletin.llm import exact_dedup, jaccard
from bulletin.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup_cases(documents):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "a b"), (7, "x" * 100_000), (8, "x" * 99_999 + "y"), (9, "X" * 100_000), (9, "X" * 100_000)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(documents(rows)).collect()}
    assert got == {
        (1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 9, 3, False), (8, 8, 1, True), (9, 9, 3, True),
    }
    kept = sorted((str(r.doc_id), r.text[:3], r.file) for r in exact_dedup.without_copies(documents(rows[:7])).collect())
    assert kept == [("2", "a B", "f"), ("4", "", "f"), ("5", "É", "f"), ("6", "é", "f"), ("None", "a b", "f")]


def test_exact_dedup_empty_table(documents):
    assert exact_dedup.exact_dedup(documents([])).count() == 0
    assert exact_dedup.without_copies(documents([])).count() == 0


def brute(rows, size=5, percent=75):
    sets, ids = [], [i for i, _ in rows]
    for _, t in rows:
        w = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(s), low[find(k)]) for k, (i, s) in enumerate(zip(ids, sets)))


def mutated(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
    return " ".join(words)


def test_jaccard_random(documents):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    bases = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 120))) for _ in range(12)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [mutated(rng, rng.choice(bases), rng.randrange(0, 5)) for _ in range(150)]
    texts += [passage + " " + mutated(rng, rng.choice(bases), 3) for _ in range(60)]
    texts += ["", "one", "One", "one two", "a b c d", "A B\tc\nd", "a b c d e", "a b c d e f", "x " * 5000, "x " * 6000, *texts[:10]]
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(documents(rows)).collect())
    assert got == brute(rows)


def test_jaccard_large_group(documents):
    """A group of which most pairs do not link; the chain and the outsiders must come out exactly."""
    rng = random.Random(9)
    base = " ".join(f"b{i}" for i in range(120))
    rows = [(i, mutated(rng, base, 1 + i % 6)) for i in range(1, 260)]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(documents(rows)).collect())
    assert got == brute(rows)


def test_jaccard_keys_move_once(spark, documents, monkeypatch):
    """Key sets are not stored, and move for their pair alone, once a side, where Spark shuffles all joins."""
    rng, seen = random.Random(3), []
    bases = [" ".join(f"b{rng.randrange(10**6)}" for _ in range(80)) for _ in range(8)]
    rows = [(i, mutated(rng, rng.choice(bases), rng.randrange(0, 6))) for i in range(1, 80)]
    keep = jaccard.stored

    def watched(df, name, *more):
        seen.append((name, df.dtypes, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return keep(df, name, *more)

    monkeypatch.setattr(jaccard, "stored", watched)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(tuple(r) for r in jaccard.near_duplicates(documents(rows)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == brute(rows)
    assert not [name for name, types, _ in seen if "keys" in dict(types)]
    shuffles = [n for name, _, n in seen if name == "jaccard-links"]
    assert len(shuffles) > 1 and max(shuffles) <= 4  # two sides, then pairs a fragment and pairs


def test_jaccard_nulls_and_empty(documents):
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(documents(rows)).collect())
    assert got == [("1", 0, "1"), ("2", 0, "2"), ("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 2, "3")]
    assert jaccard.near_duplicates(documents([])).count() == 0
    assert jaccard.one_per_group(documents([])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_queries_equal_sql(spark):
    con = connect(f"{DATA}/sf0.001")
    assert differences(exact_dedup.op6(spark, f"{DATA}/sf0.001"), con, exact_dedup.ORACLE) == []
    assert differences(jaccard.op9(spark, f"{DATA}/sf0.001"), con, jaccard.ORACLE) == []
