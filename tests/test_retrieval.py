"""Filtered legs of the search: brute force and hand cases."""

import numpy as np

from bulletin.operators import retrieval as ops

QUESTION = "query_id long, query array<float>, category string, first_day string, last_day string, terms array<string>"
POINT = "id long, vector array<float>, category string, day string, text string"


def at(cosine):
    return [float(cosine), float((1 - cosine * cosine) ** 0.5)]


def question(i, category=None, first=None, last=None, terms=None):
    return (i, [1.0, 0.0], category, first, last, terms)


def test_category_topk_is_that_of_brute_force(spark):
    rng = np.random.default_rng(2)
    made = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.integers(-3, 4, (n, 4)) + 0.5).astype(np.float32)
    kinds = ["A", "B", None]
    v, q = made(300), made(30)
    points = [(i, x.tolist(), "A" if i % 3 else kinds[i % 7 % 3], None, None) for i, x in enumerate(v)] + [(900, None, "A", None, None)]
    asked = [(i, x.tolist(), [*kinds, "none"][i % 4], None, None, None) for i, x in enumerate(q)]
    scores = np.round(q.astype(float) @ v.astype(float).T, 6)
    want = set()
    for i, row in enumerate(asked):
        seen = [j for j in range(300) if row[2] is None or points[j][2] == row[2]]
        for rank, j in enumerate(sorted(seen, key=lambda j: (-scores[i, j], j))[:7]):
            want.add((i, j, float(scores[i, j]), rank))
    p, a = spark.createDataFrame(points, POINT).repartition(3), spark.createDataFrame(asked, QUESTION)
    for block in (1024, 16):
        got = ops.category_topk(a, p, 7, block=block).select("query_id", "id", "score", "rank").collect()
        assert set(map(tuple, got)) == want and len(got) == len(want)
    assert ops.category_topk(a, p.limit(0), 7).count() == ops.category_topk(a.limit(0), p, 7).count() == 0


def test_notice_leg_window_and_fallback(spark):
    points = [(1, at(0.95), "A", "2024-01-10", ""), (2, at(0.94), "A", None, ""), (3, at(0.90), "B", "2024-03-01", ""), (4, at(0.85), "A", "2024-03-31", ""), (5, at(0.80), "A", "2024-04-01", ""), (6, at(0.70), "A", "2024-03-05", "")]
    asked = [question(1), question(2, first="2024-03-01", last="2024-03-31"), question(3, first="2024-04-01"), question(4, last="2023-01-01"), question(5, "B"), question(6, "none")]
    got = {}
    for r in ops.notice_leg(spark.createDataFrame(asked, QUESTION), spark.createDataFrame(points, POINT), 5).collect():
        got.setdefault(r.query_id, []).append((r.id, r.in_window, r.least))
    assert {q: sorted(x) for q, x in got.items()} == {
        1: [(1, None, 0.89), (2, None, 0.89), (3, None, 0.89)],
        2: [(3, True, 0.84), (4, True, 0.84)],
        3: [(5, True, 0.78)],  # the best left sets the margin, the floor holds
        4: [(1, False, 0.89), (2, False, 0.89), (3, False, 0.89)],  # nothing is inside: all stay
        5: [(3, None, 0.84)],
    }


def test_notice_leg_takes_more_for_windows(spark):
    points = [(i, at(0.95 - i / 10_000), "A", "2024-05-01" if i in (20, 39, 40) else "2024-01-01", "") for i in range(60)]
    asked = [question(1), question(2, first="2024-05-01")]
    got = ops.notice_leg(spark.createDataFrame(asked, QUESTION), spark.createDataFrame(points, POINT), 5).collect()
    assert sorted(r.id for r in got if r.query_id == 1) == list(range(15))
    assert sorted(r.id for r in got if r.query_id == 2) == [20, 39]


def test_hybrid_modes_and_filter(spark):
    points = [(1, at(0.2), "A", None, "water water road"), (2, at(0.9), "A", None, "none"), (3, at(0.95), "B", None, "Water"), (4, at(0.5), "A", None, None), (5, at(0.4), None, None, "water works by the river")]
    asked = [question(1, "A", terms=["WATER", "water"]), question(2, "A", terms=[]), question(3), question(4, terms=["absent"])]
    got = {}
    rows = ops.hybrid(spark.createDataFrame(asked, QUESTION), spark.createDataFrame(points, POINT), 2).orderBy("query_id", "place").collect()
    for r in rows:
        got.setdefault(r.query_id, []).append((r.id, r.mode, r.fused))
    both = round(1 / 63 + 1 / 61, 9)
    assert got == {
        1: [(2, "hybrid-rrf", round(1 / 61, 9)), (1, "hybrid-rrf", both)],  # the keyword hit is third of its vector leg
        2: [(2, "dense", None), (4, "dense", None)],
        3: [(3, "dense", None), (2, "dense", None)],
        4: [(3, "hybrid-rrf", round(1 / 61, 9)), (2, "hybrid-rrf", round(1 / 62, 9))],
    }


def test_bm25_of_many_questions_is_that_of_one(spark):
    docs = spark.createDataFrame([(1, "A", "the water the road"), (2, "B", "Water"), (3, None, "road " * 9), (4, "A", ""), (5, "A", None)], "id long, category string, text string")
    asked = spark.createDataFrame([(1, None, ["the", "water"]), (2, "A", ["road"]), (3, None, [])], "query_id long, category string, terms array<string>")
    got = {(r.query_id, r.id): r.score for r in ops.bm25_scores(asked, docs).collect()}
    want = {(1, r.id): r.score for r in ops.bm25(docs.na.fill(""), ["the", "water"]).collect()} | {(2, r.id): r.score for r in ops.bm25(docs.na.fill(""), ["road"]).collect() if r.id == 1}
    assert got == want


def test_merged_page_ranges(spark):
    rows = [(1, 0, "s", None, "a"), (1, 1, "s", 3, "b"), (1, 2, "s", None, "c"), (1, 3, "s", 5, "d"), (1, 5, "s", None, "e"), (1, 6, "t", 7, "f")]
    chunks = spark.createDataFrame([(*r, 0.5) for r in rows], "doc int, index int, section string, page int, content string, score double")
    got = {(r.section, r["first"]): (r["last"], r.first_page, r.last_page, r.content) for r in ops.merged(chunks).collect()}
    assert got == {("s", 0): (3, 3, 5, "a\nb\nc\nd"), ("s", 5): (5, None, None, "e"), ("t", 6): (6, 7, 7, "f")}
    assert "first_page" not in ops.merged(chunks.drop("page")).columns
