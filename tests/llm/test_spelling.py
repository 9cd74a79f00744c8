"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

from oracle import DATA, connect, differences

from bulletin.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n)


def got(docs, **options):
    rows = spelling.variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def corpus(rng, letters, n=300):
    """Words of few letters, so that many are near, with counts that differ widely."""
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(n)]
    for w in words[:80]:
        i = rng.randrange(len(w))
        words.append(w[:i] + rng.choice(letters) + w[i:])
    flat = ["chainaa"] * 5 + ["chainab"] * 30 + ["chainbb"] * 170 + [w if rng.random() < 0.5 else w.upper() for w in words for _ in range(rng.choice([1, 5, 6, 30, 200]))]
    rng.shuffle(flat)
    return [(i, rng.choice([" ", "-", "中", "1"]).join(flat[k : k + 50])) for i, k in enumerate(range(0, len(flat), 50))]


def test_random_words(documents):
    rows = corpus(random.Random(4), "abé")
    want = brute(rows)
    assert len(want) > 100 and any(r[2] not in (r[0], r[1]) for r in want) and any(r[4] > 3 for r in want)
    assert got(documents(rows)) == want


def test_blocks_of_common_halves_change_nothing(documents):
    rows = corpus(random.Random(8), "ab")
    rows += [(1000, "abcdefgh" * 3 + " " + "abcdefgh" * 2 + "abcdefg")] * 6
    want = brute(rows)
    assert got(documents(rows)) == want
    assert got(documents(rows), most_in_half=7, group_letters=50) == want


def test_odd_rows(documents, hard_texts):
    long = "y" * 4000
    rows = [*hard_texts, (20, ("Straße straßes ÷×÷×÷× éèàùâê " * 7)), (21, f"{long} " * 6 + f"{long}y " * 40), (None, "nobody " * 9 + "nobodY's nobodx " * 5), (22, "ªºµ short")]
    assert got(documents(rows)) == brute(rows)


def test_empty(documents):
    assert got(documents([])) == got(documents([(1, None), (2, ""), (3, "too few words here")])) == []


def test_automaton_is_minimal_and_numbers_words():
    words = sorted(a + b for a in (b"walk", b"talk", b"stalk") for b in (b"", b"ed", b"ing", b"s"))
    automaton = spelling.WordAutomaton(words)
    assert [automaton.number(w) for w in words] == [*range(12)] and automaton.number(b"wal") is None
    # The start, s, st = w = t, sta = wa = ta, ..al, ..alk, ..e, ..i, ..in and the one end.
    assert len(automaton.edges) == 10
    assert {words[i] for i in automaton.one_error(b"walk", 2)} == {b"walks"}
    assert {words[i] for i in automaton.one_error(b"talk", 0)} == {b"walk", b"stalk", b"talks"}


def test_query_equals_sql(spark):
    assert differences(spelling.op12(spark, f"{DATA}/sf0.001"), connect(f"{DATA}/sf0.001"), spelling.ORACLE) == []
