"""The chunker against a plain second version, contents included: Markdown of all block kinds and whole documents."""

import random

from oracle import DATA
from plain_chunks import plain_chunks
from pyspark.sql import functions as F

from bulletin.operators import chunking, reports

WORDS = ["road", "the", "of.", "water!", "पानी।", "office", "x", "notice?", "a-very-long-unbroken-word-that-goes-on"]
KEYS = ("index", "content", "char_start", "char_end", "page", "section", "block_types")


def markdown(rng):
    prose = lambda n: " ".join(rng.choices(WORDS, k=rng.randrange(1, n)))
    line = {
        "header": lambda: "#" * rng.randrange(1, 8) + rng.choice([" ", "  ", ""]) + prose(4),
        "table": lambda: rng.choice(["| a | b |", "|x|", "||", "|---|  ", "| open"]),
        "fence": lambda: rng.choice(["```", "```sql"]),
        "item": lambda: rng.choice(["- ", "* ", "• ", "1. ", "12) ", "  - ", "-", "3."]) + prose(6),
        "hang": lambda: "  " + prose(5),
        "page": lambda: rng.choice(["---PAGE 1---", "---PAGE 27---", "---PAGE x---", " ---PAGE 3---"]),
        "blank": lambda: rng.choice(["", " ", "\t"]),
        "prose": lambda: prose(40),
    }
    kinds = rng.choices(list(line), weights=[2, 3, 1, 4, 2, 1, 4, 5], k=rng.randrange(0, 30))
    return "\n".join(line[k]() for k in kinds)


def test_markdown_chunks_are_those_of_the_plain_version():
    rng = random.Random(11)
    seen = set()
    for _ in range(1_500):
        text, size, overlap = markdown(rng), rng.choice([30, 80, 200, 800]), rng.choice([0, 10, 25])
        got = [tuple(c[k] for k in KEYS) for c in chunking.chunks(text, size, overlap)]
        assert got == plain_chunks(text, size, overlap), (text, size, overlap)
        seen |= {k for c in got for k in c[6]}
    assert seen == {"header", "table", "code", "list", "paragraph"}


def test_hand_made_document():
    text = "---PAGE 1---\n# Law\nFirst words here.\n\n## Part\n- one\n- two\n  more\n\n| a | b |\n|---|---|\n---PAGE 2---\n```\n# no header\n```\n# End\nLast."
    got = [(c["content"], c["page"], c["section"], c["block_types"]) for c in chunking.chunks(text, 800, 20)]
    assert got == [
        ("# Law\nFirst words here.", 1, "Law", ["header", "paragraph"]),
        ("## Part\n- one\n- two\n  more\n| a | b |\n|---|---|", 1, "Law > Part", ["header", "list", "table"]),
        ("```\n# no header\n```", 2, "Law > Part", ["code"]),
        ("# End\nLast.", 2, "End", ["header", "paragraph"]),
    ]


def test_whole_documents_and_their_sizes(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    rng = random.Random(5)
    made = [(100_000 + i, markdown(rng)) for i in range(60)] + [(200_000, None), (200_001, ""), (200_002, " \n "), (200_003, "word " * 60_000)]
    rows = docs.union(spark.createDataFrame(made, docs.schema))
    want = {i: [c[:4] for c in plain_chunks(t or "", 800, 120)] for i, t in rows.collect()}
    chunks = chunking.chunk_documents(rows)
    got = {}
    for r in chunks.orderBy("doc_id", "index").collect():
        got.setdefault(r.doc_id, []).append((r["index"], r.content, r.char_start, r.char_end))
    assert got == {i: c for i, c in want.items() if c}
    sizes = [(len(c), sum(len(x[1]) for x in c)) for c in want.values() if c]
    stats = reports.chunk_stats(chunks).first()
    means = [chars / n for n, chars in sizes]
    assert (stats.documents, stats.chunks) == (len(sizes), sum(n for n, _ in sizes))
    assert (stats.least_average, stats.largest_average) == (round(min(means), 6), round(max(means), 6))
    assert stats.average == round(sum(c for _, c in sizes) / sum(n for n, _ in sizes), 6)
    assert tuple(reports.chunk_stats(chunks.limit(0)).first()) == (0, 0, None, None, None)


def test_extra_columns_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "One. Two.", "kept out", 3), (1, "One. Two.", None, None), (None, "x", None, 0)], "doc_id long, text string, content string, index int")
    got = sorted(((r.doc_id, r["index"], r.content) for r in chunking.chunk_documents(rows).collect()), key=str)
    assert got == [(1, 0, "One. Two."), (1, 0, "One. Two."), (None, 0, "x")]
    assert chunking.chunk_documents(rows.limit(0)).agg(F.count("*")).first()[0] == 0
