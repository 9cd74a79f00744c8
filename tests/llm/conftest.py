import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, file string, label string, token long, id long, word string"


@pytest.fixture
def documents(spark):
    """Rows to a documents table with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", None, "f", "l", 1, 2, "w") for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def hard_texts():
    """Nulls, empty and very long texts, ties, repeated rows and odd characters."""
    long_word, long_text = "x" * 30_000, "the quick brown fox jumps over it. " * 3000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Hello, World! it's 42 <|endoftext|>"), (5, long_word), (6, long_text), (7, "çà été Ünïcode 🎓 विद्यालय  \r\n\x0b\x1c\x85"),
            (8, "aaaaaaaaaaaaaaaaaaaaaaab" * 40), (4, "Hello, World! it's 42 <|endoftext|>"), (9, "Hello, World! it's 42 <|endoftext|>"), (None, "no id"), (10, "don't DON'T 'tis  x"),
            (11, "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>c  <|endoftext|>"), (12, ("word " * 300_000) + "<|endoftext|> é中 " + "it's\n" * 9)]
    return rows
