"""Byte-pair encoding, packing and token files against the libraries."""

import hashlib
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from bulletin.llm import bpe, common, packing, token_files


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {"tik": lambda t: tik.encode_ordinary(t)}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        model = Tokenizer.from_file(public_tokenizers.path(name))
        found[name] = lambda t, m=model: m.encode(t, add_special_tokens=False).ids
    return found


def test_bpe_encode_and_decode(documents, hard_texts, reference):
    got = bpe.decode(bpe.encode(documents(hard_texts))).collect()
    want = sorted((str(i), reference["tik"](t or ""), (t or "").encode()) for i, t in hard_texts)
    assert sorted((str(r.doc_id), r.ids, bytes(r.bytes)) for r in got) == want


def test_bpe_long_words(reference):
    """Words without a space: random letters of small and large alphabets, periods, pieces out of step; a time bound."""
    import random
    import time

    import tiktoken

    pairs = bpe.model(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    draw = random.Random(3)
    words = [bytes(draw.choices(letters, k=n)) for letters in (b"ab", b"acgt", bytes(range(97, 123)), bytes(range(256))) for n in (257, 1_000, 20_000)]
    words += [b"x" * 30_000, b"acg" * 7_000, (b"x" * 777 + b"=" * 333) * 9, b" " * 5_000 + b"hello" * 3_000, bytes(draw.choices(b"acgt", k=200_000))]
    whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=pairs.ranks, special_tokens={})
    start = time.monotonic()
    got = pairs.encode_words(words)
    assert time.monotonic() - start < 60
    for word, ids in zip(words, got):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole._core_bpe.encode_single_piece(word)


def test_bpe_empty_table(documents):
    assert bpe.decode(bpe.encode(documents([]))).count() == 0


def test_op1_on_all_documents(spark, reference):
    texts = dict(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect())
    for r in bpe.op1(spark, f"{DATA}/sf0.001").collect():
        ids = reference["tik"](texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def check_packing(rows, texts, encode, capacity):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = [*encode(text or ""), 0]
        at = 0
        for start, length, crc, total in sorted(pieces.pop(doc)):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
            at += length
        assert at == len(ids)
    assert not pieces
    stored = used = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        used += at
        stored += at if at & (at - 1) == 0 else capacity
    return used / stored


def test_packing_hard_texts(documents, hard_texts, reference):
    texts = {i: t for i, t in hard_texts}
    rows = packing.pack(documents(sorted(texts.items(), key=str)), capacity=64).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_packing(rows, texts, reference["byte_bpe_50k.json"], 64) > 0.95


def test_packing_repeats_and_empty(documents):
    assert packing.pack(documents([])).count() == 0
    got = packing.pack(documents([(1, "a b c"), (1, "a b c")])).groupBy("doc_id", "start").count().collect()
    assert {r["count"] for r in got} == {2}
    with pytest.raises(ValueError):
        packing.pack(documents([]), capacity=1000)


def test_op3_on_all_documents(spark, reference):
    texts = dict(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert check_packing(packing.op3(spark, f"{DATA}/sf0.001").collect(), texts, reference["byte_bpe_50k.json"], 1024) > 0.95


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, documents, hard_texts, reference, tmp_path, encoding):
    path = f"{tmp_path}/{encoding}"
    token_files.write_token_files(documents(hard_texts), path, encoding=encoding, page_rows=2)
    rows = token_files.read_token_files(spark, path)
    want = sorted((str(i), [*reference["word_bpe_49k.json"](t or ""), 1]) for i, t in hard_texts)
    assert sorted((str(r.doc_id), r.ids) for r in rows.collect()) == want
    starts = token_files.with_starts(token_files.checksums(rows)).orderBy("start").collect()
    at = 0
    for r in starts:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in starts]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_token_files_empty_table(spark, documents, tmp_path):
    token_files.write_token_files(documents([]), f"{tmp_path}/none")
    assert token_files.with_starts(token_files.checksums(token_files.read_token_files(spark, f"{tmp_path}/none"))).count() == 0


def test_op10_on_all_documents(spark, reference):
    texts = sorted(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in token_files.op10(spark, f"{DATA}/sf0.001").collect()}
    at = 0
    for doc, text in texts:
        ids = [*reference["word_bpe_49k.json"](text), 1]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_batch_limits_with_units(spark, documents):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("64MB", str(8 << 20)), ("4m", "4m"), ("2kb", "2kb")):
            spark.conf.set(key, given)
            common.bounded_batches(documents([(1, "x")]))
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
    assert [common.size_of(x) for x in ("10000", "67108864b", "3k", "1g")] == [10000, 1 << 26, 3072, 1 << 30]
