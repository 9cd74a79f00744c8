"""WARC archives and GIF media."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from oracle import DATA, connect, differences
from pyspark.sql import functions as F

from bulletin.llm import gif, warc

PAGE_SCHEMA = "page_id long, url string, html string, file string, off long, value string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "f", 1, "v") for i, u, h in rows], PAGE_SCHEMA)


def read_back(spark, rows, path, **options):
    warc.write_warc(pages(spark, rows), path, **options)
    return warc.read_warc(spark, path)


def test_warc_records(spark, tmp_path):
    magic = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u1", "a" * 200), (2, None, "a" * 200), (3, "u\r\n3", "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", magic * 9), (7, "u7", magic), (8, "u8", "é" * 300_000), (9, "u9", "\r\n\r\nWARC/1.0\r\n")]
    got = {r.record_id: r for r in read_back(spark, rows, f"{tmp_path}/w").collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        r = got[f"<urn:page:{i}>"]
        raw = (h or "").encode()
        assert (r.payload_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r.record_type == ("revisit" if i == 2 else "response")
        assert r.payload is None if i == 2 else bytes(r.payload) == raw
    assert got["<urn:page:2>"].refers_to == "<urn:page:1>"


def test_warc_many_records_in_plain_splits(spark, tmp_path):
    """Uncompressed archives read in many splits, with copies of the version line inside payloads."""
    rng = random.Random(2)
    rows = [(i, f"u{i}", "".join(rng.choice(["WARC/1.0\r\n", "Content-Length: 7\r\n", "\r\n\r\n", "text ", "ü"]) for _ in range(rng.randrange(0, 80)))) for i in range(400)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.record_id: bytes(r.payload or b"") for r in read_back(spark, rows, f"{tmp_path}/w", compression="none", least=10**9).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"<urn:page:{i}>": h.encode() for i, _, h in rows}


def test_warc_odd_ids(spark, tmp_path):
    rows = [(None, "u", "x" * 150), (5, "u", "x" * 150), (5, "u", "x" * 150), (None, "v", "y" * 150)]
    got = sorted((str(r.record_id), r.record_type, str(r.refers_to)) for r in read_back(spark, rows, f"{tmp_path}/w").collect())
    assert got == [("<urn:page:5>", "response", "None"), ("<urn:page:5>", "response", "None"), ("None", "response", "None"), ("None", "revisit", "<urn:page:5>")]
    assert read_back(spark, [], f"{tmp_path}/none").count() == 0


def test_warc_query_equals_sql(spark):
    assert differences(warc.op2(spark, f"{DATA}/sf0.001"), connect(f"{DATA}/sf0.001"), warc.ORACLE) == []


def test_lzw_round_trip():
    rng = random.Random(4)
    for size in (0, 1, 2, 300, 9000, 200_000):
        for letters in (1, 3, 256):
            data = bytes(rng.randrange(letters) for _ in range(size))
            assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_gif_store_and_read(documents, hard_texts):
    docs = documents(hard_texts)
    got = gif.frames(gif.store(docs)).collect()
    assert len(got) == len(hard_texts)
    want = sorted((str(i), (t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 192)) * 192)) for i, t in hard_texts)
    assert sorted((str(r.doc_id), b"".join(bytes(f.samples) for f in r.frames)) for r in got) == want
    for r in got:
        assert all(sum(f.histogram) == f.canvas_width * f.canvas_height and f.delay_cs == 10 for f in r.frames)
    assert gif.frames(gif.store(documents([]))).count() == 0


def picture(frames, palette, canvas=(4, 4)):
    """A GIF of frames (left, top, width, height, indices, disposal, transparent, delay, interlaced)."""
    bits = (len(palette) - 1).bit_length()
    out = b"GIF89a" + struct.pack("<HHBBB", *canvas, 0x80 | bits - 1, 0, 0) + bytes(v for c in palette for v in c)
    for left, top, w, h, indices, disposal, clear, delay, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced)
        size = max(2, bits)
        out += bytes([size]) + gif.blocks(gif.lzw_encode(bytes(indices), size))
    return out + b"\x3b"


def test_gif_disposal_and_transparency():
    palette = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    media = picture(
        [(0, 0, 4, 4, [1] * 16, 1, None, 5, 0), (1, 1, 2, 2, [2, 3, 3, 2], 3, 3, 7, 0), (0, 0, 2, 2, [3] * 4, 2, None, 0, 0), (3, 3, 1, 1, [2], 0, None, 1, 0)], palette
    )
    a, b, c, d = list(gif.gif_decode(media))
    assert (a["canvas"][:, :, 0] == 255).all() and [f["start_cs"] for f in (a, b, c, d)] == [0, 5, 12, 12]
    assert tuple(b["canvas"][1, 1, :3]) == (0, 255, 0) and tuple(b["canvas"][1, 2, :3]) == (255, 0, 0)  # 3 is transparent
    assert tuple(c["canvas"][1, 1, :3]) == (0, 0, 255) and tuple(c["canvas"][2, 2, :3]) == (255, 0, 0)  # b was taken back
    assert tuple(d["canvas"][0, 0]) == (0, 0, 0, 0) and tuple(d["canvas"][3, 3, :3]) == (0, 255, 0)  # c was cleared


def test_gif_interlaced():
    order = [r for first, step in gif.INTERLACE for r in range(first, 8, step)]
    media = picture([(0, 0, 1, 8, [r % 4 for r in order], 0, None, 0, 1)], [(i, i, i) for i in range(4)], (1, 8))
    assert list(gif.gif_decode(media))[0]["canvas"][:, 0, 0].tolist() == [r % 4 for r in range(8)]


@pytest.mark.parametrize("media", [b"", b"not a gif", b"GIF89a", b"GIF89a" + b"\x04\x00\x04\x00\x00\x00\x00\x2c\x00"])
def test_damaged_media_have_no_frames(media):
    assert list(gif.gif_decode(media)) == []


def test_cut_media_end_where_they_break():
    whole = gif.gif_encode(bytes(range(192)) * 600)
    assert 0 < len(list(gif.gif_decode(whole[: len(whole) // 2]))) <= len(list(gif.gif_decode(whole))) == 3


def test_op4_digests(spark):
    texts = dict(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect())
    features = {}
    for r in gif.op4(spark, f"{DATA}/sf0.001").collect():
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        media = gif.gif_encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert features.setdefault(payload, r.feature) == r.feature
    assert len(set(features.values())) > len(features) * 0.9


def test_null_media(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"x"))], "id int, media binary")
    assert [r.frames for r in gif.frames(rows).orderBy("id").collect()] == [[], []]
    assert np.array(gif.histogram(np.zeros((2, 2, 3), np.uint8))).sum() == 4 and F is not None
