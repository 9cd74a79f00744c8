"""GIF media columns: byte payloads stored as animated GIFs, and a decoder for any GIF.

The decoder reads LZW code streams, applies global and local palettes, interlacing, transparency
and disposal, and gives the timed frames with colour-histogram columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import bounded_batches, slices, table, text_bytes

UNIT = 192
FRAME_ROWS = 256
#: Fixed values of the format: first row and step of each interlace pass.
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))


def code_widths(min_size: int) -> np.ndarray:
    """Bits of the k-th code after a clear code: the table has gained k - 1 entries by then."""
    k = np.arange(4098 - (1 << min_size))
    table_end = (1 << min_size) + 1 + np.maximum(k, 1)
    return np.clip(np.floor(np.log2(table_end)).astype(np.int64) + 1, min_size + 1, 12)


WIDTHS = {m: code_widths(m) for m in range(2, 9)}


MASKS = {m: np.arange(16) < w[:, None] for m, w in WIDTHS.items()}
STARTS = {m: np.concatenate([[0], np.cumsum(w)]) for m, w in WIDTHS.items()}


def to_bits(codes: list[int], mask: np.ndarray) -> np.ndarray:
    """The codes' low bits, as many of each as its row of the mask says, least first."""
    raw = np.array(codes, dtype="<u2").view(np.uint8).reshape(-1, 2)
    return np.unpackbits(raw, axis=1, bitorder="little")[mask[: len(codes)]]


def from_bits(bits: np.ndarray, mask: np.ndarray) -> np.ndarray:
    spread = np.zeros(mask.shape, np.uint8)
    spread[mask] = bits
    return np.packbits(spread, axis=1, bitorder="little").view("<u2")[:, 0].astype(np.int64)


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """LZW with growing codes; the table is cleared when it is full."""
    clear, mask = 1 << min_size, MASKS[min_size]
    first, last = clear + 2, len(mask) - 2  # a run: at most ``last`` codes, then a clear or end code
    bits = [to_bits([clear], mask)]
    run: list[int] = []
    known: dict[int, int] = {}
    keep = run.append
    code = first
    samples = iter(data)
    prefix = next(samples, -1)
    for byte in samples:
        key = prefix << 8 | byte
        if key in known:
            prefix = known[key]
            continue
        keep(prefix)
        known[key] = code
        code += 1
        prefix = byte
        if code == first + last:
            keep(clear)
            bits.append(to_bits(run, mask))
            run.clear()
            known.clear()
            code = first
    if prefix >= 0:
        keep(prefix)
    keep(clear + 1)
    bits.append(to_bits(run, mask))
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def spelled(codes: np.ndarray, min_size: int, most: int) -> bytes:
    """What the codes of one run (without clear and end codes) spell, up to the first impossible one
    and the code that reaches ``most`` bytes.

    The k-th entry of the table is what the k-th code spells and the byte after it, so a code
    copies bytes that stand before it in the output.  Lengths and bytes are found for all codes
    together by pointer jumping.
    """
    clear = 1 << min_size
    places = np.arange(len(codes))
    literal = codes < clear
    parent = codes - (clear + 2)
    wrong = np.flatnonzero(~literal & ((parent < 0) | (parent >= places)))
    if len(wrong):
        codes, literal, parent, places = (x[: wrong[0]] for x in (codes, literal, parent, places))
    n = len(codes)
    lengths, jump = np.append(np.ones(n, np.int64), 0), np.append(np.where(literal, n, parent), n)
    while (jump != n).any():
        lengths += lengths[jump]
        jump = jump[jump]
    n = min(n, int(np.searchsorted(np.cumsum(lengths[:n]), most)) + 1)
    codes, literal, parent, places, lengths = (x[:n] for x in (codes, literal, parent, places, lengths))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(places, lengths)
    at = np.arange(len(owner))
    source = np.where(literal[owner], at, starts[np.where(literal, 0, parent)][owner] + at - starts[owner])
    while (source != (further := source[source])).any():
        source = further
    return codes[owner[source]].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, min_size: int, most: int) -> bytes:
    """At most ``most`` indices from a code stream; a damaged stream ends where it breaks.

    The width of a code depends only on how many came since the last clear code, so a run's
    codes are unpacked at once.  After a full table without a clear code, 12-bit codes go on.
    """
    clear, end = 1 << min_size, (1 << min_size) + 1
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    mask, starts = MASKS[min_size], STARTS[min_size]
    out: list[bytes] = []
    at, got = 0, 0
    while got < most:
        run: list[np.ndarray] = []
        stop = end
        n = int(np.searchsorted(starts, len(bits) - at, "right")) - 1
        ends, cells = starts, mask[: max(n, 0)]
        while n > 0:
            codes = from_bits(bits[at : at + int(ends[n])], cells)
            marks = np.flatnonzero((codes == clear) | (codes == end))
            used = int(marks[0]) if len(marks) else n
            run.append(codes[:used])
            at += int(ends[min(used + 1, n)])
            if len(marks):
                stop = int(codes[used])
                break
            n = min((len(bits) - at) // 12, 4096) if n == len(mask) or len(run) > 1 else 0
            ends, cells = 12 * np.arange(n + 1), np.arange(16)[None, :].repeat(n, 0) < 12
        if run:
            out.append(spelled(np.concatenate(run), min_size, most - got))
            got += len(out[-1])
        if stop == end:
            break
    return b"".join(out)[:most]


def blocks(data: bytes) -> bytes:
    """Sub-blocks of up to 255 bytes and the terminator."""
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


#: Red is the index, so the red channel gives the samples back; green and blue (odd multiples,
#: modulo 256) spread neighbouring values over the colour space.
PALETTE = bytes(v % 256 for i in range(256) for v in (i, 37 * i + 11, 101 * i + 53))


def gif_encode(samples: bytes, width: int = UNIT, frame_rows: int = FRAME_ROWS, delay_cs: int = 10) -> bytes:
    """Samples, a positive multiple of ``width``, as a GIF of frames of ``frame_rows`` rows."""
    rows = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), PALETTE]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for top in range(0, rows, frame_rows):
        n = min(frame_rows, rows - top)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, n, 0))
        out.append(b"\x08" + blocks(lzw_encode(samples[top * width : (top + n) * width])))
    out.append(b"\x3b")
    return b"".join(out)


def gif_decode(media: bytes, most_pixels: int = 1 << 24) -> Iterator[dict]:
    """The frames of a GIF in order, each the canvas after drawing.

    A frame has left, top, width, height of its own image, delay_cs, disposal, start_cs, the
    canvas size, ``canvas`` (rows x columns x RGBA) and ``samples``, the red channel of its
    image's area.  What is not a GIF has no frames; a damaged one ends where it breaks, as does
    one whose canvas or next image claims more than ``most_pixels``.
    """
    try:
        if media[:3] != b"GIF":
            return
        canvas_w, canvas_h, flags = struct.unpack_from("<HHB", media, 6)
        at, palette = 13, None
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            palette = np.frombuffer(media, np.uint8, n, at).reshape(-1, 3)
            at += n
        if canvas_w * canvas_h > most_pixels:
            return
        canvas = np.zeros((canvas_h, canvas_w, 4), np.uint8)
        control, clock = (0, 0, None), 0

        def body(at: int) -> tuple[bytes, int]:
            parts = []
            while media[at]:
                parts.append(media[at + 1 : at + 1 + media[at]])
                at += 1 + media[at]
            return b"".join(parts), at + 1

        while media[at] != 0x3B:
            if media[at] == 0x21:
                label = media[at + 1]
                data, at = body(at + 2)
                if label == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", data)
                    control = (packed >> 2 & 7, delay, index if packed & 1 else None)
                continue
            if media[at] != 0x2C:
                break
            left, top, w, h, packed = struct.unpack_from("<HHHHB", media, at + 1)
            at += 10
            colours = palette
            if packed & 0x80:
                n = 3 << (packed & 7) + 1
                colours = np.frombuffer(media, np.uint8, n, at).reshape(-1, 3)
                at += n
            min_size = media[at]
            if w * h > most_pixels:
                break
            data, at = body(at + 1)
            indices = np.frombuffer(lzw_decode(data, min_size, w * h), np.uint8)
            drawn = len(indices) == w * h
            image = np.zeros((h, w), np.uint8)
            image.reshape(-1)[: len(indices)] = indices
            if packed & 0x40:
                order = [r for first, step in INTERLACE for r in range(first, h, step)]
                image = image[np.argsort(order)]
            if colours is None:
                colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
            full = np.zeros((256, 4), np.uint8)
            full[: len(colours), :3], full[:, 3] = colours, 255
            disposal, delay, clear_index = control
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            shown = image[: area.shape[0], : area.shape[1]]
            if clear_index is None:
                area[:] = full[shown]
            else:
                opaque = shown != clear_index
                area[opaque] = full[shown[opaque]]
            yield (
                {"left": left, "top": top, "width": w, "height": h, "delay_cs": delay, "start_cs": clock, "disposal": disposal,
                 "canvas_width": canvas_w, "canvas_height": canvas_h, "canvas": canvas.copy(), "samples": area[:, :, 0].tobytes()}
            )
            clock += delay
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
            control = (0, 0, None)
            if not drawn:
                break
    except (IndexError, struct.error, ValueError, KeyError):
        return


def histogram(rgb: np.ndarray) -> list[int]:
    """64 bins: two bits of each of red, green and blue."""
    q = (rgb >> 6).astype(np.int64)
    return np.bincount((q[..., 0] << 4 | q[..., 1] << 2 | q[..., 2]).reshape(-1), minlength=64).tolist()


FRAME = (
    "array<struct<left:int,top:int,width:int,height:int,delay_cs:int,start_cs:int,disposal:int,"
    "canvas_width:int,canvas_height:int,histogram:array<int>,canvas:binary,samples:binary>>"
)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each whole text as a GIF.

    The payload is the text's UTF-8 bytes, then spaces up to a positive multiple of ``unit``.  A
    null or empty text is ``unit`` spaces.  Repeated rows repeat; null ids stay null; other
    columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                media = [gif_encode(t.ljust(max(1, -(-len(t) // unit)) * unit), unit) for t in texts]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(media, pa.binary())], schema=schema)

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary"
    )


def frames(rows: DataFrame, media_col: str = "media", canvas: bool = True, most_pixels: int = 1 << 24) -> DataFrame:
    """Add ``frames``, the decoded timed frames of a media column, to the other columns.

    A column of that name is replaced.  Repeated rows repeat; an empty table gives no rows.

    Each frame has its place, times, disposal, a 64-bin colour histogram, ``samples`` (the red
    channel of its area) and, if asked for, ``canvas`` (RGBA).  Null or foreign media have none;
    media that claim over ``most_pixels`` for a canvas or an image end there.
    """
    rows = rows.select(*[rows[c] for c in rows.columns if c.lower() != "frames"])
    schema = StructType([*rows.schema.fields, StructField("frames", DataType.fromDDL(FRAME))])
    names = [n for n in ("left top width height delay_cs start_cs disposal canvas_width canvas_height").split()]

    def row(frame: dict) -> dict:
        pixels = frame["canvas"]
        return {n: int(frame[n]) for n in names} | {
            "histogram": histogram(pixels[:, :, :3]),
            "canvas": pixels.tobytes() if canvas else None,
            "samples": frame["samples"],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([(n, pa.int32()) for n in names] + [("histogram", pa.list_(pa.int32())), ("canvas", pa.binary()), ("samples", pa.binary())])
        )
        for whole in batches:
            for batch in slices(whole, media_col, 2_000_000):
                decoded = [[row(f) for f in gif_decode(m, most_pixels)] if m else [] for m in batch.column(media_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, kind)], names=[*batch.schema.names, "frames"])

    return rows.mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = frames(store(table(spark, sf_dir, "documents")), canvas=False)
    payload = F.aggregate("frames", F.lit(b""), lambda acc, f: F.concat(acc, f["samples"]))
    bins = F.aggregate(
        "frames", F.array_repeat(F.lit(0), 64), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b)
    )
    return decoded.withColumn("payload", payload).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat_ws("x", F.size("frames"), F.col("frames")[0]["canvas_width"], F.col("frames")[0]["canvas_height"]),
            F.array_join(bins, ","),
        ).alias("feature"),
    )
