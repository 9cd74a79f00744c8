"""Documents to overlapping chunks: blocks with section paths, packed greedily."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches

SCHEMA = (
    "doc_id long, index int, content string, char_start int, char_end int, page int, section string, "
    "block_types array<string>, has_table boolean, has_code boolean, has_list boolean"
)
PAGE = re.compile(r"^---PAGE (\d+)---$", re.M)
FENCE, HEADER, ROW, ITEM = re.compile(r"^```"), re.compile(r"^(#{1,6})\s+(.*)"), re.compile(r"^\|.+\|\s*$"), re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
SENTENCE = re.compile(r"(?<=[.!?।])\s+")


@dataclass
class Block:
    kind: str
    text: str
    start: int
    section: str
    page: int | None


def line_kind(line: str) -> str:
    if not line.strip():
        return "blank"
    if HEADER.match(line):
        return "header"
    if ROW.match(line):
        return "table"
    return "list" if ITEM.match(line) else "paragraph"


def blocks(text: str, compat: bool = False) -> list[Block]:
    """Headers, tables, fenced code, lists and paragraphs in order, with the headers above them.

    ``compat`` keeps the last header alone as the section.
    """
    out: list[Block] = []
    path: list[tuple[int, str]] = []
    page, at, kind, lines, began = None, 0, "", [], 0

    def close() -> None:
        nonlocal kind, lines
        if lines:
            out.append(Block(kind, "\n".join(lines), began, " > ".join(t for _, t in path), page))
        kind, lines = "", []

    for line in text.split("\n"):
        here, at = at, at + len(line) + 1
        if m := PAGE.match(line):
            close()
            page = int(m[1])
            continue
        if kind == "code":
            lines.append(line)
            if FENCE.match(line):
                close()
            continue
        new = "code" if FENCE.match(line) else line_kind(line)
        if new == "blank":
            close()
        elif new == "header":
            close()
            m = HEADER.match(line)
            path = [] if compat else [p for p in path if p[0] < len(m[1])]
            path.append((len(m[1]), m[2].strip()))
            kind, lines, began = "header", [line], here
            close()
        else:
            follows = new == kind or (kind == "list" and new == "paragraph" and line.startswith((" ", "\t")))
            if not follows:
                close()
                kind, began = new, here
            lines.append(line)
    close()
    return out


def pieces(block: Block, size: int) -> list[Block]:
    """A paragraph over ``size`` characters in sentences, and long ones of these in words; else the block."""
    if block.kind != "paragraph" or len(block.text) <= size:
        return [block]
    out, at = [], 0
    for sentence in SENTENCE.split(block.text):
        at = block.text.index(sentence, at)
        parts = [(at, sentence)]
        if len(sentence) > size:
            parts, start, end = [], None, 0
            for m in re.finditer(r"\S+", sentence):
                if start is not None and m.end() - start > size:
                    parts.append((at + start, sentence[start:end]))
                    start = None
                start = m.start() if start is None else start
                end = m.end()
            parts.append((at + (start or 0), sentence[start or 0 : end]))
        out += [Block(block.kind, t, block.start + o, block.section, block.page) for o, t in parts if t]
        at += len(sentence)
    return out


def chunks(text: str, size: int = 800, overlap: int = 120, compat: bool = False) -> list[dict]:
    """Blocks packed in order to about ``size`` characters, each chunk led by the tail of the one before.

    A chunk closes before the block that would take it over the size, or at a new section or
    page.  The tail starts after its first space.  Blocks other than paragraphs are never cut, so
    a chunk of them may be longer; of paragraphs it holds at most size + overlap + 1 characters
    unless a single word is longer.
    """
    out: list[dict] = []
    held: list[Block] = []
    tail = ""

    def close() -> None:
        nonlocal held, tail
        if not held:
            return
        body = "\n".join(b.text for b in held)
        kinds = {b.kind for b in held}
        out.append(
            {
                "index": len(out), "content": f"{tail}\n{body}".strip() if tail else body.strip(), "char_start": held[0].start,
                "char_end": held[-1].start + len(held[-1].text), "page": held[0].page, "section": held[0].section, "block_types": sorted(kinds),
                "has_table": "table" in kinds, "has_code": "code" in kinds, "has_list": "list" in kinds,
            }
        )
        tail = ""
        if 0 < overlap < len(body):
            end = body[-overlap:]
            tail = end[end.find(" ") + 1 :].strip()
        held = []

    length = 0
    for block in (p for b in blocks(text, compat) for p in pieces(b, size)):
        other = held and (held[-1].page != block.page or (held[-1].section != block.section and held[-1].kind != "header"))
        if other or (held and length + len(block.text) + 1 > size):
            close()
            tail = "" if other else tail
            length = 0
        held.append(block)
        length += len(block.text) + 1
    close()
    return out


def bounded_frames(rows: Iterator[tuple], names: list[str], content: int, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Frames of rows whose contents have about ``most`` characters at most, however many come from one text."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[content]) + 100
        if size >= most:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 800, overlap: int = 120, compat: bool = False) -> DataFrame:
    """The chunks of every document; packing is sequential in a document and independent across them.

    A null or blank text has no chunks; repeated rows give repeated chunks; a null id stays null;
    other columns are ignored.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [None if pd.isna(i) else int(i) for i in frame["doc_id"]]
            rows = ((i, *(c[n] for n in names[1:])) for i, t in zip(ids, frame["text"]) for c in chunks(t or "", size, overlap, compat))
            for part in bounded_frames(rows, names, names.index("content")):
                yield part.astype({"doc_id": "Int64", "page": "Int32"})

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)


def fitted(parts: list[str], size: int) -> Iterator[str]:
    """Parts joined by spaces while they fit in ``size`` (a part counts one more); a longer part stands alone."""
    held = ""
    for part in parts:
        if len(held) + len(part) + 1 <= size:
            held = f"{held} {part}".strip()
            continue
        if held:
            yield held
        held = part
    if held:
        yield held


def simple_segments(text: str, size: int) -> Iterator[str]:
    """Paragraphs; those over ``size`` by sentences, and sentences over it by words."""
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph = paragraph.strip()
        if len(paragraph) <= size:
            if paragraph:
                yield paragraph
            continue
        short: list[str] = []
        for sentence in re.split(r"(?<=[.!?।])\s+", paragraph):
            if len(sentence) <= size:
                short.append(sentence)
                continue
            yield from fitted(short, size)
            short = []
            yield from fitted(sentence.split(), size)
        yield from fitted(short, size)


def simple_pieces(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, content): segments packed with line breaks; each chunk begins with the tail of the one
    before, from behind the first space in its last ``overlap`` characters."""
    held, start = "", 0
    for segment in simple_segments(text, size):
        if held and len(held) + len(segment) + 1 > size:
            yield start, held
            start += len(held) - overlap
            tail = held[-overlap:] if 0 < overlap < len(held) else ""
            held = tail[tail.find(" ") + 1 :]
        held = f"{held}\n{segment}" if held else segment
    if held.strip():
        yield start, held


def simple_chunks(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Plain packed chunks (``doc_id``, ``index``, ``char_start``, ``char_end``, ``content``) of every document.

    Starts count packed characters.  A null or blank text has no chunks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (i, k, start, start + len(content), content)
                for i, t in zip(frame["doc_id"], frame["text"]) if t and t.strip()
                for k, (start, content) in enumerate(simple_pieces(t, size, overlap))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "index", "char_start", "char_end", "content"])

    return bounded_batches(docs).select("doc_id", "text").mapInPandas(run, "doc_id long, index int, char_start int, char_end int, content string")


def deduped_paragraphs(docs: DataFrame, id_col: str, text_col: str, least: int = 24) -> DataFrame:
    """``id_col``, ``paragraphs`` (how many stay) and ``text`` without the repeats of earlier paragraphs.

    Paragraphs are parted by blank lines and compared with white space squeezed; those of fewer
    than ``least`` characters always stay.
    """
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n\n")).alias("pos", "p"))
    rows = rows.withColumn("key", F.trim(F.regexp_replace("p", r"(?U)\s+", " ")))
    first = F.row_number().over(Window.partitionBy(id_col, "key").orderBy("pos"))
    kept = rows.withColumn("turn", first).where((F.length("key") < least) | (F.col("turn") == 1))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"])
    return kept.groupBy(id_col).agg(F.count(F.lit(1)).alias("paragraphs"), F.array_join(parts, "\n\n").alias("text"))
