"""A plain second version of the chunker: whole groups of lines, then the cut points of the packing, then the contents."""

import re
from itertools import pairwise


def kind_of(line):
    bare = line.lstrip()
    if not bare:
        return "blank"
    hashes = len(line) - len(line.lstrip("#"))
    if 1 <= hashes <= 6 and line[hashes : hashes + 1].isspace():
        return "header"
    if line.startswith("|") and line.rstrip().endswith("|") and len(line.rstrip()) >= 3:
        return "table"
    mark = bare.split(None, 1)[0]
    lead = mark in ("-", "*", "•") or (mark[:-1].isdecimal() and mark[-1:] in (".", ")"))
    return "list" if lead and len(bare) > len(mark) else "paragraph"


def page_of(line):
    inner = line[8:-3] if line.startswith("---PAGE ") and line.endswith("---") else ""
    return int(inner) if inner.isdecimal() else None


def groups_of(text):
    """(kind, lines, start, section, page) of each block."""
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out, stack, page, i = [], {}, None, 0
    while i < len(lines):
        if page_of(lines[i]) is not None:
            page, i = page_of(lines[i]), i + 1
            continue
        kind, end = kind_of(lines[i]), i + 1
        if lines[i].startswith("```"):
            kind = "code"
            while end < len(lines) and page_of(lines[end]) is None and not lines[end].startswith("```"):
                end += 1
            if end < len(lines) and page_of(lines[end]) is None:
                end += 1
        elif kind == "header":
            level = len(lines[i]) - len(lines[i].lstrip("#"))
            stack = {k: v for k, v in stack.items() if k < level} | {level: lines[i][level:].strip()}
        elif kind in ("table", "list", "paragraph"):
            while end < len(lines) and page_of(lines[end]) is None and not lines[end].startswith("```"):
                hangs = kind == "list" and kind_of(lines[end]) == "paragraph" and lines[end][0] in " \t"
                if kind_of(lines[end]) != kind and not hangs:
                    break
                end += 1
        if kind != "blank":
            out.append((kind, lines[i:end], starts[i], " > ".join(stack[k] for k in sorted(stack)), page))
        i = end
    return out


def cut(text, size):
    """(offset, part): sentences, and words of longer ones joined while they fit."""
    edges = [0] + [m.end() for m in re.finditer(r"(?<=[.!?।])\s+", text)] + [len(text)]
    for a, b in pairwise(edges):
        sentence = text[a:b].rstrip() if b < len(text) else text[a:b]
        if len(sentence) <= size:
            if sentence:
                yield a, sentence
            continue
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", sentence)]
        while words:
            fit = 1
            while fit < len(words) and words[fit][1] - words[0][0] <= size:
                fit += 1
            yield a + words[0][0], sentence[words[0][0] : words[fit - 1][1]]
            words = words[fit:]


def plain_chunks(text, size, overlap):
    parts = []
    for kind, lines, start, section, page in groups_of(text):
        body = "\n".join(lines)
        split = cut(body, size) if kind == "paragraph" and len(body) > size else [(0, body)]
        parts += [(kind, t, start + o, section, page) for o, t in split]
    cuts, fresh = [0], set()
    for i in range(1, len(parts)):
        before, here = parts[i - 1], parts[i]
        moved = before[4] != here[4] or (before[3] != here[3] and before[0] != "header")
        if moved or sum(len(p[1]) + 1 for p in parts[cuts[-1] : i + 1]) > size:
            cuts.append(i)
            if moved:
                fresh.add(i)
    out, last = [], ""
    for a, b in pairwise([*cuts, len(parts)]) if parts else []:
        body = "\n".join(p[1] for p in parts[a:b])
        lead = ""
        if a and a not in fresh and 0 < overlap < len(last):
            lead = last[-overlap:].partition(" ")[2] if " " in last[-overlap:] else last[-overlap:]
        content = f"{lead.strip()}\n{body}" if lead.strip() else body
        kinds = {p[0] for p in parts[a:b]}
        out.append((len(out), content.strip(), parts[a][2], parts[b - 1][2] + len(parts[b - 1][1]), parts[a][4], parts[a][3], sorted(kinds)))
        last = body
    return out
