"""Token ids of whole texts through a bounded memory of distinct words.

Texts of plain characters are cut into words on their bytes, many texts at once; Arrow's
dictionary encoding leaves the distinct words of a batch, and of these only the new ones are
encoded.  Elsewhere a space that is followed by a non-space always begins a new word in the
vocabularies used here (the pattern's classes take at most one leading space, white-space runs
stop before the last one), so other texts are cut there and their pieces encoded one by one.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CUT = re.compile(r" (?=\S)")
#: Printable ASCII, tab, line breaks and the Latin letters of the first 256 code points: the
#: characters that ``word_starts`` knows.
PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
LETTER, DIGIT, SPACE, OTHER, SEPARATOR = 0, 1, 2, 3, 4
#: Classes of the bytes of plain characters; the Latin letters are C3 and a byte from 80 on, and 0 stands between texts.
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASSES[48:58] = DIGIT
CLASSES[[9, 10, 13, 32]] = SPACE
CLASSES[0] = SEPARATOR


def word_starts(data: np.ndarray, with_space: bool) -> np.ndarray:
    """Where words begin in plain bytes, as the vocabularies' patterns cut them.

    Contractions ('s 't 're 've 'm 'll 'd), then runs of letters, of digits and of other signs.
    ``with_space``: a run takes the space before it, and white space before that is one word (to
    the end of the text, all of it).  Otherwise white space and digits are words of one byte.
    The data begin and end with a separator.
    """
    kind = CLASSES[data]
    start = np.empty(len(data), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    apostrophe = np.flatnonzero((data == 39) & start)
    if with_space:
        ends = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SEPARATOR) & (kind[1:] != SPACE))
        start[ends] = True
        start[ends[data[ends] == 32] + 1] = False
        apostrophe = apostrophe[data[apostrophe - 1] != 32]
    else:
        start |= (kind == SPACE) | (kind == DIGIT)
    start |= kind == SEPARATOR
    one, two = data[apostrophe + 1], data[np.minimum(apostrophe + 2, len(data) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))
    start[apostrophe[short | long] + 1] = False
    start[apostrophe[short] + 2] = True
    start[apostrophe[long] + 3] = True
    return np.flatnonzero(start)


def parts(text: str, most: int = 1_000_000) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut where a word begins."""
    start = 0
    while len(text) - start > most and (cut := CUT.search(text, start + most)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Generation(dict):
    """Found values; a key that only the generation before holds moves here when it is looked up."""

    def __init__(self, before: dict):
        super().__init__()
        self.before = before

    def __missing__(self, key):
        found = self.before.get(key)
        if found is not None:
            self[key] = found
        return found


class Memory:
    """What ``find`` gives for keys (lists of bytes), kept in two generations of about ``generation`` keys.

    Keys of more than ``longest`` bytes are not kept.
    """

    def __init__(self, find: Callable[[list[bytes]], list[bytes]], generation: int = 100_000, longest: int = 64):
        self.find, self.generation, self.longest = find, generation, longest
        self.now = Generation({})

    def __call__(self, keys: list[bytes]) -> list[bytes]:
        """The values of distinct keys."""
        out = list(map(self.now.__getitem__, keys))
        new = [k for k, x in zip(keys, out) if x is None] if None in out else []
        if new:
            fresh = dict(zip(new, self.find(new)))
            out = [fresh[k] if x is None else x for k, x in zip(keys, out)]
            self.now.update((k, x) for k, x in fresh.items() if len(k) <= self.longest)
        if len(self.now) > self.generation:
            self.now.before = {}
            self.now = Generation(self.now)
        return out

    def spell(self, data: bytes, starts: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The values of the keys that begin at ``starts`` in ``data``, one after the other, and where each begins and the last ends."""
        offsets = np.append(starts, len(data)).astype(np.int32)
        keys = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        values = pa.array(self(keys.dictionary.to_pylist()), pa.binary()).take(keys.indices)
        _, ends, spelled = values.buffers()
        return memoryview(spelled or b""), np.frombuffer(ends, np.int32, len(values) + 1, 4 * values.offset)


class Words:
    """Ids (unsigned 32-bit, little-endian) of texts; ``find`` encodes new words, ``piece`` what is not plain.

    ``marks`` are strings (lower case) whose pieces never count as plain; ``lower`` tells that the
    vocabulary lower-cases and drops white space.  Pieces that are not plain have a memory too.
    """

    def __init__(self, find: Callable[[list[bytes]], list[bytes]], pieces: Callable[[list[bytes]], list[bytes]], marks: list[str] = [], lower: bool = False):
        if any(c.isspace() for s in marks for c in s):
            raise ValueError("an added token holds white space")
        self.words, self.odd, self.lower = Memory(find), Memory(pieces, 50_000), lower
        self.mark = re.compile("|".join(map(re.escape, marks)), re.IGNORECASE) if marks else None

    def plain(self, text: str) -> bool:
        return bool(PLAIN.fullmatch(text)) and not (self.mark and self.mark.search(text))

    def __call__(self, texts: list[str], most: int = 1_500_000) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        units: list[tuple[int, bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            for part in parts(text):
                if self.plain(part):
                    units.append((i, (part.lower() if self.lower else part).encode()))
                    out[i].append(b"")
                    held += len(part)
                    if held > most:
                        self.together(units, out)
                        units, held = [], 0
                else:
                    self.together(units, out)
                    units, held = [], 0
                    out[i].append(self.mixed(part))
        self.together(units, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def together(self, units: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        if not units:
            return
        data = b"\0" + b"\0".join([u for _, u in units]) + b"\0"
        raw = np.frombuffer(data, np.uint8)
        starts = word_starts(raw, not self.lower)
        spelled, ends = self.words.spell(data, starts)
        at = np.cumsum([1, *[len(u) + 1 for _, u in units]])  # one past each separator
        edges = ends[np.searchsorted(starts, at)].tolist()
        for (i, _), a, b in zip(units, edges, edges[1:]):
            out[i][-1] = bytes(spelled[a:b]) if len(out[i]) == 1 else out[i][-1] + bytes(spelled[a:b])

    def mixed(self, text: str) -> bytes:
        pieces = CUT.split(text)
        units = [pieces[0].encode(), *[b" " + p.encode() for p in pieces[1:]]]
        spelled, _ = self.odd.spell(b"".join(units), np.cumsum([0, *[len(u) for u in units[:-1]]]))
        return bytes(spelled)


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class TokenizerWords(Words):
    """Ids by a ``tokenizers`` file, as the library gives them without adding special tokens.

    Plain words go to the file's BPE model, pieces with other characters and those that hold an
    added token's string through the whole tokenizer.  Such a string gives the added token's id,
    as in the library, or with ``specials_as_text`` the ids of ordinary text.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = specials_as_text
        marks = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        alphabet = byte_alphabet()
        self.table = {b: alphabet[b] for b in range(256)}
        super().__init__(self.new_words, self.new_pieces, marks, self.whole.normalizer is not None)

    def new_words(self, words: list[bytes]) -> list[bytes]:
        tokenize, table = self.whole.model.tokenize, self.table
        skip = b"\0 \t\n\r" if self.lower else b"\0"
        return [
            b"" if len(w) == 1 and w in skip else array("I", [t.id for t in tokenize(w.decode("latin-1").translate(table))]).tobytes()
            for w in words
        ]

    def new_pieces(self, pieces: list[bytes]) -> list[bytes]:
        return [array("I", self.whole.encode(p.decode(), add_special_tokens=False).ids).tobytes() for p in pieces]


_LOADED: dict[tuple, TokenizerWords] = {}


def tokenizer_words(path: str, specials_as_text: bool = False) -> TokenizerWords:
    """The encoder for a ``tokenizers`` file, loaded once in each Python worker."""
    key = path, specials_as_text
    if key not in _LOADED:
        _LOADED[key] = TokenizerWords(*key)
    return _LOADED[key]
