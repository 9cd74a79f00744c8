"""Presence of hashed character n-grams in whole texts."""

from __future__ import annotations

import numpy as np

BITS = 16
#: Odd multipliers of the rolling hash, one for each place in an n-gram.
PLACES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def presence(text: str, orders: tuple[int, ...], out: np.ndarray, block: int = 1 << 18) -> None:
    """Set ``out`` (2**BITS booleans) where an n-gram of one of the orders hashes to.

    Long texts go through in overlapping blocks, so memory is bounded and no n-gram is missed.
    """
    longest = max(orders)
    for start in range(0, max(1, len(text)), block):
        part = text[start : start + block + longest - 1]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mixed = (points + np.uint32(1)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        rolling = np.zeros(len(points), dtype=np.uint32)
        for n in range(1, longest + 1):
            if len(points) < n:
                break
            size = len(points) - n + 1
            rolling = rolling[:size] + mixed[n - 1 : n - 1 + size] * PLACES[n - 1]
            if n in orders:
                out[(rolling ^ (rolling >> np.uint32(13))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)] = True


def rows(texts: list[str], orders: tuple[int, ...]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), dtype=bool)
    for i, text in enumerate(texts):
        presence(text, orders, out[i])
    return out
