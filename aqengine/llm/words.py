"""Hashes of words and runs of words, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Factor between neighbouring words of a run, and its inverse modulo 2**64.
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
BACK = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at a time, if no single text is longer.
PIECE = 2 << 20


@lru_cache(8)
def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _at_least(n: int) -> int:
    return 1 << max(12, int(n).bit_length())


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most PIECE bytes together, or of one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def word_hashes(texts: list[bytes], split: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts (A-Z lower-cased): hash, number of the text, and with ``split`` (one byte of white space) how many
    of these bytes stand before it in its text."""
    line = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[line]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    first, last = edges[::2], edges[1::2]
    n = _at_least(len(line) + 1)
    upto = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(_LOWER[line].astype(np.uint64) * powers(_BASE, n)[: len(line)], out=upto[1:])
    h = mix((upto[last] - upto[first]) * powers(_INVERSE, n)[first] + (last - first).astype(np.uint64))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(starts, first, side="right") - 1
    if not split:
        return h, text, np.zeros(0, np.int64)
    breaks = np.flatnonzero(line == split[0])
    return h, text, np.searchsorted(breaks, first) - np.searchsorted(breaks, starts[text])


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k words."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * STEP + h[j : j + n]
    return mix(out + np.uint64(k))
