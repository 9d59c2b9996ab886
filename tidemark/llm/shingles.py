"""Word shingles of whole texts as 64-bit hash sets, computed over batches of bytes."""

from __future__ import annotations

import numpy as np

#: Base of the polynomial word hash, multipliers and the steps of the final mix (fixed values).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: near values give unrelated ones."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash the words (runs without ASCII white space, A-Z in lower case) of all texts.

    Returns the hashes one text after another and the n + 1 bounds of the texts.
    """
    low = _LOWER[raw]
    inside = ~_SPACES[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    own = np.flatnonzero(opens[inside])  # word starts among the bytes of words
    size = np.diff(np.append(own, int(inside.sum())))
    place = np.arange(int(size.sum())) - np.repeat(own, size)
    powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64), dtype=np.uint64)
    sums = np.add.reduceat((low[inside].astype(np.uint64) + np.uint64(1)) * powers[place], own)
    return mix(sums + size.astype(np.uint64)), np.searchsorted(starts, bounds)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, width: int):
    """Yield the sorted distinct shingle hashes (int64) of each text.

    A text with fewer words than ``width`` has its whole word sequence as the
    only shingle; one without words has none.
    """
    words, firsts = word_hashes(raw, bounds)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    rolled = mix(rolled + np.uint64(width)).view(np.int64)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = whole * _STEP + words[k]
            yield mix(whole + np.uint64(b - a)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
