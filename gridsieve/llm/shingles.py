"""Hashes of words and of word windows, computed for whole texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (9-13 and 32), as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    held = np.empty(len(words), dtype=object)
    held[:] = words
    return pd.util.hash_array(held, categorize=False).astype(np.uint64)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every window of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mix(out * _GOLDEN + hashes[k : n + k])
    return out


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Hashes of the windows of a text; a shorter text with words is one window."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    return window_hashes(word_hashes(words), min(size, len(words)))
