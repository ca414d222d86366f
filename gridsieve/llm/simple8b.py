"""Simple-8b: varying counts of unsigned integers packed into 64-bit words.

The top four bits of a word select how many values of how many bits its lower 60 bits hold.
Selector 0 is an escape: the word after it is one raw 64-bit value.  Selector 1 is a run of
120 zeros.
"""

from __future__ import annotations

import numpy as np

# Fixed values: (values per word, bits per value) of each selector.
SELECTORS = (
    (1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
ESCAPE = 0
COUNTS = np.array([c for c, _ in SELECTORS], dtype=np.int64)
_LIMITS = np.array([1 << b for _, b in SELECTORS[1:]], dtype=np.uint64)


def encode(values: np.ndarray) -> np.ndarray:
    """Little-endian words that hold ``values`` in order.

    The last word may have room left; a reader keeps the number of values.
    """
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if n == 0:
        return np.empty(0, dtype="<u8")
    # Class of the narrowest selector that each value fits; values past the end fit all.
    need = np.zeros(n + 120, dtype=np.uint8)
    need[:n] = np.searchsorted(_LIMITS, values, side="right")
    select = np.full(n, ESCAPE, dtype=np.uint8)
    # Largest class among the next ``count`` values, widened from selector to selector.
    widest, reach = need, 1
    for s in range(len(SELECTORS) - 1, 0, -1):
        count, _ = SELECTORS[s]
        while reach < count:
            step = min(reach, count - reach)
            widest, reach = np.maximum(widest[:-step], widest[step:]), reach + step
        select[widest[:n] < s] = s
    steps = COUNTS[select].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts, dtype=np.int64)
    chosen = select[starts]
    escaped = chosen == ESCAPE
    place = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), dtype=np.uint64)
    padded = np.concatenate([values, np.zeros(120, dtype=np.uint64)])
    for s in np.unique(chosen):
        count, bits = SELECTORS[s]
        own = chosen == s
        where, first = place[own], starts[own]
        if s == ESCAPE:
            words[where + 1] = values[first]
            continue
        packed = np.full(len(first), np.uint64(int(s) << 60), dtype=np.uint64)
        for k in range(count if bits else 0):
            packed |= padded[first + k] << np.uint64(bits * k)
        words[where] = packed
    return words.astype("<u8", copy=False)


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of ``words``."""
    words = np.asarray(words, dtype="<u8").astype(np.uint64, copy=False)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    select = (words >> np.uint64(60)).astype(np.int64)
    heads = np.arange(len(words))
    if (select == ESCAPE).any():
        # A raw word may look like an escape itself, so runs of them are walked in order.
        raw = np.zeros(len(words), dtype=bool)
        last = -2
        for i in np.flatnonzero(select == ESCAPE).tolist():
            if i != last:
                raw[i + 1] = True
                last = i + 1
        heads = np.flatnonzero(~raw)
    select = select[heads]
    counts = COUNTS[select]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(select):
        count, bits = SELECTORS[s]
        own = select == s
        where = first[own]
        if s == ESCAPE:
            out[where] = words[heads[own] + 1]
            continue
        word, mask = words[heads[own]], np.uint64((1 << bits) - 1)
        for k in range(count if bits else 0):
            out[where + k] = (word >> np.uint64(bits * k)) & mask
    return out[:n]
