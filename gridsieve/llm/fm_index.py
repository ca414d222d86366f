"""A compressed full-text index over word numbers: BWT in a wavelet matrix."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text``, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        changed = np.diff(key[order]) != 0
        rank[order] = np.concatenate(([0], np.cumsum(changed)))
        step *= 2
        if step >= n or changed.all():
            return order


class BitVector:
    """Packed bits with a running count for every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate((np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)))
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each index."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(low)


class FMIndex:
    """Backward search over ``text``, whose numbers lie in 0..top.

    Numbers are held one higher, as a smallest end mark follows the text.
    """

    def __init__(self, text: np.ndarray):
        text = np.concatenate((text + 1, np.zeros(1, dtype=text.dtype)))
        self.order = suffix_array(text)
        bwt = text[self.order - 1]
        counts = np.bincount(text)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.levels = max(1, int(len(counts) - 1).bit_length())
        self.bits = []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level & 1).astype(np.uint8)
            self.bits.append(BitVector(bit))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        # Rank of the start of a number's run after the last level.
        self.starts = self._descend(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    def _descend(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits):
            ones = bits.rank(at)
            at = np.where(numbers >> level & 1, bits.zeros + ones, at - ones)
        return at

    def step(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Suffix ranges after one more number in front of each pattern."""
        numbers = numbers + 1
        base = self.first[numbers] - self.starts[numbers]
        both = self._descend(np.concatenate((numbers, numbers)), np.concatenate((low, high)))
        return base + both[: len(low)], base + both[len(low) :]

    def everywhere(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of the empty pattern, ``n`` times."""
        return np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)


def matching_windows(
    index: FMIndex, text: np.ndarray, ends: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Backward search of the ``size`` numbers before each end, all at once.

    The text itself is indexed, so a pattern whose range shrinks to one suffix occurs once
    and leaves the search.  Returns (which ends remain, low, high).
    """
    alive = np.arange(len(ends))
    low, high = index.everywhere(len(ends))
    for k in range(1, size + 1):
        low, high = index.step(text[ends[alive] - k], low, high)
        more = high - low > 1
        alive, low, high = alive[more], low[more], high[more]
        if not len(alive):
            break
    return alive, low, high


def earliest(index: FMIndex, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest text place in each suffix range."""
    if not len(low):
        return np.empty(0, dtype=np.int64)
    ranges, back = np.unique(np.stack((low, high), axis=1), axis=0, return_inverse=True)
    sizes = ranges[:, 1] - ranges[:, 0]
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(starts, sizes) + np.repeat(ranges[:, 0], sizes)
    return np.minimum.reduceat(index.order[inside], starts)[back.reshape(-1)]
