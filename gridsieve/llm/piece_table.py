"""Pieces of many texts at once, in arrays: where they lie, and a table of their ids."""

from __future__ import annotations

import numpy as np

# Kinds of characters up to U+00FF, in the classes of ``tokens``; END parts two texts.
OTHER, LETTER, MARK, WHITE, END = range(5)

# Pieces of at most this many characters are their own key: two machine words.
SHORT = 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype="<u8")


def piece_starts(chars: np.ndarray, kinds: np.ndarray, with_space: bool) -> tuple:
    """(starts, ends) of the pieces between ENDs, as the patterns of ``tokens`` cut them.

    Runs of one kind are pieces, but a run before an OTHER goes on to the next white space.
    ``with_space``: one space belongs to the word after it, other white space is a piece, and
    its last character one of its own where a word follows.
    """
    change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    runs = np.concatenate(([0], change))
    kind = kinds[runs]
    inside = kind < WHITE
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    # OTHERs up to a run, less those before its stretch between white spaces.
    others = np.cumsum(kind == OTHER)
    before = others - (kind == OTHER)
    here = np.cumsum(opens) - 1
    of_stretch = before[opens]
    after_other = others > (of_stretch[here] if len(of_stretch) else 0)
    # The run before the first OTHER of its stretch takes the rest along and stays a start.
    word = opens | (inside & ~after_other)
    if not with_space:
        starts, nexts = runs[word], np.flatnonzero(word)
        # A piece ends at the next start or white space, whichever comes first.
        stops = np.flatnonzero(word | ~inside)
        at = np.searchsorted(stops, nexts, side="right")
        bounds = np.append(runs[stops], len(kinds))
        return starts, bounds[at]
    white = kind == WHITE
    length = np.diff(np.append(runs, len(kinds)))
    followed = np.zeros(len(runs), bool)
    followed[:-1] = white[:-1] & inside[1:]
    last = runs + length - 1
    space = followed & (chars[last] == 32)
    joined = np.zeros(len(runs), bool)
    joined[1:] = space[:-1]
    starts = np.concatenate(
        (runs[word & ~joined], runs[white], last[followed & (length > 1)], runs[kind == END])
    )
    starts.sort()
    ends = np.append(starts[1:], len(kinds))
    keep = kinds[starts] != END
    return starts[keep], ends[keep]


def keys(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple:
    """The first 16 characters of pieces as two numbers; ``chars`` has 16 more at its end."""
    eight = np.ndarray((len(chars) - 7,), "<u8", chars, strides=(1,))
    low = eight[starts] & _MASKS[np.minimum(lengths, 8)]
    high = np.zeros(len(starts), "<u8")
    long = np.flatnonzero(lengths > 8)
    high[long] = eight[starts[long] + 8] & _MASKS[np.minimum(lengths[long] - 8, 8)]
    return low, high


class PieceTable:
    """Ids of short pieces by their keys.

    Entry 0 is no piece.  When more than half of ``keep`` entries were met since the last such
    moment, those not met since then are forgotten.
    """

    def __init__(self, keep: int):
        self.keep = keep
        self._start_anew(1 << 10)

    def _start_anew(self, room: int) -> None:
        self.n, self.n_ids = 1, 0
        self.low, self.high = np.zeros(room, "<u8"), np.zeros(room, "<u8")
        self.start, self.length = np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.met = np.zeros(room, bool)
        self.ids = np.zeros(2 * room, "<u4")
        self._place(np.arange(0))

    def _first_slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self._last

    def _place(self, entries: np.ndarray) -> None:
        """Slots for all entries; at least half of the slots stay free."""
        if len(entries) == 0 or 2 * self.n > len(self.slots):
            size = max(1 << 12, 1 << (4 * self.n - 1).bit_length())
            self.slots, self._last = np.zeros(size, np.int32), size - 1
            entries = np.arange(1, self.n)
        at = self._first_slot(self.low[entries], self.high[entries])
        while len(entries):
            free = self.slots[at] == 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & self._last

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, 0 where there is none."""
        at = self._first_slot(low, high)
        found = self.slots[at].astype(np.int64)
        left = np.flatnonzero((self.low[found] != low) | (self.high[found] != high))
        left = left[found[left] != 0]
        while len(left):
            at[left] = (at[left] + 1) & self._last
            found[left] = self.slots[at[left]]
            e = found[left]
            left = left[((self.low[e] != low[left]) | (self.high[e] != high[left])) & (e != 0)]
        self.met[found] = True
        return found

    def add(self, low: np.ndarray, high: np.ndarray, ids: list[bytes]) -> None:
        """New distinct pieces and their ids."""
        lengths = np.array([len(i) // 4 for i in ids], np.int32)
        first = self.n
        self.n += len(ids)
        while self.n > len(self.low):
            for name in ("low", "high", "start", "length", "met"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros(len(old), old.dtype))))
        new = slice(first, self.n)
        self.low[new], self.high[new], self.met[new] = low, high, True
        self.start[new], self.length[new] = self.n_ids + np.cumsum(lengths) - lengths, lengths
        self.n_ids = self.borrow(np.frombuffer(b"".join(ids), "<u4"))
        self._place(np.arange(first, self.n))

    def borrow(self, ids: np.ndarray) -> int:
        """Put ``ids`` behind those of the table until the next call; returns their end."""
        end = self.n_ids + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.n_ids], np.zeros(end, "<u4")))
        self.ids[self.n_ids : end] = ids
        return end

    def gather(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids at all places, in order."""
        ends = np.cumsum(lengths)
        at = np.repeat(starts - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.ids[at]

    def forget(self) -> None:
        met = np.flatnonzero(self.met[: self.n])
        if len(met) <= self.keep // 2:
            return
        met = met[met > 0]
        low, high, length = self.low[met], self.high[met], self.length[met]
        ids = self.gather(self.start[met], length)
        self._start_anew(max(1 << 10, 2 * len(met)))
        new = slice(1, len(met) + 1)
        self.n += len(met)
        self.low[new], self.high[new], self.length[new] = low, high, length
        self.start[new] = np.cumsum(length) - length
        self.n_ids = self.borrow(ids)
        self._place(np.arange(0))

    def items(self):
        """(characters as Latin-1 bytes, ids as bytes) of all entries."""
        for e in range(1, self.n):
            raw = self.low[e].tobytes() + self.high[e].tobytes()
            at = self.start[e]
            yield raw.rstrip(b"\0"), self.ids[at : at + self.length[e]].tobytes()
