"""A generalised suffix automaton over word sequences, for windows of benchmark items."""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np

# Bytes that end a word, after A-Z became a-z.
_BREAKS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_AS_SPACE = bytes(0x20 if b in _BREAKS else b for b in range(256))


def benchmark_words(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only) of letters, digits and all characters above ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_AS_SPACE).split()


class SuffixAutomaton:
    """All substrings of the items' word sequences.

    A window is ``size`` consecutive words of an item; an item of fewer, but not none, is
    one window.  States hold transitions by word number, the suffix link and the longest
    length; each state knows the window state that its long matches end with, and the short
    items that end at it or at one of its suffixes.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.size = size
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.longest = [0]
        sequences = []
        for name, words in items:
            numbers = [self.words.setdefault(w, len(self.words)) for w in words]
            sequences.append((name, numbers))
            state = 0
            for w in numbers:
                state = self._extend(state, w)
        self.least = min([size, *(len(n) for _, n in sequences if n)])
        self._windows()
        self._name(sequences)

    def _add(self, longest: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.next) - 1

    def _split(self, state: int, at: int, word: int) -> int:
        """A copy of ``at`` for its suffixes up to the length that ``state`` leads to."""
        copy = self._add(self.longest[state] + 1, self.link[at], dict(self.next[at]))
        self.link[at] = copy
        while state >= 0 and self.next[state].get(word) == at:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.longest[known] == self.longest[last] + 1:
                return known
            return self._split(last, known, word)
        new = self._add(self.longest[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            known = self.next[state][word]
            if self.longest[known] == self.longest[state] + 1:
                self.link[new] = known
            else:
                self.link[new] = self._split(state, known, word)
        return new

    def _windows(self) -> None:
        self.window = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.longest.__getitem__):
            if self.longest[s] >= self.size:
                up = self.link[s]
                self.window[s] = self.window[up] if self.longest[up] >= self.size else s

    def _name(self, sequences) -> None:
        self.items: dict[int, set[str]] = defaultdict(set)
        own: dict[int, list[tuple[int, str]]] = defaultdict(list)
        self.short: list[list[tuple[int, str]]] = [[]] * len(self.next)
        for name, numbers in sequences:
            for _, state, length in self._steps(numbers):
                if length >= self.size:
                    self.items[self.window[state]].add(name)
            if 0 < len(numbers) < self.size:
                state = 0
                for w in numbers:
                    state = self.next[state][w]
                own[state].append((len(numbers), name))
        for s in sorted(range(1, len(self.next)), key=self.longest.__getitem__):
            if s in own or self.short[self.link[s]]:
                self.short[s] = own.get(s, []) + self.short[self.link[s]]

    def _steps(self, numbers):
        """(position, state, longest matching length) after each word; -1 is a strange word."""
        following, link, longest = self.next, self.link, self.longest
        state = length = 0
        for at, w in enumerate(numbers):
            to = following[state].get(w)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = following[state].get(w)
            if to is None:
                length = 0
                continue
            state = to
            length += 1
            yield at, state, length

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [from, to) of words inside windows, and the items of those windows."""
        n = len(words)
        numbers = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, n)
        # A window lies in a run of known words; shorter runs hold none.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], numbers >= 0, [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        size = self.size
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.least:
                continue
            for at, state, length in self._steps(numbers[a:b].tolist()):
                deep = 0
                if length >= size:
                    deep = size
                    found |= self.items[self.window[state]]
                for m, name in self.short[state]:
                    if m <= length:
                        deep = max(deep, m)
                        found.add(name)
                if deep:
                    low, high = a + at + 1 - deep, a + at + 1
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append((low, high))
        return spans, found
