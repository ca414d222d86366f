"""Token ids of whole texts, with a bounded cache of the pieces between safe cuts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from struct import pack

import numpy as np

from gridsieve.llm import piece_table
from gridsieve.llm.piece_table import PieceTable

# The white space of Unicode, which both tokenizers split on.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Between a letter of the first class and a mark of the second, either way round, every
# split pattern of the public tokenizers ends a piece.  The apostrophe is not a mark: it
# starts contractions.
LETTERS = r"A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"
_WORD = f"[{LETTERS}]+(?![^{WHITE}{MARKS}])|[{MARKS}]+(?![^{WHITE}{LETTERS}])|[^{WHITE}]+"
PIECES_WITHOUT_SPACE = re.compile(_WORD)
PIECES_WITH_SPACE = re.compile(f" ?(?:{_WORD})|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


# Byte-level models spell the bytes that have no visible Latin-1 character with the characters
# from 256 on, in order.
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SPELLING = [chr(256 + _UNSEEN.index(b)) if b in _UNSEEN else chr(b) for b in range(256)]


def _spelled(word: str) -> str:
    """A word of letters, perhaps after a space, as a byte-level model spells it."""
    if word.isascii():
        return word.replace(" ", _SPELLING[32])
    return "".join(map(_SPELLING.__getitem__, word.encode("utf-8")))


def _lowered(word: str) -> str:
    """The same in lower case; the letters of ``LETTERS`` need no other normalising."""
    return _spelled(word.lower())


_BEYOND_LATIN_1 = re.compile("[^\x00-\xff]")

# Kinds and lower case of the characters up to U+00FF.
_KINDS = np.full(256, piece_table.OTHER, np.uint8)
_KINDS[[c for c in range(256) if re.match(f"[{LETTERS}]", chr(c))]] = piece_table.LETTER
_KINDS[[c for c in range(256) if re.match(f"[{MARKS}]", chr(c))]] = piece_table.MARK
_KINDS[[c for c in range(256) if re.match(f"[{WHITE}]", chr(c))]] = piece_table.WHITE
_LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")

# How the ids of a piece are packed, by their number.
_LAYOUTS = [f"<{n}I" for n in range(32)]

_loaded: dict[tuple[str, bool], "PieceTokenizer"] = {}


class PieceTokenizer:
    """The ids of texts as little-endian unsigned 32-bit integers.

    A text is cut where the tokenizer's own split pattern always cuts, each distinct piece
    is encoded once, and a text's ids are its pieces' ids in order.  Texts up to U+00FF are
    cut and looked up in arrays, a call's texts together; others one by one, by the pattern.
    The pieces remembered between calls are at most ``keep`` of each of the two ways and
    those of one call: when half of that is new, what was not met since the last such moment
    is forgotten.  That affects speed only.  With ``added_tokens`` the name of an added token
    in a text, such as <|endoftext|>, is that token, as the tokenizer itself has it;
    otherwise it is plain text.
    """

    def __init__(self, path: str, keep: int = 400_000, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not added_tokens
        self._keep = keep
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._table = PieceTable(keep)
        # Only this part of the file: the whole of it in Python objects is tens of megabytes.
        split = self._tokenizer.pre_tokenizer
        split = json.loads(split.__getstate__()) if split else {}
        parts = tuple(p["type"] for p in split.get("pretokenizers", [split]))
        self._pieces, self._plain, self._form = {
            ("ByteLevel",): (PIECES_WITH_SPACE, re.compile(f" ?[{LETTERS}]+"), _spelled),
            ("Split", "ByteLevel"): (PIECES_WITHOUT_SPACE, re.compile(f"[{LETTERS}]+"), _lowered),
        }.get(parts, (None, None, None))
        self._added, self._added_ids = None, {}
        every = self._tokenizer.get_added_tokens_decoder()
        self._names = [t.content for t in every.values()]
        # Names beyond U+00FF are in no text that is cut in arrays.
        self._raw_names = [n.encode("latin-1") for n in self._names if not _BEYOND_LATIN_1.search(n)]
        added = every if added_tokens else {}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            self._pieces = None
        elif added:
            self._added_ids = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
            names = sorted(self._added_ids, key=len, reverse=True)
            self._added = re.compile("(" + "|".join(map(re.escape, names)) + ")")

    def _encode(self, pieces: list[str]) -> Iterator[bytes]:
        for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False):
            yield np.array(e.ids, dtype="<u4").tobytes()

    @property
    def _known(self) -> dict[str, bytes]:
        """All pieces remembered, with their ids."""
        return self._words | {p.decode("latin-1"): ids for p, ids in self._table.items()}

    def _learnt(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of new ``pieces``; words of ``LETTERS`` need only the model."""
        plain, form, other, found = self._plain.fullmatch, self._form, [], {}
        tokenize = self._tokenizer.model.tokenize
        for p in pieces:
            # The first test is quick and holds for most words.
            if (p.isalpha() and p.isascii()) or plain(p):
                ids = [t.id for t in tokenize(form(p))]
                found[p] = pack(_LAYOUTS[len(ids)] if len(ids) < len(_LAYOUTS) else f"<{len(ids)}I", *ids)
            else:
                other.append(p)
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            found.update(zip(some, self._encode(some)))
        return found

    def _ids_of(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, remembered or learnt."""
        if len(self._words) > self._keep // 2:
            self._words, self._older = {}, self._words
        known, older = self._words, self._older
        known.update(self._added_ids)
        # Known pieces are passed over without a step of Python.
        new = pieces.difference(known)
        if older:
            again = [p for p in new if p in older]
            known.update(zip(again, map(older.__getitem__, again)))
            new.difference_update(again)
        known.update(self._learnt(new))
        # A dictionary of the call's own pieces stays in the processor cache.
        found = dict(zip(pieces, map(known.__getitem__, pieces)))
        found.update(self._added_ids)
        return found

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text; added tokens are cut out first, each a piece of its own."""
        if self._added is None or not self._added.search(text):
            return self._pieces.findall(self._folded(text))
        out = []
        for k, part in enumerate(self._added.split(text)):
            out += [part] if k % 2 else self._pieces.findall(self._folded(part))
        return out

    def _folded(self, text: str) -> str:
        """Lower case if the tokenizer takes it so, and one piece serves both cases.

        Up to U+00FF, one character becomes one character, as the tokenizer has it; beyond,
        Python's rules differ (a capital sigma at a word's end), and the text stays.
        """
        if self._form is not _lowered or (not text.isascii() and _BEYOND_LATIN_1.search(text)):
            return text
        low = text.lower()
        # <|ENDOFTEXT|> is plain text and must not become a name.
        return text if any(name in low for name in self._names) else low

    def _characters(self, text: str) -> bytes | None:
        """One byte a character, folded, if the text can be cut in arrays."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        low = raw.translate(_LOWER) if self._form is _lowered else raw
        # Keys of pieces end with zeros, and names need the pattern.
        if 0 in raw or any(name in raw or name in low for name in self._raw_names):
            return None
        return low

    def _in_arrays(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of texts given as ``_characters``."""
        table = self._table
        joined = b"\n".join(texts) + bytes(piece_table.SHORT + 1)
        chars = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds = _KINDS[chars[: ends[-1] + 1]]
        kinds[ends] = piece_table.END
        starts, stops = piece_table.piece_starts(chars, kinds, self._pieces is PIECES_WITH_SPACE)
        lengths = stops - starts
        low, high = piece_table.keys(chars, starts, lengths)
        table.forget()
        entries = table.find(low, high)
        long = lengths > piece_table.SHORT
        entries[long] = 0
        new = np.flatnonzero((entries == 0) & ~long)
        if len(new):
            spans = zip(starts[new].tolist(), stops[new].tolist())
            places = {joined[a:b].decode("latin-1"): k for (a, b), k in zip(spans, new.tolist())}
            learnt = self._learnt(places)
            where = np.array([places[p] for p in learnt])
            table.add(low[where], high[where], list(learnt.values()))
            entries[new] = table.find(low[new], high[new])
        at, n_ids = table.start[entries], table.length[entries]
        if long.any():
            spans = zip(starts[long].tolist(), stops[long].tolist())
            words = [joined[a:b].decode("latin-1") for a, b in spans]
            distinct = self._ids_of(set(words))
            first, n = {}, table.n_ids
            for word in set(words):
                first[word] = n
                n += len(distinct[word]) // 4
            table.borrow(np.frombuffer(b"".join(map(distinct.__getitem__, first)), "<u4"))
            at[long] = [first[w] for w in words]
            n_ids[long] = [len(distinct[w]) // 4 for w in words]
        ids = table.gather(at, n_ids).tobytes()
        # Ids before each text's end: those of the pieces that start before it.
        sums = np.concatenate(([0], np.cumsum(n_ids, dtype=np.int64))) * 4
        begin = 0
        for end in sums[np.searchsorted(starts, ends)].tolist():
            yield ids[begin:end]
            begin = end

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if self._pieces is None:
            return list(self._encode(texts))
        plain = list(map(self._characters, texts))
        cut = [self._cut(t) for t, raw in zip(texts, plain) if raw is None]
        ids = self._ids_of(set(chain.from_iterable(cut))).__getitem__ if cut else None
        one_by_one = (b"".join(map(ids, pieces)) for pieces in cut)
        quick = [raw for raw in plain if raw is not None]
        together = self._in_arrays(quick) if quick else iter(())
        return [next(one_by_one if raw is None else together) for raw in plain]


def tokenizer(path: str, added_tokens: bool = False) -> PieceTokenizer:
    """The tokenizer of ``path``, loaded once per Python worker."""
    if (path, added_tokens) not in _loaded:
        _loaded[path, added_tokens] = PieceTokenizer(path, added_tokens=added_tokens)
    return _loaded[path, added_tokens]


def encoded(
    path: str, texts: list, end_id: int, at_once: int = 32, added_tokens: bool = False
) -> Iterator[bytes]:
    """Ids of every text followed by ``end_id``; a null text counts as empty."""
    encode = tokenizer(path, added_tokens)
    end = np.array([end_id], dtype="<u4").tobytes()
    for at in range(0, len(texts), at_once):
        for ids in encode(texts[at : at + at_once]):
            yield ids + end
