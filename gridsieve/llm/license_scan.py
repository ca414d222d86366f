"""Licence statements: Aho-Corasick for tags and notices, a shunting-yard for expressions."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridsieve.llm.automaton import benchmark_words

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licence identifiers, from the freest class to the most restrictive one.
IDENTIFIERS = {
    "public-domain": ("cc0-1.0", "unlicense", "0bsd", "wtfpl", "cc-pddc"),
    "permissive": (
        "mit", "mit-0", "isc", "zlib", "bsl-1.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause",
        "apache-1.1", "apache-2.0", "python-2.0", "psf-2.0", "postgresql", "ncsa", "unicode-3.0",
        "cc-by-3.0", "cc-by-4.0", "ofl-1.1", "artistic-2.0", "ms-pl",
    ),
    "weak-copyleft": (
        "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0",
        "cddl-1.0", "eupl-1.2", "cc-by-sa-3.0", "cc-by-sa-4.0",
    ),
    "copyleft": ("gpl-1.0", "gpl-2.0", "gpl-3.0", "agpl-3.0", "gfdl-1.3", "odbl-1.0"),
    "restricted": (
        "cc-by-nd-4.0", "cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "busl-1.1",
        "sspl-1.0", "elastic-2.0", "proprietary",
    ),
}
CLASSES = (*IDENTIFIERS, "unknown")
UNKNOWN = CLASSES.index("unknown")
CLASS_OF = {name: k for k, c in enumerate(IDENTIFIERS) for name in IDENTIFIERS[c]}

# Notice phrases, in the words of the scanner, and what they state.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "apache 2 0 license": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license v2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license v3": "gpl-3.0",
    "gnu lesser general public license": "lgpl-2.1",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu affero general public license": "agpl-3.0",
    "gnu free documentation license": "gfdl-1.3",
    "mozilla public license": "mpl-2.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "mit license": "mit",
    "expat license": "mit",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl-1.0",
    "bsd 2 clause license": "bsd-2-clause",
    "simplified bsd license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "new bsd license": "bsd-3-clause",
    "cc by 3 0": "cc-by-3.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 3 0": "cc-by-sa-3.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "creative commons attribution 4 0": "cc-by-4.0",
    "creative commons attribution sharealike 4 0": "cc-by-sa-4.0",
    "creative commons attribution noncommercial 4 0": "cc-by-nc-4.0",
    "cc0 1 0": "cc0-1.0",
    "creative commons zero": "cc0-1.0",
    "dedicated to the public domain": "cc-pddc",
    "open database license": "odbl-1.0",
    "sil open font license": "ofl-1.1",
    "business source license": "busl-1.1",
    "server side public license": "sspl-1.0",
    "all rights reserved": "proprietary",
}

# Tags that a licence expression follows, and exceptions that free linking.
TAGS = (
    "spdx-license-identifier:", "spdx-licence-identifier:", "license-expression:",
    "packagelicensedeclared:", "packagelicenseconcluded:",
)
EXCEPTIONS = (
    "classpath-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "llvm-exception",
    "autoconf-exception-3.0", "bison-exception-2.2", "font-exception-2.0", "openssl-exception",
)
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
# Words that may stand between two notices of one expression, beside its operator.
BETWEEN = frozenset(("the", "a", "an", "either", "both"))
# Confidence in a statement: a tag with a sound expression, a broken one, a notice, a phrase.
SOUND, BROKEN, NOTICE, PHRASE = 1.0, 0.8, 0.9, 0.6

_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.:_-]*\+?")


@dataclass
class Terms:
    """A licence expression evaluated: class of the freest choice, its labels, all labels."""

    level: int
    choice: list[str]
    labels: list[str]
    parts: deque[str]
    holds: int = 4  # precedence of the outermost operator, for brackets in ``text``

    @property
    def text(self) -> str:
        return "".join(self.parts)


def licence_label(identifier: str) -> str:
    """A known identifier without its -only / -or-later / + ending, else "other"."""
    name = re.sub(r"(\+|-only|-or-later)$", "", identifier)
    return name if name in CLASS_OF else "other"


def _leaf(token: str) -> Terms:
    label = licence_label(token)
    return Terms(CLASS_OF.get(label, UNKNOWN), [label], [label], deque([token]))


def _union(a: list[str], b: list[str]) -> list[str]:
    return list(dict.fromkeys((*a, *b)))


def _joined(operator: str, sides: tuple[Terms, Terms]) -> deque[str]:
    """Both sides around the operator; the shorter one is moved, so chains stay linear."""
    for t in sides:
        if t.holds < PRECEDENCE[operator]:
            t.parts.appendleft("(")
            t.parts.append(")")
    left, right = (t.parts for t in sides)
    left.append(f" {operator.upper()} ")
    if len(left) >= len(right):
        left.extend(right)
        return left
    right.extendleft(reversed(left))
    return right


def _apply(operator: str, a: Terms, b: Terms) -> Terms:
    rank = PRECEDENCE[operator]
    freeing = len(b.parts) == 1 and b.parts[0] in EXCEPTIONS and CLASSES[a.level] == "copyleft"
    text = _joined(operator, (a, b))
    if operator == "with":
        return Terms(a.level - freeing, a.choice, a.labels, text, rank)
    labels = _union(a.labels, b.labels)
    if operator == "or":
        best = b if b.level < a.level else a
        return Terms(best.level, best.choice, labels, text, rank)
    return Terms(max(a.level, b.level), _union(a.choice, b.choice), labels, text, rank)


def evaluate(tokens: list[str]) -> tuple[Terms | None, bool]:
    """Value of an expression by Dijkstra's shunting-yard, and whether it is sound.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``; all group to the left.
    "or" is a choice of the freer side (the left one if equal), "and" asks for both sides.  The
    expression ends where an operand follows an operand, as prose after it does.  Missing
    operands and brackets are passed over; such an expression is not sound.
    """
    values: list[Terms] = []
    stack: list[str] = []
    sound, operand_next = True, True

    def reduce_top() -> None:
        nonlocal sound
        operator = stack.pop()
        if operator == "(" or len(values) < 2:
            sound = False
            return
        b = values.pop()
        values.append(_apply(operator, values.pop(), b))

    for token in tokens:
        if token in PRECEDENCE:
            if operand_next:
                sound = False
                continue
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                reduce_top()
            stack.append(token)
            operand_next = True
        elif token == ")":
            if "(" not in stack:
                break
            if operand_next:
                sound = False
                if stack[-1] != "(":
                    stack.pop()
            while stack[-1] != "(":
                reduce_top()
            stack.pop()
            operand_next = not values
        elif not operand_next:
            break
        elif token == "(":
            stack.append(token)
        else:
            values.append(_leaf(token))
            operand_next = False
    if operand_next:
        sound = False
        while stack and stack[-1] in PRECEDENCE:
            stack.pop()
    while stack:
        reduce_top()
    return (values[-1] if values else None), sound and bool(values)


@cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """One automaton over words set apart by spaces, one over the lower-cased text."""
    phrases = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE_PHRASES}:
        spoken = f" {phrase} "
        size = phrase.count(" ") + 1
        phrases.add_word(spoken, (len(spoken), size, BASE_PHRASES.get(phrase), NOTICES.get(phrase)))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    for tag in TAGS:
        tags.add_word(tag, tag)
    tags.make_automaton()
    return phrases, tags


@dataclass
class Scan:
    """What a text states: places of phrases and notices, and evaluated expressions."""

    n_words: int = 0
    base: list[tuple[int, str]] = field(default_factory=list)
    notices: list[tuple[int, int, str]] = field(default_factory=list)
    tagged: list[tuple[Terms, bool]] = field(default_factory=list)
    noticed: list[Terms] = field(default_factory=list)


def _notice_expressions(words: list[bytes], notices: list[tuple[int, int, str]]) -> list[Terms]:
    """Notices joined by nothing but an operator are one expression."""
    out, tokens, last = [], [], None
    for at, size, label in notices:
        between = []
        if last is not None and at - last <= 4:
            between = [w for w in words[last:at] if w.decode("latin-1") not in BETWEEN]
        if len(between) == 1 and between[0] in (b"and", b"or"):
            tokens += [between[0].decode(), label]
        else:
            if tokens:
                out.append(evaluate(tokens)[0])
            tokens = [label]
        last = at + size
    if tokens:
        out.append(evaluate(tokens)[0])
    return out


def scan_text(text: str | None) -> Scan:
    """All licence statements of a whole text; of notices that overlap the longest counts."""
    words = benchmark_words(text)
    found = Scan(len(words))
    phrases, tags = _automata()
    spoken = f" {b' '.join(words).decode('latin-1')} "
    counted = place = 0
    hits = []
    for end, (length, size, base, notice) in phrases.iter(spoken):
        hits.append((end + 1 - length, -size, base, notice))
    hits.sort(key=lambda h: h[:2])
    free = 0
    for start, size, base, notice in hits:
        counted += spoken.count(" ", place, start)
        place = start
        if base:
            found.base.append((counted, base))
        if notice and counted >= free:
            free = counted - size
            found.notices.append((counted, -size, notice))
    found.noticed = _notice_expressions(words, found.notices)
    lower = (text or "").lower()
    for end, _ in tags.iter(lower):
        line = lower[end + 1 : _line_end(lower, end + 1)]
        terms, sound = evaluate(_TOKEN.findall(line))
        if terms:
            found.tagged.append((terms, sound))
    return found


def _line_end(text: str, start: int) -> int:
    at = text.find("\n", start)
    return len(text) if at < 0 else at


def score(found: Scan) -> float:
    """Confidence that the text states a licence, by its strongest statement."""
    kinds = [SOUND if sound else BROKEN for _, sound in found.tagged]
    kinds += [NOTICE] * bool(found.notices) + [PHRASE] * bool(found.base)
    return max(kinds, default=0.0)


_SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, expressions array<string>, choice string, licence_class string"
)


def _row(found: Scan) -> dict:
    places = [at for at, _ in found.base]
    base = {label for _, label in found.base}
    terms = [t for t, _ in found.tagged] + found.noticed
    stated = {label for t in terms for label in t.labels}
    # Separate statements all hold, so together they are as strict as the strictest.
    strictest = max((t.level for t in terms), default=None)
    return {
        "n_words": found.n_words,
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | stated)),
        "score": score(found),
        "expressions": [t.text for t in terms],
        "choice": ",".join(sorted({c for t in terms for c in t.choice})),
        "licence_class": None if strictest is None else CLASSES[strictest],
    }


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, the scan's counts and labels, and what is allowed.

    n_base, first_word, last_word: places of the base phrases; base_labels and labels: distinct,
    sorted, comma-joined; score: confidence in the strongest statement; expressions: the
    evaluated expressions in upper-case operators, tagged ones first; choice: the labels chosen
    where there is a choice; licence_class: the strictest class over all statements.

    Null or empty texts have no words, empty labels, score 0, null places and class.  Whole texts
    are scanned in linear time; repeated rows are reported each; ids may be null; no rows give
    no rows.  Other columns, whatever their names, are not carried.  No shuffle; one text at a
    time is in a worker's memory beside its Arrow batch.
    """
    fields = StructType.fromDDL(_SCHEMA).names
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        types += [pa.list_(pa.string()), pa.string(), pa.string()]
        for batch in batches:
            rows = [_row(scan_text(t.as_py())) for t in batch.column(1)]
            made = [pa.array([r[f] for r in rows], t) for f, t in zip(fields, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *fields])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(scan, f"doc_id {id_type}, {_SCHEMA}")
