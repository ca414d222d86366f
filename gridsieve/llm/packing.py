"""Packing of token sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.memory import giving_back
from gridsieve.llm.tokens import encoded
from gridsieve.session import settle

WINDOW = 2048
# Lengths whose triples are enumerated; pairs are enumerated for all lengths.
TRIPLE_LENGTHS = 64
SWEEPS = 60
# Documents that a task plans and packs at a time.
CHUNK = 4096

PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_FIELDS = pa.schema([(c.split()[0], pa.int64()) for c in PIECE_SCHEMA.split(", ")])


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill a window exactly.

    ``histogram[l]`` counts the documents with ``l`` ids left after whole windows.
    """
    window = len(histogram)
    have = set(np.flatnonzero(histogram[1:]) + 1)
    found = {(a, window - a) for a in have if a <= window - a and window - a in have}
    frequent = np.argsort(-histogram[1:], kind="stable")[:TRIPLE_LENGTHS] + 1
    for a, b in combinations_with_replacement(sorted(set(frequent.tolist()) & have), 2):
        c = window - a - b
        if c in have:
            found.add(tuple(sorted((a, b, c))))
    return sorted(tuple(int(v) for v in f) for f in found)


def nonnegative_least_squares(
    combos: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = SWEEPS
) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, by cyclic coordinate descent.

    Column j of A counts each length in combination j, so it has three entries at most.
    """
    columns = []
    for combo in combos:
        lengths, times = np.unique(np.array(combo), return_counts=True)
        columns.append((lengths.tolist(), times.tolist(), float((times**2).sum())))
    left = histogram.astype(float).tolist()
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, (lengths, times, norm) in enumerate(columns):
            step = sum(t * left[n] for n, t in zip(lengths, times)) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, t in zip(lengths, times):
                    left[n] -= t * step
        if moved < 1e-3:
            break
    return np.array(x)


def packing_plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], float]]:
    """Combinations with their repeat counts per document, most repeated first."""
    total = float(histogram.sum())
    combos = combinations(histogram)
    if not combos:
        return []
    x = nonnegative_least_squares(combos, histogram)
    used = [(c, float(v) / total) for c, v in zip(combos, x) if v > 0]
    return sorted(used, key=lambda cv: (-cv[1], cv[0]))


class _Packer:
    """Packs chunks of documents; what stays open at a chunk's end goes on in the next."""

    def __init__(self, plan, window: int, width: int, first_sequence: int):
        self.plan, self.window, self.width = plan, window, width
        self.sequence = first_sequence
        self.open: list = []
        self.fill = 0
        self.rows: list[tuple] = []

    def _crc(self, raw: bytes) -> int:
        return zlib.crc32(np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes())

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, raw, total in pieces:
            n = len(raw) // self.width
            self.rows.append((doc, start, n, self._crc(raw), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def _append(self, piece) -> None:
        """Add a piece to the open sequence, cut where the window ends."""
        doc, start, raw, total = piece
        while raw:
            room = (self.window - self.fill) * self.width
            head, raw = raw[:room], raw[room:]
            self.open.append((doc, start, head, total))
            self.fill += len(head) // self.width
            start += len(head) // self.width
            if self.fill == self.window:
                self._emit(self.open)
                self.open, self.fill = [], 0

    def chunk(self, documents: list) -> None:
        """Pack (doc_id, ids as bytes) pairs."""
        rest = defaultdict(list)
        for doc, raw in documents:
            total = len(raw) // self.width
            full = total - total % self.window
            for start in range(0, full, self.window):
                cut = raw[start * self.width : (start + self.window) * self.width]
                self._emit([(doc, start, cut, total)])
            if total > full:
                rest[total - full].append((doc, full, raw[full * self.width :], total))
        for combo, share in self.plan:
            times = int(np.ceil(share * len(documents)))
            need = {n: combo.count(n) for n in combo}
            while times and all(len(rest.get(n, ())) >= k for n, k in need.items()):
                self._emit([rest[n].pop() for n in combo])
                times -= 1
        for n in sorted(rest, reverse=True):
            for piece in rest[n]:
                self._append(piece)

    def finish(self) -> None:
        """Close the open sequence in parts of power-of-two lengths, which need no padding."""
        pieces, fill = self.open, self.fill
        self.open, self.fill = [], 0
        for bit in range(fill.bit_length() - 1, -1, -1):
            if not fill >> bit & 1:
                continue
            room, part = (1 << bit) * self.width, []
            while room:
                doc, start, raw, total = pieces[0]
                head, tail = raw[:room], raw[room:]
                part.append((doc, start, head, total))
                room -= len(head)
                if tail:
                    pieces[0] = (doc, start + len(head) // self.width, tail, total)
                else:
                    pieces.pop(0)
            self._emit(part)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], schema=_FIELDS
        )


def token_table(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """(doc_id, width, ids) with two bytes an id where a text's ids allow it, else four.

    The table is settled, so later steps read it rather than encode again.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            widths, out = [], []
            for raw in encoded(tokenizer_path, texts, end_id, added_tokens=added_tokens):
                ids = np.frombuffer(raw, dtype="<u4")
                small = int(ids.max()) < 1 << 16
                widths.append(2 if small else 4)
                out.append(ids.astype("<u2").tobytes() if small else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(widths, pa.int32()), pa.array(out, pa.binary())],
                names=["doc_id", "width", "ids"],
            )

    return settle(rows.mapInArrow(giving_back(encode), "doc_id bigint, width int, ids binary"), "tokens")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``window`` ids.

    Whole windows are cut off first.  The histogram of the rest has one number for each
    length below the window; least squares over it says how often each exact combination
    should occur.  Each task realises that plan on its own documents, a chunk at a time, and
    packs what is left in descending length, cut at window ends.  Only a task's last
    sequences are shorter than the window; their lengths are powers of two, so nothing is
    padded.

    An empty table gives no rows; an empty or null text is its end id; repeated rows are
    packed each; a null id stays null.  Names of added tokens are these tokens with
    ``added_tokens``, else plain text.
    """
    table = token_table(docs, tokenizer_path, end_id, id_col, text_col, added_tokens)
    lengths = (F.octet_length("ids") / F.col("width")).cast("bigint")
    counted = (
        table.select((lengths % window).alias("n")).groupBy("n").count().collect()
    )  # at most one row for each length below the window
    histogram = np.zeros(window)
    for r in counted:
        if r["n"]:
            histogram[r["n"]] = r["count"]
    plan = packing_plan(histogram)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(plan, window, 4, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                documents = []
                for doc, width, raw in zip(*(c.to_pylist() for c in part.columns)):
                    if width == 2:
                        raw = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    documents.append((doc, raw))
                packer.chunk(documents)
                yield packer.take()
        packer.finish()
        yield packer.take()

    return table.mapInArrow(giving_back(pack), PIECE_SCHEMA)
