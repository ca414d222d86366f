"""Quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.memory import giving_back

# Buckets of words and of word forms; a form is a word's shape, e.g. "Aa." for "Thing.".
WORD_BUCKETS = 1 << 14
FORM_BUCKETS = 1 << 10
# A text holds step k if at least this share of its words equals the word before.
STUTTER_STEPS = (0.12, 0.2, 0.3, 0.4, 0.5)
STUTTER_AT = WORD_BUCKETS + FORM_BUCKETS
BUCKETS = STUTTER_AT + len(STUTTER_STEPS)
FORM_WEIGHT = 3.0
STUTTER_WEIGHT = 15.0
DIMENSIONS = 48
# Labelled documents the model is fitted on, for each of the two labels (about).
SAMPLE_PER_LABEL = 1500
NEIGHBOURS = 25
SHARPNESS = 4.0
ACCEPTED = 0.7
# Documents whose cosines with all labelled vectors are held at a time.
BLOCK = 128

_KNOWN: dict[str, tuple[int, int]] = {}


def word_form(word: str) -> str:
    """Runs of capitals, letters, digits and of each other character, as one sign each."""
    out = []
    for c in word:
        sign = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != sign:
            out.append(sign)
    return "".join(out)


def _buckets(word: str) -> tuple[int, int]:
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) > 50_000:
            _KNOWN.clear()
        low = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        form = zlib.crc32(word_form(word).encode("utf-8", "surrogatepass")) % FORM_BUCKETS
        found = _KNOWN[word] = (low, WORD_BUCKETS + form)
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text, buckets ascending."""
    words = (text or "").split()
    counted = Counter(words)
    if not counted:
        return np.empty(0, np.int64), np.empty(0)
    share = sum(map(eq, words, islice(words, 1, None))) / len(words)
    steps = [k for k, least in enumerate(STUTTER_STEPS, STUTTER_AT) if share >= least]
    both = np.array([_buckets(w) for w in counted], dtype=np.int64)
    counts = np.fromiter(counted.values(), np.float64, len(counted))
    own, place = np.unique(both.T.ravel(), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate((counts, counts)))
    if steps:
        own = np.concatenate((own, np.array(steps, dtype=np.int64)))
        counts = np.concatenate((counts, np.ones(len(steps))))
    return own, counts


@dataclass
class VotingModel:
    """Idf of all buckets, the latent basis, and the labelled vectors with their votes."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray  # share of the label's documents that one sample row stands for
    labels: np.ndarray
    prior: float

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors of documents in the latent space; zero without features."""
        out = np.zeros((len(rows), self.basis.shape[1]), dtype=np.float32)
        sizes = [len(b) for b, _ in rows]
        if sum(sizes):
            at = np.concatenate([b for b, _ in rows])
            weighed = (1 + np.log(np.concatenate([c for _, c in rows]))) * self.idf[at]
            starts = np.cumsum([0, *sizes[:-1]])
            full = np.array(sizes) > 0
            products = self.basis[at] * weighed[:, None].astype(np.float32)
            out[full] = np.add.reduceat(products, starts[full], axis=0)
        return _unit(out)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Weighted votes of the nearest labelled vectors, block by block.

        Every cosine is computed; a neighbour's vote weighs its similarity to the power of
        ``SHARPNESS``.  Without a similar neighbour the score is the prior.
        """
        out = np.full(len(vectors), self.prior)
        k = min(NEIGHBOURS, len(self.vectors))
        if not k:
            return out
        for at in range(0, len(vectors), BLOCK):
            cosines = vectors[at : at + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            near_cos = np.take_along_axis(cosines, near, axis=1)
            weights = np.clip(near_cos, 0, 1) ** SHARPNESS * self.votes[near]
            total = weights.sum(axis=1)
            some = total > 1e-9
            voted = (weights * self.labels[near]).sum(axis=1)
            out[at : at + BLOCK][some] = voted[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 1e-12)


def latent_basis(rows, idf: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Leading right singular vectors of the weighted sample, by subspace iteration."""
    rng = np.random.default_rng(7)
    basis = rng.standard_normal((len(idf), dimensions + 8)).astype(np.float32)
    held = [(b, ((1 + np.log(c)) * idf[b]).astype(np.float32)) for b, c in rows if len(b)]
    held = [(b, w / max(float(np.linalg.norm(w)), 1e-12)) for b, w in held]
    if not held:
        return np.zeros((len(idf), dimensions), dtype=np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(basis)
        image = np.zeros_like(basis)
        for b, w in held:
            image[b] += w[:, None] * (w @ basis[b])[None, :]
        basis = image
    basis, _ = np.linalg.qr(basis)
    left = np.stack([w @ basis[b] for b, w in held])
    _, _, turn = np.linalg.svd(left, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :dimensions], dtype=np.float32)


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents), over the whole table.

    Every task sends one row for each bucket at most; BUCKETS rows come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[features(text.as_py())[0]] += 1
            total[BUCKETS] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"]
        )

    counted = (
        docs.select(F.col(text_col)).mapInArrow(giving_back(count), "bucket bigint, n bigint")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    )  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in counted:
        out[r["bucket"]] = r["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[list, dict]:
    """Sampled features with their labels, and the labelled rows of each label.

    The sample is a hash range of the ids of rows that may be learned from, sized from the
    counts of both labels; its rows are few, so the ids are broadcast and only features come
    to the driver.  An id that is labelled on several rows counts once, with its highest
    label.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
        .where("doc_id is not null and quality in (0, 1)")
        .where(~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("quality") == label, F.lit(per_label / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(draw < share)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id"  # about 2 * per_label rows
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("quality").cast(pa.int32()),
                    pa.array([b for b, _ in found], pa.list_(pa.int64())),
                    pa.array([c for _, c in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "quality", "buckets", "counts"],
            )

    schema = "doc_id bigint, quality int, buckets array<bigint>, counts array<double>"
    table = rows.mapInArrow(giving_back(describe), schema).toArrow()
    order = np.lexsort((table.column("quality").to_numpy(), table.column("doc_id").to_numpy()))
    sample = []
    for i in order.tolist():
        own = [table.column(c)[i] for c in ("quality", "buckets", "counts")]
        vector = (own[1].values.to_numpy(), own[2].values.to_numpy())
        sample.append((own[0].as_py(), vector))
    return sample, counts


def fit_votes(
    docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL
) -> VotingModel:
    """Idf from all documents; basis and labelled vectors from a bounded sample.

    Without any usable label every score is 0.5.
    """
    frequencies, n = document_frequencies(docs)
    idf = np.log((n + 1) / (frequencies + 1))
    idf[WORD_BUCKETS:STUTTER_AT] = FORM_WEIGHT * (0.1 + idf[WORD_BUCKETS:STUTTER_AT])
    idf[STUTTER_AT:] *= STUTTER_WEIGHT
    sample, counts = labelled_sample(docs, labels, per_label)
    rows = [v for _, v in sample]
    y = np.array([q for q, _ in sample], dtype=np.float64)
    basis = latent_basis(rows, idf)
    total = sum(counts.values())
    votes = np.array([counts[int(q)] / max(1, (y == q).sum()) for q in y], dtype=np.float64)
    model = VotingModel(idf, basis, np.zeros((0, DIMENSIONS), np.float32), votes, y, 0.5)
    model.prior = counts.get(1, 0) / total if total else 0.5
    model.vectors = model.project(rows)
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", model: VotingModel | None = None
) -> DataFrame:
    """Columns of ``docs`` and quality_score, the voted probability of label 1.

    Documents are not shuffled; the broadcast model's size is fixed by the constants above.
    Only the text is an input.  A null or empty text gets the share of label 1 among the
    labelled rows.  A clashing column is replaced.
    """
    docs = docs.drop("quality_score")
    if model is None:
        model = fit_votes(docs.withColumn("text", F.col(text_col)), labels)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def voted(column: pa.Array) -> pa.Array:
        model, out = held.value, []
        for start in range(0, len(column), BLOCK):
            texts = column.slice(start, BLOCK)
            out.append(model.scores(model.project([features(t.as_py()) for t in texts])))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return docs.withColumn("quality_score", voted(F.col(text_col)))


def quality_votes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``ACCEPTED`` on) of every document.

    Repeated rows are scored each; an empty table gives no rows; a null id is not held out.
    """
    scored = score_quality(docs.select("doc_id", "text"), labels)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= ACCEPTED).cast("int").alias("predicted"),
    )
