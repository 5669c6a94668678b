"""Quality by nearest-neighbour voting among labelled latent-semantic vectors (operator 3).

A text's terms are its words, hashed into ``WORDS`` buckets, and, as further columns, what its make-up
shows in any language: pairs of character
classes (runs of letters, digits or space count once; every mark is its own
class), words equal to the word before, words seen before in the text, and new
words.  Terms are weighted by the square root of their share of the text times
idf.  From a bounded sample of labelled texts that are not held out (at most
``SAMPLE`` a class) comes a randomised truncated SVD with ``POWER`` power steps; the sample's latent vectors, a bounded
matrix, are broadcast.  Every document is then projected and multiplied, block by
block, with all of them: exact cosines.  The ``K`` nearest vote for their labels,
weighted by cosine to the power ``SHARPNESS`` and by how many labelled texts of its class a sampled one
stands for, so that scores don't drift as the table outgrows the sample.

Defined results: null and empty texts score 0; so do all if no labels are there;
an empty table gives no rows.
A null doc_id counts as held out.  Repeated rows score alike; ties among
neighbours go by their order in the sample, which their ids fix.  Very long texts
are scored whole, one in memory at a time.  Only doc_id,
text and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import held_out, labelled_sample, table

SAMPLE = 2000
DIMENSIONS = 32
OVERSAMPLE, POWER = 16, 3
WORDS = 2048
#: The words' part of a text's squared length.
WORD_SHARE = 0.25
K = 15
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK = 256

_MARKS = [i for i in range(33, 127) if not chr(i).isalnum()]
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE = range(5)
CLASSES = 5 + len(_MARKS)
_CLASS = np.full(256, _LOWER, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[:33] = _SPACE
_CLASS[ord("\n")] = _LINE
_CLASS[_MARKS] = np.arange(5, CLASSES)
MAKE_UP = CLASSES * CLASSES + 3
TERMS = MAKE_UP + WORDS


def terms(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of a text's terms; zeros for a text without any."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    c = _CLASS[np.frombuffer(text, np.uint8)]
    # Inside a run, and after a word's capital, nothing new begins.
    c = c[np.concatenate(([True], (c[1:] != c[:-1]) | (c[1:] >= 5)))]
    pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    h = words.hashes(text)
    repeated = int((h[1:] == h[:-1]).sum())
    new = len(np.unique(h))
    out[: MAKE_UP - 3] = pairs / max(1, pairs.sum())
    out[MAKE_UP - 3 : MAKE_UP] = np.array([repeated, len(h) - new, new]) / max(1, len(h))
    out[MAKE_UP:] = WORD_SHARE * np.bincount((h >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64), minlength=WORDS) / max(1, len(h))
    return np.sqrt(out)


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """By row the places of the ``k`` largest, of equal ones the first."""
    k = min(k, cos.shape[1])
    out = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cos, out, 1).min(1)
    for i in np.flatnonzero((cos >= least[:, None]).sum(1) > k):
        out[i] = np.argsort(-cos[i], kind="stable")[:k]
    return out


@dataclass
class Model:
    projection: np.ndarray  # TERMS x dimensions, idf within
    vectors: np.ndarray  # labelled rows of unit length
    labels: np.ndarray
    weights: np.ndarray  # how many labelled texts a row stands for

    def project(self, x: np.ndarray) -> np.ndarray:
        return unit_rows(x @ self.projection)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Votes for label 1 among the nearest labelled vectors of term rows ``x``."""
        if not len(self.labels):
            return np.zeros(len(x))
        # Rounded, as products of blocks of another size differ in the last digits: equal texts get equal scores.
        cos = np.round(self.project(x.astype(np.float64)) @ self.vectors.T, 9)
        near = np.sort(nearest(cos, K), axis=1)
        w = np.clip(np.take_along_axis(cos, near, 1), 0, None) ** SHARPNESS * self.weights[near]
        total = w.sum(1)
        votes = (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.where(x.any(1), np.clip(votes, 0, 1), 0.0)


def leading_vectors(a: np.ndarray, dimensions: int) -> np.ndarray:
    """About the leading right singular vectors of ``a``, as columns: range sketch, power steps, projection, exact SVD of the small rest."""
    y = a @ np.random.default_rng(20240612).standard_normal((a.shape[1], dimensions + OVERSAMPLE), np.float32)
    for _ in range(POWER):
        y = a @ (a.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    return np.linalg.svd(q.T @ a, full_matrices=False)[2][:dimensions].T


def learn(x: np.ndarray, labels: np.ndarray, totals: tuple[int, int] | None = None, dimensions: int = DIMENSIONS) -> Model:
    """A model from term rows and their labels; totals: how many texts of label 0 and 1 they stand for."""
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    projection = (idf[:, None] * leading_vectors(unit_rows(x * idf), dimensions)).astype(np.float64)
    sizes = [max(1, int((labels == c).sum())) for c in (0, 1)]
    weights = np.array([t / s for t, s in zip(totals or sizes, sizes, strict=True)])
    return Model(projection, unit_rows(x.astype(np.float64) @ projection), labels.astype(np.float64), weights[labels.astype(int)])


def _rows(column: pa.Array) -> np.ndarray:
    return np.stack([terms(t.as_py()) for t in column.cast(pa.binary())]) if len(column) else np.zeros((0, TERMS), np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [r.tobytes() for r in _rows(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    got = labelled_sample(docs, labels, "quality", per_class).select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x binary").toArrow()
    if not got.num_rows:
        return Model(np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), np.zeros(0))
    got = got.sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(got.num_rows, TERMS)
    totals = dict(labels.where(~held_out(F.col("doc_id").cast("long")) & F.col("quality").isin(0, 1)).groupBy(F.col("quality").cast("int")).count().collect())
    return learn(x, np.array(got.column("label").to_pylist()), (totals.get(0, 0), totals.get(1, 0)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.scores(_rows(part.column("text"))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
