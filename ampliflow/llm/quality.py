"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network.

Every word (and its shape, and whether it repeats the word before) falls into one of ROWS hashed rows. A row has a
sparse random index vector; a row's word vector is that plus the normalised sum of the index vectors of its
neighbours in the fitting sample. A document is the mean of its words' vectors, the mean of its shapes' vectors and its
log length. A tanh layer and a logistic unit are fitted by Adam in numpy; a temperature fitted on
rows kept apart calibrates the probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import as_texts, fold, sample
from .labelled import fitted as fitted_to
from .shared import table
from .textops import LOWER, SPACED, chunks, mixed, span_hashes, spans

ROWS = 1 << 14
DIMENSIONS = 64
NONZERO = 6
REACH = 2
HIDDEN = 16
#: Most labelled documents that a model is fitted on, and most characters of each.
FIT_ROWS = 4000
FIT_CHARS = 200_000
THRESHOLD = 0.3
#: Bytes of text that fitting works on at a time.
FIT_CHUNK = 1 << 18
#: Words whose vectors are gathered at a time; one stretch of a document may have more.
GATHER = 1 << 14

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 3


def index_vectors() -> np.ndarray:
    rows = np.arange(ROWS, dtype=np.uint64)
    out = np.zeros((ROWS, DIMENSIONS), np.float32)
    for j in range(NONZERO):
        h = mixed(rows * np.uint64(NONZERO) + np.uint64(j + 1))
        out[np.arange(ROWS), (h >> np.uint64(1)) % np.uint64(DIMENSIONS)] += np.where(h & np.uint64(1), 1.0, -1.0)
    return out


def rows_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word between white space: hashed row of the word, hashed row of its shape, document."""
    starts, ends, docs = spans(flat, offsets, SPACED)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    words = span_hashes(LOWER[flat], starts, ends)
    # a shape: the classes of its characters with runs collapsed
    kinds = _CLASS[flat]
    change = np.ones(len(flat), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[starts] = True
    change &= SPACED[flat]
    before = np.concatenate(([0], np.cumsum(change, dtype=np.int32)))
    shapes = span_hashes(kinds[change], before[starts], before[ends])
    again = np.zeros(len(words), np.uint64)
    again[1:] = (words[1:] == words[:-1]) & (docs[1:] == docs[:-1])
    size = np.uint64(ROWS)
    return (words % size).astype(np.int64), (mixed(shapes + again) % size).astype(np.int64), docs


def context_vectors(texts: list[str]) -> np.ndarray:
    """Word vectors of all rows from the neighbours in these texts."""
    index = index_vectors()
    total = np.zeros_like(index)
    for _, _, flat, offsets in chunks(as_texts(texts), FIT_CHUNK):
        words, shapes, docs = rows_of(flat, offsets)
        for step in range(1, REACH + 1):
            near = docs[step:] == docs[:-step]
            for rows in (words, shapes):
                a, b = rows[:-step][near], rows[step:][near]
                for at, other in ((a, b), (b, a)):
                    order = np.argsort(at, kind="stable")
                    at, other = at[order], other[order]
                    if len(at):
                        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                        total[at[first]] += np.add.reduceat(index[other], first)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    own = np.linalg.norm(index, axis=1, keepdims=True)
    return index / np.maximum(own, 1e-9) + total / np.maximum(norm, 1e-9)


def pooled(flat: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of features per document; zeros for one without words."""
    words, shapes, docs = rows_of(flat, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, 2 * DIMENSIONS + 1), np.float32)
    if not len(docs):
        return out
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    counts = np.bincount(docs, minlength=n)
    here = docs[first]
    for k, rows in enumerate((words, shapes)):
        # a long document is summed in stretches, which bounds the gathered vectors
        cuts = np.unique(np.concatenate((first, np.arange(0, len(rows), 1 << 15))))
        owner = docs[cuts]
        a = 0
        while a < len(cuts):
            b = len(cuts) if len(rows) - cuts[a] <= GATHER else max(a + 1, int(np.searchsorted(cuts, cuts[a] + GATHER, "right")) - 1)
            begin, end = cuts[a], cuts[b] if b < len(cuts) else len(rows)
            np.add.at(out[:, k * DIMENSIONS : (k + 1) * DIMENSIONS], owner[a:b], np.add.reduceat(vectors[rows[begin:end]], cuts[a:b] - begin))
            a = b
    out[here, : 2 * DIMENSIONS] /= counts[here, None]
    out[:, -1] = np.log1p(counts) / 10
    return out


class Network:
    """A tanh layer and a logistic unit; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        apart = rng.random(len(y)) < 0.2
        fit, rest = np.flatnonzero(~apart), np.flatnonzero(apart)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            rng.shuffle(fit)
            for a in range(0, len(fit), 128):
                rows = fit[a : a + 128]
                h = np.tanh(x[rows] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
                dh = np.outer(d, p[2]) * (1 - h * h)
                grads = [x[rows].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(rest) and 0 < y[rest].sum() < len(rest):
            z = self._logits(x[rest])
            loss = lambda s: np.logaddexp(0, np.where(y[rest] == 1, -z, z) / s).mean()
            self.temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -500, 500)))


class QualityModel:
    """Scores of texts; with labels of one kind only, that kind's share is the score of every text."""

    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, float)
        self.vectors, self.network = context_vectors(texts), None
        self.share = float((y.sum() + 1) / (len(y) + 2))
        if 0 < y.sum() < len(y):
            x = np.concatenate([pooled(flat, offsets, self.vectors) for _, _, flat, offsets in chunks(as_texts(texts), FIT_CHUNK)])
            self.network = Network(x, y)

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.share)
        return self.network.probabilities(pooled(flat, offsets, self.vectors))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> QualityModel:
    """A model of labels.quality from rows outside the held-out fold (crc32 of the id modulo 5 is not 0)."""
    return fitted_to(sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, rows, chars), QualityModel)


def scored(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """``docs`` with a score of its whole text, 0 to 1, in ``column``, which replaces one of that name.

    Null and empty texts are documents without words and get the score that the network gives them. Repeated rows and
    null ids are kept. No rows in: no rows out. A text of any length is read whole, in bounded stretches.
    """
    docs = docs.drop(column)
    schema = docs.withColumn(column, F.lit(0.0)).schema
    at = docs.columns.index("text")

    def add(batches):
        for batch in batches:
            parts = [model.scores(flat, offsets) for _, _, flat, offsets in chunks(batch.column(at))]
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts), pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(add, schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
