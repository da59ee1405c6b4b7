"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is logistic in its words (hashed); a document's is the noisy-or of its sentences' scores. Weights are
fitted to document labels only, by proximal gradient steps with an L1 shrinkage, so the labels are passed down to the sentences that explain
them, and those are then located.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import as_texts, fold, sample
from .labelled import fitted as fitted_to
from .shared import table
from .textops import LOWER, PLAIN, chunks, span_hashes, spans

WEIGHTS = 1 << 18
FIT_ROWS = 6000
FIT_CHARS = 200_000
THRESHOLD = 0.3
#: A sentence's logit without telling words, a parameter: fitted to balanced labels it rose, and called clean documents toxic.
BIAS = -10.0
PREFIXES = (4, 6)
#: The toxic share and the number of toxic documents that a telling word or beginning has at least.
TELLING = 0.5
MIN_DOCS = 3
OFFENDING = 0.5
#: Bytes of text that fitting works on at a time.
FIT_CHUNK = 1 << 18
#: Bytes from which one text is scored in pieces.
PIECE = 1 << 20
_IN_SENTENCE = np.ones(256, bool)
_IN_SENTENCE[[0x0A, 0x21, 0x2E, 0x3F]] = False  # line end ! . ?


def sentences(flat: np.ndarray, offsets: np.ndarray):
    """(feature rows of words, first feature of each sentence, document of each sentence, start and end byte of each sentence).

    Sentences without words are left out.
    """
    begin, end, _ = spans(flat, offsets, _IN_SENTENCE)
    low = LOWER[flat]
    starts, ends, docs = spans(low, offsets, PLAIN)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    # the word itself, and its first bytes if it is longer, as features side by side
    seen = [span_hashes(low, starts, ends)] + [span_hashes(low, starts, np.minimum(ends, starts + n)) + np.uint64(n) for n in PREFIXES]
    longer = [np.ones(len(starts), bool)] + [ends - starts > n for n in PREFIXES]
    longer = np.stack(longer, axis=1)
    rows = (np.stack(seen, axis=1)[longer] % np.uint64(WEIGHTS)).astype(np.int64)
    owner = np.repeat(np.searchsorted(begin, starts, "right") - 1, longer.sum(axis=1))
    docs = np.repeat(docs, longer.sum(axis=1))
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return rows, first, docs[first], begin[owner[first]], end[owner[first]]


def pieces(flat: np.ndarray):
    """(start, end) of stretches of PIECE bytes, each up to its last sentence end, or else its last word end; longer for a longer word."""
    at = 0
    while at < len(flat):
        to = min(at + PIECE, len(flat))
        if to < len(flat):
            for outside in (~_IN_SENTENCE, ~PLAIN):
                ends = np.flatnonzero(outside[flat[at:to]])
                if len(ends):
                    to = at + int(ends[-1]) + 1
                    break
            else:
                while to < len(flat) and PLAIN[flat[to]]:
                    more = np.flatnonzero(~PLAIN[flat[to : to + PIECE]])
                    to = to + int(more[0]) if len(more) else min(to + PIECE, len(flat))
        yield at, to
        at = to


class ToxicityModel:
    """Weights of hashed words; without toxic labels every score is 0.

    Words take part if toxic documents hold them more often than chance allows (a count ``sure`` standard deviations above
    what the toxic share of documents would give, MIN_DOCS of them, and a share of TELLING among those with the word). Their weights are fitted by proximal gradient
    steps, scaled by each word's weighted document count; BIAS keeps documents of many sentences clean.
    """

    def __init__(self, texts: list[str], labels: list[int], rounds: int = 300, rate: float = 2.0, shrink: float = 1e-4, sure: float = 4.0):
        y = np.array(labels, float)
        self.weights, self.bias = np.zeros(WEIGHTS, np.float32), BIAS
        if not 0 < y.sum() < len(y):
            return
        texts = as_texts(texts)
        n = len(y)
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
        # features are made twice, a chunk at a time: once to choose words, once for the places of the chosen ones
        toxic, all_, weighted = np.zeros(WEIGHTS), np.zeros(WEIGHTS), np.zeros(WEIGHTS)
        for a, _, flat, offsets in chunks(texts, FIT_CHUNK):
            rows, first, doc, _, _ = sentences(flat, offsets)
            pairs = np.unique(np.repeat(doc + a, np.diff(np.append(first, len(rows)))) * WEIGHTS + rows)
            d, r = pairs // WEIGHTS, pairs % WEIGHTS
            for total, value in ((toxic, y[d]), (all_, 1), (weighted, weight[d])):
                np.add.at(total, r, value)
        chance = all_ * y.mean()
        chosen = (toxic >= TELLING * all_) & (toxic >= MIN_DOCS) & (toxic - chance >= sure * np.sqrt(chance * (1 - y.mean())))
        if not chosen.any():
            return
        weighted, place = weighted[chosen], np.cumsum(chosen) - 1
        owner, local, docs, before = [], [], [], 0
        for a, _, flat, offsets in chunks(texts, FIT_CHUNK):
            rows, first, doc, _, _ = sentences(flat, offsets)
            keep = chosen[rows]
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))[keep]
            # a word once per sentence
            pairs = np.unique(of * WEIGHTS + rows[keep])
            owner.append(pairs // WEIGHTS + before)
            local.append(place[pairs % WEIGHTS])
            docs.append(doc + a)
            before += len(first)
        owner, local, doc = map(np.concatenate, (owner, local, docs))
        w = np.zeros(int(chosen.sum()))
        for _ in range(rounds):
            z = self.bias + np.bincount(owner, w[local], before)
            total = np.bincount(doc, np.logaddexp(0, z), n)
            # d(loss)/d(total): 1 for clean documents, -(1 - p) / p for toxic ones
            outer = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 500)), 1e-12), 1.0) * weight
            dz = outer[doc] / (1 + np.exp(-z))
            step = rate / weighted
            w = w - step * np.bincount(local, dz[owner], len(w))
            w = np.sign(w) * np.maximum(np.abs(w) - shrink * step, 0)
        self.weights[chosen] = w

    def _sums(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[rows].astype(float), first) if len(first) else np.zeros(0)

    def _long(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of weights, starts and ends of the sentences of one long text, read in pieces that cut no word."""
        z, begin, end = [], [], []
        start, held, words = -1, 0.0, False  # of a sentence that goes on from the piece before

        for at, to in pieces(flat):
            part = flat[at:to]
            rows, first, _, b, e = sentences(part, np.array([0, len(part)]))
            s = self._sums(rows, first)
            stops = np.flatnonzero(~_IN_SENTENCE[part])
            if start >= 0:
                if len(b) and b[0] == 0:
                    held, words = held + s[0], True
                    s, b, e = s[1:], b[1:], e[1:]
                if len(stops):
                    if words:
                        z.append([held]), begin.append([start]), end.append([at + stops[0]])
                    start = -1
            if start < 0 and to < len(flat) and (not len(stops) or stops[-1] < len(part) - 1):
                last = int(stops[-1]) + 1 if len(stops) else 0
                start, words = at + last, bool(len(b) and b[-1] == last)
                held = s[-1] if words else 0.0
                if words:
                    s, b, e = s[:-1], b[:-1], e[:-1]
            z.append(s), begin.append(b + at), end.append(e + at)
        if start >= 0 and words:
            z.append([held]), begin.append([start]), end.append([len(flat)])
        return np.concatenate(z), np.concatenate(begin).astype(np.int64), np.concatenate(end).astype(np.int64)

    def scores(self, flat: np.ndarray, offsets: np.ndarray):
        """(document scores, sentence scores, documents, starts and ends of sentences)."""
        n = len(offsets) - 1
        if n == 1 and len(flat) > PIECE:
            z, begin, end = self._long(flat)
            docs = np.zeros(len(z), np.int64)
        else:
            rows, first, docs, begin, end = sentences(flat, offsets)
            z = self._sums(rows, first)
        if not len(z):
            return np.zeros(n), np.zeros(0), docs, begin, end
        z = self.bias + z
        total = np.bincount(docs, np.logaddexp(0, z), n)
        return -np.expm1(-total), 1 / (1 + np.exp(-np.clip(z, -500, 500))), docs, begin, end


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> ToxicityModel:
    """A model of labels.toxic from rows outside the held-out fold (crc32 of the id modulo 4 is not 2)."""
    return fitted_to(sample(docs, labels, "toxic", fold(F.col("doc_id"), 4) != 2, rows, chars), ToxicityModel)


def scored(docs: DataFrame, model: ToxicityModel, column: str = "score", where: str = "offending") -> DataFrame:
    """``docs`` with its score (0 to 1) and the byte ranges of its offending sentences.

    Null and empty texts score 0 and have no ranges. Repeated rows and null ids are kept. Columns of the added names are
    replaced. No rows in: no rows out. Texts are read whole.
    """
    docs = docs.drop(column, where)
    kind = "array<struct<start: long, end: long, score: double>>"
    schema = docs.withColumn(column, F.lit(0.0)).withColumn(where, F.array().cast(kind)).schema
    at = docs.columns.index("text")

    def add(batches):
        for batch in batches:
            scores, ranges = [], []
            for _, _, flat, offsets in chunks(batch.column(at)):
                total, each, owner, begin, end = model.scores(flat, offsets)
                hit = np.flatnonzero(each >= OFFENDING)
                owner = owner[hit]
                fields = [pa.array(begin[hit] - offsets[owner]), pa.array(end[hit] - offsets[owner]), pa.array(each[hit])]
                ranges.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(total) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "score"])))
                scores.append(total)
            if scores:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64()), pa.concat_arrays(ranges)], [*batch.schema.names, column, where])

    return docs.mapInArrow(add, schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"), F.get("offending", F.lit(0))["start"].alias("first_start"), F.get("offending", F.lit(0))["end"].alias("first_end"))
