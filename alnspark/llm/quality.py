"""Operator 8: quality classifier with supervised subword embeddings.

Words, repeats of the word before and character n-grams are hashed to vectors; a document is the mean of its vectors, a softmax layer
gives the classes; both are learned by stochastic gradient descent.  As everything after the lookup is linear up to the
softmax, the fitted vectors are folded to one number a bucket before scoring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled
from .common import pieces, spans, text_slices
from .hashing import code_points, finish, prefix_hash, substring, sums
from .transducer import SP, W, char_classes

GRAMS = (3, 4)
#: A longer text is taken apart into pieces of so many characters, cut at white space.
PIECE = 1 << 18
BLANK = re.compile(r"\s")
#: Labelled documents that the model is fitted on at most.
SAMPLE_ROWS = 2000
#: Few documents are gone through so often that there are so many steps.
LEAST_STEPS = 10_000


def features(texts: list[str], bits: int):
    """For words, then n-grams of each length: (bucket, end of each text among them)."""
    chars, ends = code_points(texts)
    kind = char_classes()[chars]
    blank = (kind == SP) | (kind == W)
    chars = np.where(blank, np.uint32(32), chars)
    h = prefix_hash(chars)
    shift = np.uint64(64 - bits)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # every text begins and ends blank: starts and stops in turn
    starts, stops = edge[::2], edge[1::2]
    word = finish(substring(h, starts, stops), 1)
    again = np.append(False, word[1:] == word[:-1])
    again[np.searchsorted(starts, ends[:-1])[np.searchsorted(starts, ends[:-1]) < len(starts)]] = False
    word = np.where(again, finish(np.uint64([0]), 2), word)  # a word said twice is one token, whichever it is: a bag can't see repetition otherwise
    yield (word >> shift).astype(np.int64), np.searchsorted(starts, ends)
    before = np.concatenate(([0], np.cumsum(blank)))
    for n in GRAMS:
        at = np.arange(max(0, len(chars) - n + 1))
        at = at[before[at + n - 1] == before[at + 1]]  # blanks only at its ends
        yield (finish(substring(h, at, at + n), n) >> shift).astype(np.int64), np.searchsorted(at, ends)


class QualityModel:
    """score(texts): the probability of class 1."""

    def __init__(self, bits: int = 18, dim: int = 8, epochs: int = 5, rate: float = 20.0, seed: int = 3):
        self.bits, self.dim, self.epochs, self.rate, self.seed = bits, dim, epochs, rate, seed
        self.weight, self.bias = np.zeros(1 << bits, np.float32), 0.0

    def fit(self, rows: list[tuple[str, int]]) -> QualityModel:
        """Without rows of both classes, every document gets the share of class 1 (a half without any row)."""
        y = np.array([r[1] for r in rows], np.int64)
        share = (y.sum() + 0.5) / (len(y) + 1)
        if not len(y) or y.min() == y.max():
            self.bias = float(np.log(share / (1 - share)))
            return self
        rng = np.random.default_rng(self.seed)
        vectors = rng.uniform(-1 / self.dim, 1 / self.dim, (1 << self.bits, self.dim)).astype(np.float32)
        out, bias = np.zeros((self.dim, 2), np.float32), np.log([1 - share, share])
        bags = []
        for text, _ in rows:
            counts = np.zeros(1 << self.bits, np.int32) if len(text) > PIECE else None
            if counts is None:
                bucket, n = np.unique(np.concatenate([b for b, _ in features([text], self.bits)]), return_counts=True)
            else:
                for a, b in pieces(text, PIECE, (BLANK,)):
                    for bucket, _ in features([text[a:b]], self.bits):
                        counts += np.bincount(bucket, minlength=1 << self.bits).astype(np.int32)
                bucket = np.flatnonzero(counts)
                n = counts[bucket]
            bags.append((bucket.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
        epochs = max(self.epochs, -(-LEAST_STEPS // len(rows)))
        steps = epochs * len(rows)
        step = 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                rate = self.rate * (1 - step / steps)
                step += 1
                bucket, share_of = bags[k]
                hidden = share_of @ vectors[bucket]
                logit = hidden @ out + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[y[k]] -= 1  # gradient of the loss by the logits
                vectors[bucket] -= np.float32(rate) * share_of[:, None] * (out @ p)
                out -= np.float32(rate * 0.05) * np.outer(hidden, p)
                bias -= rate * 0.001 * p
        self.weight = vectors @ (out[:, 1] - out[:, 0])
        self.bias = float(bias[1] - bias[0])
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        cut = [(k, t[a:b]) for k, t in enumerate(texts) for a, b in pieces(t, PIECE, (BLANK,))]
        for a, b in spans(cut, lambda x: len(x[1]), PIECE):
            of, some = zip(*cut[a:b], strict=True)
            of = np.array(of)
            for bucket, ends in features(list(some), self.bits):
                np.add.at(total, of, sums(self.weight[bucket], ends))
                np.add.at(n, of, np.diff(ends, prepend=0))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit) -> DataFrame:
    """One row a document: id, held_out, score, predicted (1 if score >= ``threshold``, else 0).

    Fitted on labelled.sample(); rows with crc32(id as text) mod 5 = 0 are never in it.  A null or blank text has no
    features and gets the score of the bias alone.  Ids may be null or repeated, each row is scored by its own text; without labels
    of both classes all rows get the same score.
    """
    rows = labelled.sample(docs, labels, label_col, SAMPLE_ROWS, id_col=id_col, text_col=text_col)
    model = QualityModel(**fit).fit(rows)

    def run(model: QualityModel, texts: list[str]) -> list[pa.Array]:
        score = model.score(texts)
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return labelled.score(docs, model, run, "score double, predicted int", ["score", "predicted"], id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit) -> DataFrame:
    """The rows of ``docs`` with all their columns that classify_quality() predicts as 1, in one pass without a join."""
    model = QualityModel(**fit).fit(labelled.sample(docs, labels, label_col, SAMPLE_ROWS, id_col=id_col, text_col=text_col))
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, at, labelled.BATCH_BYTES):
                yield part.filter(pa.array(held.value.score(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
