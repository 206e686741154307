"""Operator 2: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence with a telling word is toxic with the probability of a logistic model on its hashed
words; a document is toxic if any sentence is, or by a small chance of its own (noisy-or with a leak), so clean text stays
clean at any length.  Only documents have labels; the fitted model then tells the offending sentences apart.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled
from .common import pieces, spans
from .hashing import code_points, finish, lower_table, prefix_hash, substring
from .transducer import AP, O, SP, W, char_classes

#: The characters that end a sentence.
SENTENCE_ENDS = ".!?\n。！？"
#: A longer text is taken apart into pieces of so many characters, cut after a sentence or else after white space.
PIECE = 1 << 18
ENDS = (re.compile(f"[{re.escape(SENTENCE_ENDS)}]"), re.compile(r"\s"))
#: A word also counts by its beginnings of these lengths.
STEMS = (4, 5)


def words(texts: list[str], bits: int):
    """Bucket of each word and word beginning, its sentence, the text of each sentence and its [start, stop) in the text.

    A word is a run of letters, numbers and apostrophes in lower case; every text has at least one sentence.
    """
    chars, ends = code_points(texts)
    ends_one = np.isin(chars, [ord(c) for c in SENTENCE_ENDS])
    kind = char_classes()[chars]
    inside = (kind != O) & (kind != SP) & (kind != W)
    inside |= kind == AP
    h = prefix_hash(lower_table()[chars])
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, stops = edge[::2], edge[1::2]
    buckets, sizes = [finish(substring(h, starts, stops), 1)], stops - starts
    owner = [np.arange(len(starts))]
    for n in STEMS:
        longer = np.flatnonzero(sizes > n)
        buckets.append(finish(substring(h, starts[longer], starts[longer] + n), n))
        owner.append(longer)
    bucket = (np.concatenate(buckets) >> np.uint64(64 - bits)).astype(np.int64)
    starts = starts[np.concatenate(owner)]
    begins = np.unique(np.concatenate((np.concatenate(([0], ends[:-1])), np.flatnonzero(ends_one) + 1)))
    begins = begins[begins < len(chars)]
    text_of = np.searchsorted(ends, begins, side="right")
    offset = np.concatenate(([0], ends[:-1]))[text_of] + 1  # after the space that stands before the text
    stop = np.append(begins[1:], len(chars))
    length = np.diff(ends, prepend=0)[text_of] - 2
    return bucket, np.searchsorted(begins, starts, side="right") - 1, text_of, np.clip(begins - offset, 0, length), np.clip(stop - offset, 0, length)


def noisy_or(p: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """1 - product(1 - p) over the sentences of each text."""
    return -np.expm1(np.bincount(text_of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


class ToxicityModel:
    def __init__(self, bits: int = 20, least_ratio: float = 7.88, steps: int = 120, rate: float = 0.2, penalty: float = 1e-5):
        self.bits, self.least_ratio, self.steps, self.rate, self.penalty = bits, least_ratio, steps, rate, penalty
        self.weight, self.bias, self.leak = np.zeros(1 << bits, np.float32), -5.0, -6.0

    def fit(self, rows: list[tuple[str, int]]) -> ToxicityModel:
        """Full-batch Adam on the noisy-or likelihood.  A word that telling() leaves out has weight 0."""
        y = np.array([r[1] for r in rows], np.int64)
        if not len(y) or y.min() == y.max():
            self.leak = -6.0 if not len(y) or not y.max() else 0.0
            return self
        at, of, texts, base = [], [], [], 0
        cut = [(k, r[0][a:b]) for k, r in enumerate(rows) for a, b in pieces(r[0], PIECE, ENDS)]
        for a, b in spans(cut, lambda x: len(x[1]), PIECE):
            owner, some = zip(*cut[a:b], strict=True)
            bucket, sentence, text_of, _, _ = words(list(some), self.bits)
            at.append(bucket)
            of.append(sentence + base)
            texts.append(np.array(owner)[text_of])
            base += len(text_of)
        docs = len(rows)
        at, of, texts = map(np.concatenate, (at, of, texts))
        pair = np.unique(texts[of].astype(np.int64) << self.bits | at)
        keep = self.telling(pair >> self.bits, pair & ((1 << self.bits) - 1), y)[at]
        used, at = np.unique(at[keep], return_inverse=True)
        of = of[keep]
        pair = np.unique(of.astype(np.int64) * len(used) + at)  # a word counts once a sentence
        of, at = pair // len(used), pair % len(used)
        some, of = np.unique(of, return_inverse=True)  # a sentence without a telling word can't be toxic
        n = len(some)
        texts = np.concatenate((texts[some], np.arange(docs)))  # then the leak of each document
        theta = np.zeros(len(used) + 2)
        theta[-2:] = self.bias, self.leak
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, self.steps + 1):
            logit = np.append(np.bincount(of, weights=theta[at], minlength=n) + theta[-2], np.full(docs, theta[-1]))
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            whole = np.clip(noisy_or(p, texts, docs), 1e-9, 1 - 1e-12)
            pull = np.where(y == 1, (1 - whole) / whole, -1.0)[texts] * p
            gradient = np.append(np.bincount(at, weights=pull[of], minlength=len(used)), (pull[:n].sum(), pull[n:].sum())) / docs
            gradient[:-2] -= self.penalty * theta[:-2]
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta += self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weight[used], self.bias, self.leak = theta[:-2], float(theta[-2]), float(theta[-1])
        return self

    def telling(self, text: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Buckets seen more often in labelled documents than chance allows: by the likelihood ratio of their document counts."""
        with_it = np.bincount(bucket, minlength=1 << self.bits).astype(float)
        toxic = np.bincount(bucket, weights=y[text], minlength=1 << self.bits)
        share = y.mean()
        part = lambda n, expected: np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
        ratio = 2 * (part(toxic, with_it * share) + part(with_it - toxic, with_it * (1 - share)))
        return (ratio >= self.least_ratio) & (toxic > with_it * share)

    def sentences(self, texts: list[str]):
        """Probability, text, start and stop of every sentence."""
        cut = [(k, x, t[x:y]) for k, t in enumerate(texts) for x, y in pieces(t, PIECE, ENDS)]
        out = []
        for a, b in spans(cut, lambda x: len(x[2]), PIECE):
            of, at, some = zip(*cut[a:b], strict=True)
            bucket, sentence, text_of, start, stop = words(list(some), self.bits)
            hit = np.flatnonzero(self.weight[bucket])
            pair = np.unique(sentence[hit].astype(np.int64) << self.bits | bucket[hit])
            telling, place = np.unique(pair >> self.bits, return_inverse=True)
            logit = np.bincount(place, weights=self.weight[pair & ((1 << self.bits) - 1)], minlength=len(telling)) + self.bias
            p = np.zeros(len(text_of))
            p[telling] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            offset = np.array(at)[text_of]
            out.append((p, np.array(of)[text_of], start + offset, stop + offset))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0), *(np.zeros(0, np.int64) for _ in range(3)))

    def documents(self, p: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
        """Probability of each text from those of its sentences."""
        leak = 1 / (1 + np.exp(-self.leak))
        return noisy_or(np.append(p, np.full(n, leak)), np.append(text_of, np.arange(n)), n)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **fit) -> DataFrame:
    """One row a document: id, held_out, score, predicted (1 if score >= ``threshold``) and offending, the
    sentences with at least that probability as (start, stop, score), offsets counted in code points.

    Fitted on labelled.sample(); rows with crc32(id as text) mod 5 = 0 are never in it.  A null or empty text is one empty
    sentence and has the score of the leak.  Repeated and null ids are scored row by row; without labels of both classes
    every text has the same score.
    """
    rows = labelled.sample(docs, labels, label_col, id_col=id_col, text_col=text_col)
    model = ToxicityModel(**fit).fit(rows)
    item = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])

    def run(model: ToxicityModel, texts: list[str]) -> list[pa.Array]:
        p, text_of, start, stop = model.sentences(texts)
        score = model.documents(p, text_of, len(texts))
        bad = np.flatnonzero(p >= threshold)
        found = pa.StructArray.from_arrays([pa.array(start[bad]), pa.array(stop[bad]), pa.array(p[bad])], fields=list(item))
        offsets = np.concatenate(([0], np.cumsum(np.bincount(text_of[bad], minlength=len(texts)))))
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)]

    return labelled.score(docs, model, run, "score double, predicted int, offending array<struct<start:bigint,stop:bigint,score:double>>", ["score", "predicted", "offending"], id_col, text_col)
