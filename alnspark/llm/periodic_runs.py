"""Operator 11: all runs (maximal periodicities) of the words of each text.

By the runs theorem every run contains the longest Lyndon word at one of its places, under one of the two orders of the words, and that word is
as long as the period.  The longest Lyndon word at i ends before the next smaller value of the inverse suffix array, under
the reverse order before the next greater one.  Each is extended to both sides by longest common prefixes, read from the LCP array by
range minima: forwards in the words, backwards in the words reversed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .suffix_array import Suffixes, next_smaller

#: Bytes of text treated at once; a longer text is treated alone.
BATCH_BYTES = 1 << 19
RUN = "struct<start: long, length: long, period: long>"


def number(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, with a number of its own before each text and after the last; where each text begins."""
    first = len(texts) + 1
    ids = defaultdict(count(first).__next__)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes
    out = np.zeros(int(sizes.sum()) + first, np.int64)
    out[begins - 1] = np.arange(len(texts))
    out[-1] = len(texts)
    for words, at in zip(texts, begins.tolist(), strict=True):
        out[at : at + len(words)] = [*map(ids.__getitem__, words)]
    return out, begins


def find_runs(items: np.ndarray, least_exponent: int, least_length: int) -> np.ndarray:
    """(start, length, period) of the runs in ``items``, whose last number is found nowhere else, by start and period.

    A run of exponent m >= 2 holds its Lyndon root first within one period, so at least (m - 2) periods and one
    item follow that root's first copy in step: others needn't be extended backwards.
    """
    n = len(items)
    forward = Suffixes(items)
    rank = forward.rank.tolist()
    places = np.arange(n)
    found = []
    for stop in (next_smaller(rank, -1), next_smaller([-r for r in rank], -n - 1)):
        stop = np.array(stop)
        i = places[stop < n]
        i = i[items[i] == items[stop[i]]]
        j = stop[i]
        after = forward.extension(i, j)
        enough = after > (least_exponent - 2) * (j - i)
        found.append(np.stack([i[enough], j[enough], after[enough]]))
    i, j, after = np.concatenate(found, axis=1)
    if not len(i):
        return np.zeros((0, 3), np.int64)
    # Reversed, place x is n - 1 - x; a number found nowhere else has to end that sequence too.
    backward = Suffixes(np.append(items[::-1], items.max() + 1))
    before = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    before[inner] = backward.extension(n - i[inner], n - j[inner])
    runs = np.stack([i - before, before + (j - i) + after, j - i], axis=1)
    runs = runs[(runs[:, 1] >= least_exponent * runs[:, 2]) & (runs[:, 1] >= least_length)]
    return np.unique(runs, axis=0)


def runs_of(texts: list[list[bytes]], least_exponent: int = 2, least_length: int = 2) -> list[np.ndarray]:
    """(start, length, period) rows for each text, by start and then period."""
    items, begins = number(texts)
    runs = find_runs(items, least_exponent, least_length)
    if len(runs) == 0:
        return [runs] * len(texts)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs[:, 0] -= begins[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    covered = np.cumsum(edge)[:-1] > 0
    return b" ".join(w for w, gone in zip(words, covered.tolist(), strict=True) if not gone)


def most_periodic(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest exact exponent; ties: smallest start, then period."""
    return max(map(tuple, runs.tolist()), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def periodic_runs(docs: DataFrame, least_exponent: int = 2, least_length: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, runs (start, length, period in words, by start and period), best (the run of the greatest
    exponent; ties: smallest start, then period), n_words, collapsed (words that no run holds after its first period, joined by one space).

    A word is a run of characters other than ASCII white space.  A run is a stretch of words of smallest period q that no neighbour
    extends, at least ``least_exponent`` (an integer from 2) periods and ``least_length`` words long.  A null, empty or blank text has no words
    and no runs, null as best and an empty collapsed text.  Repeated rows and null ids are rows like others; other columns don't matter.
    Rows are independent: a batch of texts is treated at once, a long text alone, with memory in proportion to its words.
    """
    if least_exponent < 2:
        raise ValueError("a run has an exponent of at least 2")
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").cast("binary").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 1, BATCH_BYTES):
                words = [(t or b"").split() for t in texts]
                runs = runs_of(words, least_exponent, least_length)
                flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
                columns = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(fields))
                offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32))
                best = [b and dict(zip(("start", "length", "period"), b, strict=True)) for b in map(most_periodic, runs)]
                arrays = [part.column(0), pa.ListArray.from_arrays(offsets, columns), pa.array(best, fields), pa.array([len(w) for w in words], pa.int64())]
                arrays.append(pa.array([collapse(w, r).decode("utf-8", "replace") for w, r in zip(words, runs, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "runs", "best", "n_words", "collapsed"])

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, runs array<{RUN}>, best {RUN}, n_words long, collapsed string")


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, in which a tenth of the documents repeat a stretch of words to the end.

    With h the crc32 of the id as text and g = h div 10: where h % 10 = 0 and there are n > 0 words, word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(docs[id_col].cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(docs[text_col], r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(words).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice(words, a + 1, p)
    rest = (n - a).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(docs[text_col])
