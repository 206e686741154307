"""Suffix arrays in numpy: prefix doubling over numbered words, two-stage sorting over bytes, and common prefixes."""

from __future__ import annotations

import numpy as np


class Suffixes:
    """Suffix array, inverse and LCP array of a sequence of small numbers that ends with a number found nowhere else.

    ``lcp[r]`` belongs to the suffixes of ranks r - 1 and r.  Memory: some ten numbers an item, and one more for each doubling of
    the longest repeat.
    """

    def __init__(self, items: np.ndarray):
        n = len(items)
        counts = np.bincount(items)
        rank = (np.cumsum(counts) - counts)[items]  # where the group of equal ones begins
        self.levels = [rank]
        order, width = np.argsort(items, kind="stable"), 1
        open_ = order[counts[items[order]] > 1]
        while len(open_):
            key = rank[open_] * np.int64(n + 1) + rank[open_ + width]
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            group = rank[open_]
            at = np.arange(len(open_))
            new_group = np.r_[True, group[1:] != group[:-1]]
            new_key = np.r_[True, key[1:] != key[:-1]]
            begin = np.maximum.accumulate(np.where(new_group, at, 0))
            rank = rank.copy()
            rank[open_] = group + np.maximum.accumulate(np.where(new_key, at, 0)) - begin
            self.levels.append(rank)
            single = new_key & np.r_[new_key[1:], True]
            open_, width = open_[~single], 2 * width
        self.rank = rank
        self.array = np.empty(n, np.int64)
        self.array[rank] = np.arange(n)
        self.lcp = np.zeros(n, np.int64)
        self.lcp[1:] = self._common(self.array[:-1], self.array[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):  # ranks of the last are all distinct
            step = (self.levels[k][a] == self.levels[k][b]) * np.int64(1 << k)
            out += step
            a += step
            b += step
        return out

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b (a <> b): least LCP between their ranks.

        The sparse table is made level by level and each range is answered at its own level, so one level is held at a time.
        """
        x, y = self.rank[a], self.rank[b]
        first, last = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out, least = np.zeros(len(first), np.int64), self.lcp
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                half = 1 << (k - 1)
                least = np.minimum(least[:-half], least[half:])
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(least[first[at]], least[last[at] - (1 << k) + 1])
        return out


def next_smaller(values: list[int], end: int) -> list[int]:
    """For each place the next one with a smaller value; ``end`` is smaller than all and stands after the last."""
    n = len(values)
    values, out = [*values, end], [n] * n
    for i in range(n - 1, -1, -1):
        v, j = values[i], i + 1
        while values[j] > v:
            j = out[j]
        out[i] = j
    return out


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number, zeros after the end."""
    out = np.zeros(len(text) + 7, np.uint64)
    out[: len(text)] = text
    for shift in (1, 2, 4):
        tail = np.zeros_like(out)
        tail[:-shift] = out[shift:]
        out = (out << np.uint64(8 * shift)) | tail
    return out[: len(text)]


def two_stage(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (bytes) sorted by their first ``depth`` bytes, in two stages.

    Only the suffixes that are smaller than their successors are compared, eight bytes at a time and only within what is tied so
    far.  The others follow by a scan over the buckets of first bytes in ascending order: within a bucket they stand before the
    sorted ones, in the order in which the suffixes after them are met; those of a run of one byte are met run length by run length.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = words_of(text) if words is None else words
    differs = np.flatnonzero(text[1:] != text[:-1])
    at = np.searchsorted(differs, np.arange(n))  # the next place that differs from its successor
    decided = np.append(differs, n - 1)[at]
    larger = np.ones(n, bool)  # than the successor; the last one is larger than the empty suffix
    inner = decided < n - 1
    larger[inner] = text[decided[inner]] > text[decided[inner] + 1]

    low = np.flatnonzero(~larger)
    low = low[np.argsort(words[low], kind="stable")]
    key, tied = words[low], np.zeros(0, np.int64)
    if len(low):
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new)
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        group = group[tied]
    for offset in range(8, depth, 8):
        if not len(tied):
            break
        where = low[tied] + offset
        key = np.where(where < n, words[np.minimum(where, n - 1)], np.uint64(0))
        same = np.r_[True, group[1:] == group[:-1]]
        mixed = np.flatnonzero(same & np.r_[False, key[1:] != key[:-1]])
        if len(mixed):  # order only the groups whose members differ here
            torn = np.isin(group, group[mixed])
            some = np.flatnonzero(torn)
            by = some[np.lexsort((key[some], group[some]))]
            low[tied[some]] = low[tied[by]]
            key[some] = key[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        group = np.cumsum(new)
        still = ~(new & np.r_[new[1:], True])
        tied, group = tied[still], group[still]

    bounds = np.searchsorted(text[low], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        bucket = waiting[c]
        level = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        bucket = [level]
        while len(level):
            level = level[level > 0] - 1
            level = level[text[level] == c]
            bucket.append(level)
        full = np.concatenate([*bucket, low[bounds[c] : bounds[c + 1]]])
        waiting[c] = []
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(first)) if len(first) else [], strict=True):
            waiting[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, suffixes: np.ndarray, limit: int) -> np.ndarray:
    """Bytes, at most ``limit``, that each of ``suffixes`` shares with the one before it (0 for the first); zeros stand after the end."""
    n = len(words)
    out = np.zeros(len(suffixes), np.int64)
    open_ = np.arange(1, len(suffixes))
    for offset in range(0, limit, 8):
        if not len(open_):
            break
        a, b = suffixes[open_ - 1] + offset, suffixes[open_] + offset
        x = np.where(a < n, words[np.minimum(a, n - 1)], np.uint64(0)) ^ np.where(b < n, words[np.minimum(b, n - 1)], np.uint64(0))
        equal = np.full(len(x), 8)
        for byte in range(8):
            equal[(equal == 8) & (x >> np.uint64(56 - 8 * byte) != 0)] = byte
        out[open_] += equal
        open_ = open_[equal == 8]
    return np.minimum(out, limit)
