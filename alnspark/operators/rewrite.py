"""Rewriting of CIGARs from one sequence of a multiple alignment to another, for all alignments of a chunk at once, in numpy.

Operations are codes in the order of CODES; a CIGAR list is three arrays: owner (number of the alignment, ascending), n, op.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .align import DELETE, EQUAL, INSERT, MISMATCH, Scores, align_many

CODES = "=XIDMNSHP"
MATCH, SKIP, SOFT, HARD, PAD = range(4, 9)
ON_REF = np.isin(np.arange(9), [EQUAL, MISMATCH, DELETE, MATCH, SKIP])
ON_READ = np.isin(np.arange(9), [EQUAL, MISMATCH, INSERT, MATCH, SOFT])
CODE_OF = np.full(256, -1)
CODE_OF[np.frombuffer(CODES.encode(), np.uint8)] = np.arange(9)


class Ops(NamedTuple):
    owner: np.ndarray
    n: np.ndarray
    op: np.ndarray


def merge(ops: Ops) -> Ops:
    """Without empty items, neighbours of one operation joined."""
    owner, n, op = (x[ops.n > 0] for x in ops)
    if not len(n):
        return Ops(owner, n, op)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (op[1:] != op[:-1])]
    return Ops(owner[new], np.add.reduceat(n, np.flatnonzero(new)), op[new])


def within(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sum of the values before each one of the same owner."""
    total = np.cumsum(values) - values
    new = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
    return total - np.repeat(total[new], np.diff(np.append(np.flatnonzero(new), len(owner))))


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` repeated items the item's number and its place in the repeat."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


class Chunk:
    """Source positions cut to pieces that lie whole in a block of the target or whole in a gap of it.

    ``src`` and ``dst`` are blocks (seq_start, aln_start, len) in order, ``before`` the target's bases before the first column,
    ``bases`` the target from ``base_start``.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, before: int, bases: bytes, base_start: int):
        cuts = np.unique(np.concatenate([src[:, 1], src[:, 1] + src[:, 2], dst[:, 1], dst[:, 1] + dst[:, 2]]))
        k = np.searchsorted(src[:, 1], cuts, "right") - 1
        inside = (k >= 0) & (cuts < src[k, 1] + src[k, 2])
        column, k = cuts[inside], k[inside]
        self.start = src[k, 0] + column - src[k, 1]
        self.stop = np.append(cuts, cuts[-1])[1:][inside] - src[k, 1] + src[k, 0]
        d = np.searchsorted(dst[:, 1], column, "right") - 1
        self.rank, self.gap = np.full(len(column), before), np.ones(len(column), bool)
        has = d >= 0
        offset, size = column[has] - dst[d[has], 1], dst[d[has], 2]
        self.rank[has], self.gap[has] = dst[d[has], 0] + np.minimum(offset, size), offset >= size
        self.bases, self.base_start = np.frombuffer(bases, np.uint8), base_start

    def piece(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, pos, "right") - 1

    def place(self, pos: np.ndarray) -> np.ndarray:
        """Bases of the target before the columns of source positions."""
        k = self.piece(pos)
        return self.rank[k] + np.where(self.gap[k], 0, pos - self.start[k])


def rewrite(ops: Ops, starts: np.ndarray, reads: np.ndarray, read_at: np.ndarray, chunk: Chunk) -> tuple[np.ndarray, Ops]:
    """Positions on the target and CIGARs there of alignments at source positions ``starts``, before indels are aligned anew.

    ``reads`` are the bases of all reads joined, ``read_at`` where each begins.  Items on the source are cut where a piece of the chunk ends.  What the
    target has between two parts is deleted; a part in a target gap makes the read's bases insertions and deleted
    ones nothing; else bases are compared, all at once.
    """
    owner, n, op = ops
    at = starts[owner] + within(n * ON_REF[op], owner)
    q = read_at[owner] + within(n * ON_READ[op], owner)
    on = ON_REF[op]
    first = np.where(on, chunk.piece(at), 0)
    last = np.where(on, chunk.piece(at + n - 1), 0)
    item, k = expand(np.where(n > 0, last - first + 1, 0))
    on, op, owner = on[item], op[item], owner[item]
    piece = first[item] + k
    lo = np.maximum(at[item], chunk.start[piece])
    size = np.where(on, np.minimum((at + n)[item], chunk.stop[piece]) - lo, n[item])
    q = q[item] + np.where(on & ON_READ[op], lo - at[item], 0)
    gap = on & chunk.gap[piece]
    rank = chunk.rank[piece] + np.where(gap, 0, lo - chunk.start[piece])
    begin = chunk.place(starts)
    skipped = np.zeros(len(item), np.int64)
    p = np.flatnonzero(on)
    done = rank[p] + np.where(gap[p], 0, size[p])
    fresh = np.r_[True, owner[p[1:]] != owner[p[:-1]]][: len(p)]
    skipped[p] = rank[p] - np.where(fresh, begin[owner[p]], np.r_[0, done[:-1]][: len(p)])

    compared = on & ~gap & ON_READ[op]
    new = np.where(~on, op, np.where(gap, np.where(ON_READ[op], INSERT, DELETE), DELETE))
    kept = np.where(gap & ~ON_READ[op], 0, size)
    # compared parts as runs of equal and unequal bases
    part, j = expand(np.where(compared, size, 0))
    same = chunk.bases[rank[part] - chunk.base_start + j] == reads[q[part] + j]
    head = np.r_[True, (part[1:] != part[:-1]) | (same[1:] != same[:-1])][: len(part)]
    heads = np.flatnonzero(head)
    runs = np.diff(np.append(heads, len(part)))
    others = np.flatnonzero(~compared)
    rows = np.arange(len(item))
    key = np.concatenate([rows, rows[others], part[heads]])
    turn = np.concatenate([np.zeros(len(rows), np.int64), np.ones(len(others), np.int64), 1 + j[heads]])
    sizes = np.concatenate([skipped, kept[others], runs])
    codes = np.concatenate([np.full(len(rows), DELETE), new[others], np.where(same[heads], EQUAL, MISMATCH)])
    by = np.lexsort((turn, key))
    return begin, merge(Ops(owner[key[by]], sizes[by], codes[by]))


class Anew(NamedTuple):
    ops: Ops
    #: Alignment, place on the target and on the read, and lengths there of each run that was aligned anew.
    owner: np.ndarray
    on_ref: np.ndarray
    gone: np.ndarray
    on_read: np.ndarray
    added: np.ndarray


def realign(ops: Ops, first: np.ndarray, reads: np.ndarray, read_at: np.ndarray, quality: list[np.ndarray | None] | None, chunk: Chunk, scores: Scores = Scores()) -> Anew:
    """Runs of indels that have both kinds replaced by their best alignment; all runs are aligned together."""
    owner, n, op = ops
    r = first[owner] + within(n * ON_REF[op], owner)
    q = within(n * ON_READ[op], owner)
    indel = (op == INSERT) | (op == DELETE)
    follows = np.r_[False, indel[1:] & indel[:-1] & (owner[1:] == owner[:-1])][: len(op)]
    heads = np.flatnonzero(indel & ~follows)
    group = np.cumsum(indel & ~follows) - 1
    sums = lambda x: np.bincount(group[indel], (n * (op == x))[indel], len(heads)).astype(np.int64)
    gone, added = sums(DELETE), sums(INSERT)
    both = (gone > 0) & (added > 0)
    at = heads[both]
    mine, on_ref, on_read, gone, added = owner[at], r[at], q[at], gone[both], added[both]
    cut = lambda x, a, k: x[a : a + k]
    refs = [cut(chunk.bases, a - chunk.base_start, k) for a, k in zip(on_ref.tolist(), gone.tolist(), strict=True)]
    queries = [cut(reads, a, k) for a, k in zip((read_at[mine] + on_read).tolist(), added.tolist(), strict=True)]
    qualities = quality and [None if quality[o] is None else cut(quality[o], a, k) for o, a, k in zip(mine.tolist(), on_read.tolist(), added.tolist(), strict=True)]
    _, pair, code = align_many(refs, queries, qualities, scores)
    replaced = indel & both[np.maximum(group, 0)] if len(both) else np.zeros(len(op), bool)
    rest = np.flatnonzero(~replaced)
    key = np.concatenate([rest, at[pair]])
    turn = np.concatenate([np.zeros(len(rest), np.int64), np.arange(len(pair))])
    by = np.lexsort((turn, key))
    new = Ops(np.concatenate([owner[rest], mine[pair]])[by], np.concatenate([n[rest], np.ones(len(pair), np.int64)])[by], np.concatenate([op[rest], code])[by])
    return Anew(merge(new), mine, on_ref, gone, on_read, added)
