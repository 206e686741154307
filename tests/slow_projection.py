"""The rules of projection base by base and alignment by full tables: what the kernels are held against."""

from __future__ import annotations

import math
from bisect import bisect_right

Ops = list[tuple[int, str]]


def push(out: list[list], n: int, op: str) -> None:
    if n > 0:
        if out and out[-1][1] == op:
            out[-1][0] += n
        else:
            out.append([n, op])


class Lookup:
    """Columns and ranks from lists of blocks (seq_start, aln_start, len) in order."""

    def __init__(self, blocks: list[tuple[int, int, int]]):
        self.blocks = blocks
        self.seq, self.aln = [b[0] for b in blocks], [b[1] for b in blocks]

    def column(self, pos: int) -> int:
        s, a, _ = self.blocks[bisect_right(self.seq, pos) - 1]
        return a + pos - s

    def rank(self, column: int, before: int) -> tuple[int, bool]:
        """Bases before the column, and whether it is a gap; ``before`` holds where no block has begun."""
        k = bisect_right(self.aln, column) - 1
        if k < 0:
            return before, True
        s, a, n = self.blocks[k]
        return s + min(column - a, n), column - a >= n


def rewrite(ops: Ops, seq: str, start: int, src: Lookup, dst: Lookup, before: int, bases: str, base_start: int) -> tuple[int, Ops]:
    """Position on the target and the CIGAR there, before indels are aligned anew.

    Each base of the source stands in a column of the alignment: what the target has between two columns is deleted, a
    target gap makes the read's base an insertion and a deleted one nothing, else the bases are compared.
    """
    out: list[list] = []
    q, at = 0, start
    first = done = dst.rank(src.column(start), before)[0]
    for n, op in ops:
        if op in "ISHP":
            push(out, n, op)
            q += n if op in "IS" else 0
            continue
        for _ in range(n):
            rank, gap = dst.rank(src.column(at), before)
            push(out, rank - done, "D")
            done = rank if gap else rank + 1
            if op in "DN":
                push(out, 0 if gap else 1, "D")
            elif gap:
                push(out, 1, "I")
            else:
                push(out, 1, "=" if bases[rank - base_start] == seq[q] else "X")
            q += op not in "DN"
            at += 1
    return first, [(n, op) for n, op in out]


def quality_score(equal: bool, a: int, b: int) -> float:
    """Log-odds of two bases by their Phred qualities."""
    x, y = 10 ** (-a / 10), 10 ** (-b / 10)
    e = x + y - 4 / 3 * x * y
    return 2 + math.log2(1 - e) if equal else 2 - math.log2(3) + math.log2(e)


def align_global(ref: str, query: str, quality: list[int] | None = None, gap_open: float = 0, gap_extend: float = -1, match: float = 0, mismatch: float = -1, best_quality: int = 41) -> tuple[float, Ops]:
    """Best global alignment with affine gaps (open + n * extend): score and CIGAR of = X I D."""
    low = -math.inf
    n, m = len(ref), len(query)
    # three tables: ending in a pair, in a deletion (reference alone), in an insertion (read alone)
    pair = [[low] * (m + 1) for _ in range(n + 1)]
    gone, added = ([row[:] for row in pair] for _ in range(2))
    pair[0][0] = 0.0
    for i in range(1, n + 1):
        gone[i][0] = gap_open + gap_extend * i
    for j in range(1, m + 1):
        added[0][j] = gap_open + gap_extend * j
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            equal = ref[i - 1] == query[j - 1]
            s = (match if equal else mismatch) if quality is None else quality_score(equal, best_quality, quality[j - 1])
            pair[i][j] = s + max(pair[i - 1][j - 1], gone[i - 1][j - 1], added[i - 1][j - 1])
            gone[i][j] = gap_extend + max(gone[i - 1][j], gap_open + max(pair[i - 1][j], added[i - 1][j]))
            added[i][j] = gap_extend + max(added[i][j - 1], gap_open + max(pair[i][j - 1], gone[i][j - 1]))
    i, j = n, m
    best = max(pair[n][m], gone[n][m], added[n][m])
    near = lambda a, b: a == b or abs(a - b) < 1e-9
    table = added if near(added[n][m], best) else gone if near(gone[n][m], best) else pair  # of equals, gaps stand last
    back: list[list] = []
    while i or j:
        here = table[i][j]
        if table is pair:
            equal = ref[i - 1] == query[j - 1]
            push(back, 1, "=" if equal else "X")
            s = (match if equal else mismatch) if quality is None else quality_score(equal, best_quality, quality[j - 1])
            i, j = i - 1, j - 1
            table = next((t for t in (added, gone, pair) if near(t[i][j] + s, here)), pair)
        else:
            own = table
            push(back, 1, "D" if own is gone else "I")
            i, j = (i - 1, j) if own is gone else (i, j - 1)
            if not near(own[i][j] + gap_extend, here):
                table = next((t for t in (added if own is gone else gone, pair) if near(t[i][j] + gap_open + gap_extend, here)), pair)
    return best, [(k, op) for k, op in reversed(back)]


def realign(first: int, ops: Ops, seq: str, quality: list[int] | None, bases: str, base_start: int, gap_open: float, gap_extend: float) -> tuple[Ops, list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs of indels that have both kinds replaced by their best alignment: CIGAR, and the (location, length) of the runs on target and read."""
    out: list[list] = []
    on_ref, on_query = [], []
    r, q, k = first, 0, 0
    while k < len(ops):
        stop = k
        while stop < len(ops) and ops[stop][1] in "ID":
            stop += 1
        if stop == k:
            n, op = ops[k]
            push(out, n, op)
            r += n if op in "M=XN" else 0
            q += n if op in "M=XS" else 0
            k += 1
            continue
        gone, added = (sum(n for n, op in ops[k:stop] if op == o) for o in "DI")
        if gone and added:
            new = align_global(bases[r - base_start : r - base_start + gone], seq[q : q + added], quality and quality[q : q + added], gap_open, gap_extend)[1]
            on_ref.append((r, gone))
            on_query.append((q, added))
        else:
            new = ops[k:stop]
        for n, op in new:
            push(out, n, op)
        r, q, k = r + gone, q + added, stop
    return [(n, op) for n, op in out], on_ref, on_query
