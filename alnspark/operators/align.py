"""Global alignment with affine gaps of many pairs of sequences at once, in numpy.

The three tables (ending in a pair, in a deletion, in an insertion) are filled row by row for all pairs of one size class together: within a row
an insertion is a running maximum.  Pairs with more than CELLS cells are aligned alone with every K-th row kept, and rows between are
filled again while the path is traced through them, so memory is K rows and a K-th of all rows rather than the tables, and the path is the same.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Cells of a table that are held at once.
CELLS = 1 << 21
LOW = -np.inf
NEAR = 1e-9
#: Codes of the operations in the order of OPS.
OPS = "=XID"
EQUAL, MISMATCH, INSERT, DELETE = range(4)


class Scores(NamedTuple):
    gap_open: float = 0
    gap_extend: float = -1
    match: float = 0
    mismatch: float = -1
    best_quality: int = 41


def quality_scores(best: int, quality: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of an equal and of an unequal pair of bases by their Phred qualities."""
    x, y = 10 ** (-best / 10), 10 ** (-quality.astype(np.float64) / 10)
    e = x + y - 4 / 3 * x * y
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 + np.log2(1 - e), 2 - np.log2(3) + np.log2(e)


def padded(texts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """A row of bytes each, zero beyond its size."""
    out = np.zeros((len(sizes), sizes.max()), np.uint8)
    out[np.arange(sizes.max()) < sizes[:, None]] = np.concatenate([np.asarray(x, np.uint8) for x in texts])
    return out


class Pairs:
    """References (B, N) and queries (B, M) as padded bytes with their sizes, and the scores of equal and unequal pairs (B, M)."""

    def __init__(self, refs: list[np.ndarray], queries: list[np.ndarray], qualities: list[np.ndarray | None], scores: Scores):
        self.scores = scores
        self.n, self.m = np.array([len(r) for r in refs]), np.array([len(q) for q in queries])
        self.ref, self.query = padded(refs, self.n), padded(queries, self.m)
        self.equal, self.unequal = (np.full(self.query.shape, x, np.float64) for x in (scores.match, scores.mismatch))
        for b, q in enumerate(qualities):
            if q is not None:
                self.equal[b, : len(q)], self.unequal[b, : len(q)] = quality_scores(scores.best_quality, q)

    def first(self) -> np.ndarray:
        """Row 0: (3, B, M + 1)."""
        rows = np.full((3, len(self.n), self.query.shape[1] + 1), LOW)
        rows[0, :, 0] = 0
        rows[2, :, 1:] = self.scores.gap_open + self.scores.gap_extend * np.arange(1, rows.shape[2])
        return rows

    def fill(self, row: np.ndarray, start: int, stop: int, keep: int = 1) -> np.ndarray:
        """Rows start, start + keep, ... up to ``stop`` of the tables, given row ``start``: (rows, 3, B, M + 1)."""
        opened, step = self.scores.gap_open, self.scores.gap_extend
        slope = step * np.arange(row.shape[2], dtype=np.float64)
        ahead = slope[1:] + opened
        out = np.empty(((stop - start) // keep + 1, *row.shape))
        out[0] = row
        spare = np.empty((2, *row.shape))  # rows that aren't kept, by turns
        best, base = np.empty_like(row[0]), np.empty_like(row[0])
        gains: dict[int, np.ndarray] = {}  # of a single pair, by the reference's base
        for i in range(start + 1, stop + 1):
            new = spare[i % 2] if (i - start) % keep else out[(i - start) // keep]
            pair, gone, added = new
            p, g, a = row
            np.maximum(p, a, out=best)
            np.add(best, opened, out=gone)
            np.maximum(gone, g, out=gone)
            gone += step
            np.maximum(best, g, out=best)
            if len(row[0]) > 1:
                gain = np.where(self.ref[:, i - 1, None] == self.query, self.equal, self.unequal)
            elif (gain := gains.get(c := int(self.ref[0, i - 1]))) is None:
                gain = gains[c] = np.where(self.query == c, self.equal, self.unequal)
            np.add(best[:, :-1], gain, out=pair[:, 1:])
            pair[:, 0] = added[:, 0] = LOW
            np.maximum(pair, gone, out=base)
            base -= slope
            np.maximum.accumulate(base[:, :-1], axis=1, out=added[:, 1:])
            added[:, 1:] += ahead
            row = new
        return out

    def together(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the operations from the end to the start, one column a pair (-1 beyond its path): all paths step together."""
        t = self.fill(self.first(), 0, self.ref.shape[1])
        b, i, j = np.arange(len(self.n)), self.n.copy(), self.m.copy()
        ends = t[i, :, b, j]
        best = ends.max(axis=1)
        near = ends >= best[:, None] - NEAR
        table = np.where(near[:, 2], 2, np.where(near[:, 1], 1, 0))  # of equals, gaps stand last
        steps = []
        while (live := (i > 0) | (j > 0)).any():
            here = t[i, table, b, j]
            di, dj = (live & (table != 2)).astype(np.int64), (live & (table != 1)).astype(np.int64)
            same = self.ref[b, np.maximum(i - 1, 0)] == self.query[b, np.maximum(j - 1, 0)] if self.query.shape[1] and self.ref.shape[1] else np.zeros(len(b), bool)
            code = np.where(table == 2, INSERT, np.where(table == 1, DELETE, np.where(same, EQUAL, MISMATCH)))
            steps.append(np.where(live, code, -1))
            at = np.maximum(j - 1, 0)
            gain = np.where(same, self.equal[b, at], self.unequal[b, at]) if self.query.shape[1] else np.zeros(len(b))
            i, j = i - di, j - dj
            before = t[i, :, b, j]
            stay, change = before[b, table] + self.scores.gap_extend, before + (self.scores.gap_open + self.scores.gap_extend)
            other = np.where(np.abs(change[b, np.where(table == 2, 1, 2)] - here) < NEAR, np.where(table == 2, 1, 2), 0)
            gap = np.where(np.abs(stay - here) < NEAR, table, other)
            by_pair = before + gain[:, None]
            pair = np.where(np.abs(by_pair[:, 2] - here) < NEAR, 2, np.where(np.abs(by_pair[:, 1] - here) < NEAR, 1, 0))
            table = np.where(live, np.where(table == 0, pair, gap), table)
        return best, np.array(steps, np.int64).reshape(-1, len(b))

    def alone(self, keep: int) -> tuple[float, list[int]]:
        """Score and the operations from the end to the start of the only pair, with every ``keep``-th row held."""
        n, m = int(self.n[0]), int(self.m[0])
        kept = self.fill(self.first(), 0, n - n % keep, keep)
        equal, unequal, ref, query = self.equal[0], self.unequal[0], self.ref[0].tolist(), self.query[0].tolist()
        opened, step = self.scores.gap_open + self.scores.gap_extend, self.scores.gap_extend
        i, j, table, out, best = n, m, None, [], 0.0
        for k in range(n // keep, -1, -1):
            low = k * keep
            if i == low and k and table is not None:
                continue
            t = self.fill(kept[k], low, i)[:, :, 0]
            t = [t[:, x] for x in range(3)]
            if table is None:
                ends = [float(x[i - low, j]) for x in t]
                best = max(ends)
                table = next(x for x in (2, 1, 0) if ends[x] >= best - NEAR)
            while i > low or (k == 0 and j):
                here = t[table].item(i - low, j)
                if table == 0:
                    same = ref[i - 1] == query[j - 1]
                    out.append(EQUAL if same else MISMATCH)
                    wanted = here - (equal.item(j - 1) if same else unequal.item(j - 1))
                    i, j = i - 1, j - 1
                    table = 2 if abs(t[2].item(i - low, j) - wanted) < NEAR else 1 if abs(t[1].item(i - low, j) - wanted) < NEAR else 0
                else:
                    out.append(DELETE if table == 1 else INSERT)
                    i, j = (i - 1, j) if table == 1 else (i, j - 1)
                    if abs(t[table].item(i - low, j) + step - here) >= NEAR:
                        table = 3 - table if abs(t[3 - table].item(i - low, j) + opened - here) < NEAR else 0
        return best, out


def align_many(refs: list[np.ndarray], queries: list[np.ndarray], qualities: list[np.ndarray | None] | None = None, scores: Scores = Scores()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best global alignment of each pair: its score, and all operations in order as the number of their pair and their codes."""
    total = len(refs)
    qualities = qualities or [None] * total
    sizes = np.array([(len(r), len(q)) for r, q in zip(refs, queries, strict=True)], np.int64).reshape(-1, 2)
    cells = (sizes[:, 0] + 1) * (sizes[:, 1] + 1)
    classes = np.ceil(np.log2(sizes + 1)).astype(np.int64)
    order = np.lexsort((cells, classes[:, 1], classes[:, 0]))
    best, owners, codes = np.zeros(total), [], []
    at = 0
    while at < total:
        k = order[at]
        room = max(1, CELLS // int((1 << classes[k, 0]) * (1 << classes[k, 1])))
        to = at + 1
        while to < total and to - at < room and (classes[order[to]] == classes[k]).all():
            to += 1
        some = order[at:to]
        at = to
        pairs = Pairs([refs[x] for x in some], [queries[x] for x in some], [qualities[x] for x in some], scores)
        if len(some) < 4:
            for x in some:
                one = pairs if len(some) == 1 else Pairs([refs[x]], [queries[x]], [qualities[x]], scores)
                keep = max(1, int(np.sqrt(len(refs[x])))) if cells[x] > CELLS else max(len(refs[x]), 1)
                best[x], path = one.alone(keep)
                owners.append(np.full(len(path), x))
                codes.append(np.array(path[::-1], np.int64))
        else:
            best[some], steps = pairs.together()
            steps = steps[::-1].T
            real = steps >= 0
            owners.append(np.repeat(some, real.sum(axis=1)))
            codes.append(steps[real])
    owner, code = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (owners, codes))
    by = np.argsort(owner, kind="stable")
    return best, owner[by], code[by]
