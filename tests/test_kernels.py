"""The per-alignment kernels on random alignments, against slow readings of the same rules column by column."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pytest

from alnspark.operators import align
from alnspark.operators import rewrite as kernels
from tests import slow_projection
from tests.slow_projection import Lookup, push, quality_score


def as_ops(cigars):
    owner = [k for k, ops in enumerate(cigars) for _ in ops]
    return kernels.Ops(*(np.array(x, np.int64) for x in (owner, [n for ops in cigars for n, _ in ops], [kernels.CODES.index(op) for ops in cigars for _, op in ops])))


def as_cigars(ops, total):
    out = [[] for _ in range(total)]
    for owner, n, op in zip(*(x.tolist() for x in ops), strict=True):
        out[owner].append((n, kernels.CODES[op]))
    return out


def reads_of(queries):
    return np.frombuffer("".join(queries).encode(), np.uint8), np.cumsum([0, *map(len, queries)])[:-1]


def rewrite_many(cigars, queries, starts, src, dst, before, target, base_start):
    chunk = kernels.Chunk(np.array(src, np.int64).reshape(-1, 3), np.array(dst, np.int64).reshape(-1, 3), before, target.encode(), base_start)
    first, ops = kernels.rewrite(as_ops(cigars), np.array(starts), *reads_of(queries), chunk)
    return chunk, first, ops


def rewrite(ops, query, start, src, dst, before, target, base_start):
    _, first, out = rewrite_many([ops], [query], [start], src.blocks, dst.blocks, before, target, base_start)
    return int(first[0]), as_cigars(out, 1)[0]


def realign(first, ops, query, quality, target, base_start, gap_open, gap_extend):
    chunk = kernels.Chunk(np.array([[0, 0, 1]]), np.zeros((0, 3), np.int64), 0, target.encode(), base_start)
    done = kernels.realign(as_ops([ops]), np.array([first]), *reads_of([query]), quality and [np.array(quality)], chunk, align.Scores(gap_open, gap_extend))
    pairs = lambda a, b: list(zip(a.tolist(), b.tolist(), strict=True))
    return as_cigars(done.ops, 1)[0], pairs(done.on_ref, done.gone), pairs(done.on_read, done.added)


def align_global(ref, query, quality=None, gap_open=0, gap_extend=-1):
    as_bytes = lambda x: np.frombuffer(x.encode(), np.uint8)
    best, owner, code = align.align_many([as_bytes(ref)], [as_bytes(query)], [quality if quality is None else np.array(quality)], align.Scores(gap_open, gap_extend))
    return best[0], as_cigars(kernels.merge(kernels.Ops(owner, np.ones(len(owner), np.int64), code)), 1)[0]


def blocks(aligned):
    out, at, seq = [], 0, 0
    while at < len(aligned):
        n = 0
        while at + n < len(aligned) and aligned[at + n] != "-":
            n += 1
        if n:
            out.append((seq, at, n))
            seq += n
        at += n or 1
    return out


def slowly(ops, query, start, src, dst):
    """Walk the columns of both sequences and write one operation a column."""
    columns = [k for k, c in enumerate(src) if c != "-"]
    rank = lambda column: sum(c != "-" for c in dst[:column])
    out, q, at = [], 0, start
    done = first = rank(columns[start])
    for n, op in ops:
        for _ in range(n):
            if op in "ISHP":
                push(out, 1, op)
                q += op in "IS"
                continue
            column = columns[at]
            push(out, rank(column) - done, "D")
            done = rank(column)
            if dst[column] != "-":
                push(out, 1, "D" if op in "DN" else "=" if dst[column] == query[q] else "X")
                done += 1
            elif op not in "DN":
                push(out, 1, "I")
            q += op not in "DN"
            at += 1
    return first, [tuple(x) for x in out]


@st.composite
def cases(draw):
    r = random.Random(draw(st.integers(0, 10**9)))
    n = r.randint(8, 60)
    src, dst = ("".join("-" if r.random() < 0.25 else r.choice("ACGT") for _ in range(n)) for _ in range(2))
    bases = [c for c in src if c != "-"] or ["A"]
    if src.count("-") == n:
        src = "A" + src[1:]
    start = r.randrange(len(bases))
    ops, at, q = [], start, 0
    for _ in range(r.randint(1, 8)):
        op, k = r.choice("M=XDNISHP"), r.randint(1, 4)
        if op in "M=XDN":
            k = min(k, len(bases) - at)
            at += k
        if k:
            ops.append((k, op))
            q += k if op in "M=XIS" else 0
    return ops, "".join(r.choices("ACGT", k=q)), start, src, dst


@settings(max_examples=400, deadline=None)
@given(cases())
def test_rewrite_reads_the_columns(case):
    ops, query, start, src, dst = case
    target = dst.replace("-", "")
    got = rewrite(ops, query, start, Lookup(blocks(src)), Lookup(blocks(dst)), 0, target, 0)
    assert got == slowly(ops, query, start, src, dst)


@settings(max_examples=300, deadline=None)
@given(cases())
def test_realignment_keeps_lengths_and_is_at_least_as_good(case):
    ops, query, start, src, dst = case
    target = dst.replace("-", "")
    first, before = rewrite(ops, query, start, Lookup(blocks(src)), Lookup(blocks(dst)), 0, target, 0)
    after, on_ref, on_query = realign(first, before, query, None, target, 0, 0, -1)
    length = lambda x, of: sum(n for n, op in x if op in of)
    assert length(before, "M=XDN") == length(after, "M=XDN") and length(before, "M=XIS") == length(after, "M=XIS")
    cost = lambda x: length(x, "XID")
    assert cost(after) <= cost(before) and len(on_ref) == len(on_query)
    r = first
    q = 0
    for n, op in after:  # = and X tell the truth
        for k in range(n):
            if op in "=X":
                assert (target[r + k] == query[q + k]) == (op == "=")
        r += n if op in "M=XDN" else 0
        q += n if op in "M=XIS" else 0


def best(ref, query, gap_open, gap_extend):
    """The best score by trying every path."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j, before):
        if i == len(ref) and j == len(query):
            return 0
        found = []
        if i < len(ref) and j < len(query):
            found.append((0 if ref[i] == query[j] else -1) + go(i + 1, j + 1, "M"))
        for op, a, b in (("D", 1, 0), ("I", 0, 1)):
            if i + a <= len(ref) and j + b <= len(query):
                found.append(gap_extend + (0 if before == op else gap_open) + go(i + a, j + b, op))
        return max(found)

    return go(0, 0, "")


@settings(max_examples=300, deadline=None)
@given(st.text("AC", max_size=6), st.text("AC", max_size=6), st.integers(-3, 0), st.integers(-2, -1))
def test_alignment_is_optimal(ref, query, gap_open, gap_extend):
    score, ops = align_global(ref, query, None, gap_open, gap_extend)
    assert score == best(ref, query, gap_open, gap_extend)
    assert sum(n for n, op in ops if op in "=XD") == len(ref) and sum(n for n, op in ops if op in "=XI") == len(query)
    told = sum(-n if op == "X" else gap_open + gap_extend * n if op in "ID" else 0 for n, op in ops)
    assert told == score


@settings(max_examples=150, deadline=None)
@given(st.lists(cases(), min_size=1, max_size=6))
def test_rewriting_together_equals_the_walk_base_by_base(several):
    """All alignments of one pair of sequences at once."""
    _, _, _, src, dst = several[0]
    columns = src.replace("-", "")
    several = [(ops, q, start) for ops, q, start, *_ in several if start + sum(n for n, op in ops if op in "M=XDN") <= len(columns) and start < len(columns)]
    if not several:
        return
    target = dst.replace("-", "")
    cigars, queries, starts = zip(*several, strict=True)
    chunk, first, out = rewrite_many(cigars, queries, starts, blocks(src), blocks(dst), 0, target, 0)
    want = [slow_projection.rewrite(ops, q, at, Lookup(blocks(src)), Lookup(blocks(dst)), 0, target, 0) for ops, q, at in several]
    assert [(int(f), o) for f, o in zip(first, as_cigars(out, len(several)), strict=True)] == want
    done = kernels.realign(out, first, *reads_of(queries), None, chunk)
    for k, ((f, before), query) in enumerate(zip(want, queries, strict=True)):
        after, on_ref, on_read = slow_projection.realign(f, before, query, None, target, 0, 0, -1)
        assert as_cigars(done.ops, len(several))[k] == after
        mine = done.owner == k
        assert [*zip(done.on_ref[mine].tolist(), done.gone[mine].tolist(), strict=True)] == on_ref
        assert [*zip(done.on_read[mine].tolist(), done.added[mine].tolist(), strict=True)] == on_read


@pytest.mark.parametrize("cells", [1 << 21, 1])
def test_alignments_equal_full_tables(monkeypatch, cells):
    """Scores and paths, ties included, with and without qualities, in size classes and with kept rows."""
    monkeypatch.setattr(align, "CELLS", cells)
    r = random.Random(cells)
    for opened, step in ((0, -1), (-2, -1), (-3, -0.5)):
        for with_quality in (False, True):
            pairs = [("".join(r.choices("ACG", k=r.randint(0, 14))), "".join(r.choices("ACG", k=r.randint(0, 14)))) for _ in range(60)]
            quality = [[r.randint(3, 41) for _ in q] if with_quality else None for _, q in pairs]
            as_bytes = lambda x: np.frombuffer(x.encode(), np.uint8)
            best, owner, code = align.align_many([as_bytes(a) for a, _ in pairs], [as_bytes(b) for _, b in pairs], [None if q is None else np.array(q) for q in quality], align.Scores(opened, step))
            got = as_cigars(kernels.merge(kernels.Ops(owner, np.ones(len(owner), np.int64), code)), len(pairs))
            for k, (a, b) in enumerate(pairs):
                score, ops = slow_projection.align_global(a, b, quality[k], opened, step)
                assert got[k] == ops and abs(best[k] - score) < 1e-6


def test_scores_of_qualities():
    equal, unequal = align.quality_scores(41, np.array([2, 20, 41]))
    assert np.allclose(equal, [quality_score(True, 41, q) for q in (2, 20, 41)]) and np.allclose(unequal, [quality_score(False, 41, q) for q in (2, 20, 41)])


def test_long_runs_in_bounded_memory():
    """8,000 by 8,000 cells in three tables of doubles are 1.5 GB; kept rows are a few hundred rows."""
    import tracemalloc

    r = random.Random(4)
    a = "".join(r.choices("ACGT", k=8000))
    b = "".join(c for c in a if r.random() > 0.01)
    tracemalloc.start()
    score, ops = align_global(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert score == -(len(a) - len(b)) and {op for _, op in ops} == {"=", "D"} and peak < 150e6
