"""Operator 7: exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors are integers (floor of a multiple).  The index is a stored table with a row a block of vectors, made once: for each
quantised impact, the binary magnitude of a component, from the largest down, a segment of posting lists, one a dimension, of
(vector, value), and the norm of what each vector has beyond the segment.  For a block of queries the segments
are processed in that order: after each, a query has accumulated the large part of every score, and what the segments to come
can still add is bounded by the norms of the rest.  A threshold is the k-th exact score of those met so far, in this
block and those before it in the task; a query stops only when few enough vectors can still reach it, at once where none can,
and these are rescored exactly.  Nothing is approximate: what is left out is proven to be below the k-th score.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_dir

#: Most vectors, and most components, of a block.
BLOCK, CELLS = 4096, 2**20
QUERY_BLOCK = 512
#: Bytes of query vectors that meet the index in one round; a broadcast holds no more, but for one block.
ROUND_BYTES = 32 << 20
#: A segment with this share of its dimensions times vectors is multiplied as one matrix, others list by list.
FULL = 1 / 16
LEAST, MOST = -(2**63), 2**63 - 1
SEGMENTS = "array<struct<impact: int, counts: binary, rows: binary, vals: binary, rest: binary>>"


def impact_segments(v: np.ndarray) -> list[dict]:
    """Posting lists of the rows of ``v`` by descending binary magnitude.

    ``counts`` has the postings of each dimension, ``rows`` and ``vals`` the vectors and values dimension by dimension, and
    ``rest`` the norm of each vector's smaller components.
    """
    size = np.abs(v.astype(np.float64))
    level = np.where(size > 0, np.frexp(size)[1], 0)
    out = []
    for k in np.unique(level[level > 0])[::-1]:
        dims, rows = np.nonzero((level == k).T)
        rest = np.sqrt((np.where(level < k, size, 0.0) ** 2).sum(axis=1))
        out.append({"impact": int(k), "counts": np.bincount(dims, minlength=v.shape[1]).astype("<u4").tobytes(), "rows": rows.astype("<u4").tobytes(), "vals": v[rows, dims].astype("<i8").tobytes(), "rest": rest.astype("<f8").tobytes()})
    return out


class Block:
    """A block of the index, read from its row."""

    def __init__(self, ids: np.ndarray, dim: int, segments: list[dict]):
        self.ids, self.v, self.segments = ids, np.zeros((len(ids), dim), np.int64), []
        for s in segments:
            rows, vals = np.frombuffer(s["rows"], "<u4"), np.frombuffer(s["vals"], "<i8")
            dims = np.repeat(np.arange(dim), np.frombuffer(s["counts"], "<u4"))
            self.v[rows, dims] = vals
            self.segments.append((dims, rows, vals, np.frombuffer(s["rest"], "<f8")))
        self.most = float(np.abs(self.v.astype(np.float64)).max(initial=0))
        self.norms = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))
        self.ready: dict = {}

    def accumulator(self, turn: int, kind: type):
        """What adds a segment to scores: (vectors, dimensions, matrix), or a list of (dimension, vectors, values)."""
        if (turn, kind) not in self.ready:
            dims, rows, vals, _ = self.segments[turn]
            some, of = np.unique(rows, return_inverse=True)
            used, at = np.unique(dims, return_inverse=True)
            if len(vals) >= FULL * len(some) * len(used):
                matrix = np.zeros((len(used), len(some)), kind)
                matrix[at, of] = vals
                self.ready[turn, kind] = (slice(None) if len(some) == len(self.ids) else some, used, matrix)
            else:
                cut = np.flatnonzero(np.diff(at)) + 1
                self.ready[turn, kind] = list(zip(used, np.split(rows, cut), np.split(vals.astype(kind), cut), strict=True))
        return self.ready[turn, kind]


def accumulate(have: np.ndarray, q: np.ndarray, segment) -> None:
    """Add a segment's part of every score."""
    if isinstance(segment, tuple):
        some, used, matrix = segment
        have[:, some] += q[:, used] @ matrix
    else:
        for d, rows, vals in segment:
            have[:, rows] += q[:, d, None] * vals


def exact_scores(q: np.ndarray, v: np.ndarray, pairs_q: np.ndarray, pairs_v: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows; those beyond 64 bits are held at the ends."""
    safe = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(1, v.shape[1]) < 2**62
    out = np.zeros(len(pairs_q), np.int64)
    step = max(1, 2**21 // max(1, v.shape[1]))
    for a in range(0, len(out), step):
        x, y = q[pairs_q[a : a + step]], v[pairs_v[a : a + step]]
        if safe:
            out[a : a + step] = np.einsum("ij,ij->i", x, y)
        else:
            out[a : a + step] = [min(max(int(s), LEAST), MOST) for s in (x.astype(object) * y.astype(object)).sum(axis=1)]
    return out


def search_block(q: np.ndarray, q_ids: np.ndarray, block: Block, k: int, best: np.ndarray | None = None, few: int = 8):
    """(query rows, vector rows, scores): each query's k best of the block, without such as are proven below its threshold.

    ``best`` (queries x k) holds the k best scores met before, -inf where fewer, and is brought up to date.  A query stops when
    at most ``few`` times k vectors can still reach the threshold.
    """
    best = np.full((len(q), k), -np.inf) if best is None else best
    top = max(float(np.abs(q.astype(np.float64)).max(initial=0)) * block.most * max(1, q.shape[1]), 1.0)
    kind = np.float32 if top < 2**23 else np.float64  # sums of integers are exact in it, or nearly so
    slack = 2.0 if top < 2**52 else top * 1e-9
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-6)
    live, queries, limit = np.arange(len(q)), q.astype(kind), best.min(axis=1)
    have = np.zeros((len(q), len(block.ids)), kind)
    own_q, own_v = np.nonzero(q_ids[:, None] == block.ids[None, :])
    have[own_q, own_v] = -np.inf
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def able(rows: np.ndarray, rest: np.ndarray) -> np.ndarray:
        least = np.where(limit > LEAST, limit - slack, -np.inf)[live[rows], None]
        score = have if len(rows) == len(live) else have[rows]
        if rest.any():
            score = score + np.multiply.outer(norms[live[rows]].astype(kind), rest.astype(kind))
        return (score >= least.astype(kind)) & (score > -np.inf)

    checked = np.inf
    for turn in range(-1, len(block.segments)):
        rest = block.segments[turn][3] if turn >= 0 else block.norms
        if turn >= 0:
            accumulate(have, queries[live], block.accumulator(turn, kind))
        last = turn == len(block.segments) - 1
        if not last and (rest.max(initial=0) > checked / 2 or turn < 1 and not np.isfinite(limit[live]).any()):
            continue
        checked = rest.max(initial=0)
        can = able(np.arange(len(live)), rest)
        many = np.flatnonzero(can.sum(axis=1) > few * k)
        if len(many) and (last or not np.isfinite(limit[live[many]]).all()):
            n = min(k, len(block.ids))
            near = np.argpartition(-have[many], n - 1, axis=1)[:, :n]
            pair_q = np.repeat(live[many], n)
            score = exact_scores(q, block.v, pair_q, near.ravel()).astype(np.float64).reshape(-1, n)
            score[np.take_along_axis(have[many], near, axis=1) == -np.inf] = -np.inf
            if n == k:
                limit[live[many]] = np.maximum(limit[live[many]], score.min(axis=1))
                can[many] = able(many, rest)
        done = np.ones(len(live), bool) if last else can.sum(axis=1) <= few * k
        at, vec = np.nonzero(can & done[:, None])
        found.append((live[at], vec, exact_scores(q, block.v, live[at], vec)))
        live, have = live[~done], have[~done]
        if not len(live):
            break
    row, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((block.ids[vec], ~score, row))  # ~: descending without overflow
    row, vec, score = row[order], vec[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, vec, score, place = row[place < k], vec[place < k], score[place < k], place[place < k]
    both = np.full((len(q), 2 * k), -np.inf)
    both[:, :k] = best
    both[row, k + place] = score
    best[:] = -np.sort(-both, axis=1)[:, :k]
    return row, vec, score


def packed(vectors: DataFrame, rows: int, index: bool) -> DataFrame:
    """Vectors (id, v) packed to blocks of one length: dim, ids, and posting segments for the index or the vectors as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                step = max(1, min(rows, CELLS // max(1, int(dim))))
                for a in range(0, len(at), step):
                    some = at[a : a + step]
                    data = flat[(starts[some][:, None] + np.arange(dim)).ravel()].astype("<i8")
                    body = impact_segments(data.reshape(len(some), dim)) if index else data.tobytes()
                    kind = pa.list_(pa.struct([("impact", pa.int32()), *((c, pa.binary()) for c in ("counts", "rows", "vals", "rest"))])) if index else pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()], pa.binary()), pa.array([body], kind)], ["dim", "ids", "body"])

    made = vectors.mapInArrow(run, f"dim int, ids binary, body {SEGMENTS if index else 'binary'}")
    return made.withColumn("uid", F.struct(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), the found id and score, for each query: a row whose id is divisible by ``query_every``.

    Components become floor(``scale`` * x), the score is the integer inner product (held at the ends of 64 bits), candidates are all rows but those
    with the query's own id, ties go to the smaller id.  Rows with a null id, a null vector or a null or non-finite component
    take no part; vectors meet only vectors of their length.  Equal rows of a query are answered once, repeated candidates
    count each.  With fewer than ``k`` candidates all are returned, and an empty table gives no rows.

    Every block of queries meets every block of the index, as the question asks, in rounds: the queries of a round, at most
    ``ROUND_BYTES``, are broadcast to the index's rows, which don't move, and a round's answers are written when it ends.  A
    block keeps only k rows a query, so the merge reads at most k rows a query and block.
    """
    spark = vectors.sparkSession
    x = F.col("x")
    good = x.isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    chosen = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("x"))
    whole = chosen.where(F.col("id").isNotNull() & good).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    stored = materialise(packed(whole, block, True), "index").select("dim", "ids", "body", "uid")
    asked = materialise(packed(whole.where(F.col("id") % query_every == 0).distinct(), QUERY_BLOCK, False), "queries")
    before = Window.partitionBy(F.lit(0)).orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    turns = asked.select("uid", F.floor(F.coalesce(F.sum(F.length("body")).over(before), F.lit(0)) / ROUND_BYTES).alias("turn"))
    asked = materialise(asked.join(turns, "uid").select(F.col("dim"), F.col("ids").alias("q_ids"), F.col("body").alias("q"), F.col("uid").alias("q_uid"), "turn"), "rounds")
    rounds = (asked.agg(F.max("turn")).first()[0] or 0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, best = None, None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                dim, uid, q_uid = (batch.column(c)[r].as_py() for c in (0, 3, 6))
                if uid != at:  # rows of one block of the index follow each other
                    at, held = uid, Block(np.frombuffer(batch.column(1)[r].as_buffer(), "<i8"), dim, batch.column(2)[r].as_py())
                q_ids, q = (np.frombuffer(batch.column(c)[r].as_buffer(), "<i8") for c in (4, 5))
                q = q.reshape(len(q_ids), dim)
                known = best.setdefault(tuple(q_uid.values()), np.full((len(q), k), -np.inf))
                row, vec, score = search_block(q, q_ids, held, k, known)
                if len(row):
                    names = np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=7).digest(), "big") for v in q])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[row], names[row], held.ids[vec], score)], ["query_id", "vector", "vec_id", "score"])

    path = f"{scratch_dir(spark)}/found-{uuid.uuid4().hex}"
    place = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.col("score").desc(), "vec_id"))
    for turn in range(rounds):
        met = stored.join(F.broadcast(asked.where(F.col("turn") == turn).drop("turn")), "dim").select("dim", "ids", "body", "uid", "q_ids", "q", "q_uid")
        found = met.mapInArrow(run, "query_id long, vector long, vec_id long, score long")
        found = found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
        found.write.parquet(f"{path}/turn={turn}")
    return spark.read.schema(found.schema).parquet(path).select(*found.columns)
