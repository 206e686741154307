"""Operator 13: bytes of texts that repeat an earlier stretch of ``length`` bytes, by suffix arrays.

A window is a string of ``length`` bytes at one place.  Each window belongs to the anchor in it: the GRAM bytes of least hash, the
first of several.  Equal windows have equal anchors, so they meet if windows are dealt by the hash of their anchor.  Consecutive windows of one anchor
make a fragment of the text.  Rows without bytes (hash of anchor, hash of fragment, document, place) are sorted by these hashes: of equal fragments all but the
first are repeats as a whole.  The first copies of different fragments with the same anchor are fetched from their texts, put
together, their suffixes sorted in two stages, and adjacent common prefixes of ``length`` bytes or more make groups of equal windows:
all but the first window of a group are repeats.  A document's repeats are the union of what its repeated windows cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, spans
from .hashing import finish, prefix_hash, substring
from .suffix_array import common_prefixes, two_stage, words_of

#: Bytes of an anchor.
GRAM = 24
#: Bytes of text whose windows are found at once, and bytes of fragments whose suffixes are sorted at once.
BATCH_BYTES = 1 << 20
SORT_BYTES = 1 << 21
#: An anchor with more different fragments has its windows dealt one by one.
HOT = 20_000
KEY = "id bigint, t bigint"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    blocks = np.append(x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def fragments(parts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes joined; of each fragment the part it is in, its first window, its number of windows (places in the joined bytes) and the hash of its anchor."""
    joined = b"".join(parts)
    text = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n = len(text) - length + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return joined, none, none, none, none.astype(np.uint64)
    at = np.arange(len(text) - GRAM + 1)
    gram = finish(substring(prefix_hash(text), at, at + GRAM))
    low = np.uint64(32)
    anchor = (sliding_min((gram >> low << low) | at.astype(np.uint64), length - GRAM + 1) & np.uint64(2**32 - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)[:n]
    whole = np.arange(n) + length <= np.cumsum(sizes)[owner]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]] | ~whole
    cuts = np.flatnonzero(new)
    counts = np.diff(np.append(cuts, n))
    real = whole[cuts]
    cuts, counts = cuts[real], counts[real]
    return joined, owner[cuts], cuts, counts, gram[anchor[cuts]]


def cut(rows: list[bytes], length: int, limit: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, offset, bytes) parts of the texts of rows, of ``limit`` windows at most, that together hold every window once."""
    for k, text in enumerate(rows):
        for a in range(0, max(len(text) - length + 1, 0), limit):
            yield k, a, text[a : a + limit + length - 1]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(later, h, f, id, t, start, n) of every fragment of ``docs`` (id, t, text as bytes), dealt by anchor and sorted.

    h and f are the hashes of anchor and fragment.  Of equal fragments in one batch all but the first are marked as later
    at once and dealt anywhere, so a common fragment has a row a batch to meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            parts = list(cut([x.as_py() for x in batch.column(2)], length, BATCH_BYTES))
            for a, b in spans(parts, lambda x: len(x[2]), BATCH_BYTES):
                some = parts[a:b]
                joined, owner, first, count, h = fragments([x[2] for x in some], length)
                f = np.fromiter((xxhash.xxh3_64_intdigest(joined[p:q]) for p, q in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)), np.uint64, len(first))
                row = np.array([x[0] for x in some])[owner]
                base = np.array([x[1] for x in some]) - np.cumsum([0, *(len(x[2]) for x in some)])[:-1]
                start, i, t = first + base[owner], ids[row], ts[row]
                by = np.lexsort((start, t, i, f, h))
                h, f, i, t, start, count = (x[by] for x in (h.view(np.int64), f.view(np.int64), i, t, start, count))
                new = np.r_[True, (h[1:] != h[:-1]) | (f[1:] != f[:-1])][: len(h)]
                begin = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else by
                later = (i != i[begin]) | (t != t[begin]) | (start != start[begin])
                keep = new | later  # a repeated row is the same document
                arrays = [pa.array(x[keep]) for x in (later, h, f, i, t, start, count)]
                yield pa.RecordBatch.from_arrays(arrays, ["later", "h", "f", "id", "t", "start", "n"])

    rows = docs.mapInArrow(run, f"later boolean, h bigint, f bigint, {KEY}, start bigint, n bigint")
    return rows.repartition(F.when(F.col("later"), F.xxhash64("f", "t", "start")).otherwise(F.col("h"))).sortWithinPartitions("h", "f", "id", "t", "start")


def firsts(rows: DataFrame) -> DataFrame:
    """(later, h, id, t, start, n): rows of fragments that an equal one precedes, and the first rows of those with different fragments of the same anchor.

    ``rows`` are those of anchors().  They are read as a stream, of which one row is held back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["later", "h", "id", "t", "start", "n"]
        held = None  # the last first row, and whether the anchor before it is the same
        for batch in batches:
            late = batch.filter(batch.column(0))
            if len(late):
                yield pa.RecordBatch.from_arrays([late.column(k) for k in (0, 1, 3, 4, 5, 6)], names)
            x = np.stack([c.to_numpy() for c in batch.filter(pa.compute.invert(batch.column(0))).columns[1:]])  # h, f, id, t, start, n
            if not x.shape[1]:
                continue
            begun = held is not None
            if begun:
                x = np.concatenate([held[0][:, None], x], axis=1)
            new = np.r_[True, (x[:2, 1:] != x[:2, :-1]).any(axis=0)]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = (x[2:5] != x[2:5, begin]).any(axis=0)
            at = np.flatnonzero(new)
            joined = np.r_[held[1] if begun else False, x[0, at[1:]] == x[0, at[:-1]]]
            company = joined.copy()
            company[:-1] |= joined[1:]
            held = x[:, at[-1]], joined[-1]
            out = np.concatenate([np.flatnonzero(later), at[:-1][company[:-1]]])
            flags = np.arange(len(out)) < later.sum()
            yield pa.RecordBatch.from_arrays([pa.array(flags), *(pa.array(x[k, out]) for k in (0, 2, 3, 4, 5))], names)
        if held is not None and held[1]:
            yield pa.RecordBatch.from_arrays([pa.array([False]), *(pa.array(held[0][k : k + 1]) for k in (0, 2, 3, 4, 5))], names)

    return rows.mapInArrow(run, f"later boolean, h bigint, {KEY}, start bigint, n bigint")


def bodies(texts: DataFrame, length: int) -> DataFrame:
    """(route, id, t, start, body) of the wanted fragments of ``texts`` (id, t, text, wanted): one row each or, for hot anchors, one for each window, dealt by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i, t, text, wanted in zip(*(c for c in batch.columns), strict=True):
                i, t, text = i.as_py(), t.as_py(), text.as_py()
                for w in wanted.as_py():
                    h, start, n = w["h"], w["start"], w["n"]
                    if w["hot"]:
                        some = [text[s : s + length] for s in range(start, start + n)]
                        out += [(xxhash.xxh3_64_intdigest(b) - 2**63, i, t, start + k, b) for k, b in enumerate(some)]
                        size += n * length
                    else:
                        out.append((h, i, t, start, text[start : start + n + length - 1]))
                        size += n + length
                    if size > BATCH_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["route", "id", "t", "start", "body"])

    return texts.mapInArrow(run, f"route bigint, {KEY}, start bigint, body binary")


def repeated(keys: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``parts`` (whose documents and places are the columns of ``keys``) that an equal one precedes: the part they are in, their offset; and whether all of a part's are."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    words = words_of(text)
    suffixes = two_stage(text, length, words)
    offset = suffixes - begins[owner[suffixes]]
    suffixes = suffixes[offset + length <= sizes[owner[suffixes]]]
    by = np.lexsort(keys[::-1])
    rank = np.empty(len(parts), np.int64)  # equal keys, of a repeated row, have equal ranks
    rank[by] = np.cumsum(np.r_[True, (keys[:, by[1:]] != keys[:, by[:-1]]).any(axis=0)])
    part = owner[suffixes]
    order = rank[part] * np.int64(4 * length) + suffixes - begins[part]
    heads = np.flatnonzero(common_prefixes(words, suffixes, length) < length)
    least = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(order))))
    again = order > least
    left = np.bincount(part[~again], minlength=len(parts))
    places = np.sort(suffixes[again])
    part = owner[places]
    return part, places - begins[part], left == 0


def sort_fragments(rows: DataFrame, length: int) -> DataFrame:
    """(id, t, start, stop) covered by repeated windows of the fragments of bodies(), dealt by route and sorted by route and place.

    Whole routes are sorted together, about SORT_BYTES at once.  Of a route beyond that, which bodies() leaves to equal
    windows only, those not seen before stay as company for the next rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, size, known = np.zeros((4, 0), np.int64), [], 0, 0  # known: parts already judged, which come first
        for batch in batches:
            keys = np.concatenate([keys, np.stack([c.to_numpy() for c in batch.columns[:4]])], axis=1)
            new = [x.as_py() for x in batch.column(4)]
            parts, size = parts + new, size + sum(map(len, new))
            while size > SORT_BYTES:
                last = int(np.searchsorted(keys[0], keys[0, -1]))  # sorted by route: where the last one begins
                if last == 0 and size < 8 * SORT_BYTES:
                    break
                ends = np.flatnonzero(np.r_[keys[0, 1:] != keys[0, :-1], True]) + 1
                total = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
                fits = ends[(total[ends - 1] <= SORT_BYTES) & (ends <= max(last, 1))]
                if last == 0:
                    out, gone = judge(keys, parts, known)
                    yield out
                    keys, parts = keys[:, ~gone], [p for p, g in zip(parts, gone.tolist(), strict=True) if not g]
                    known = len(parts)
                    size = sum(map(len, parts))
                    break
                to = int(fits[-1]) if len(fits) else int(ends[0])
                yield judge(keys[:, :to], parts[:to], known)[0]
                keys, parts, known = keys[:, to:], parts[to:], 0
                size = sum(map(len, parts))
        if parts:
            yield judge(keys, parts, known)[0]

    def judge(keys: np.ndarray, parts: list[bytes], known: int) -> tuple[pa.RecordBatch, np.ndarray]:
        part, offset, gone = repeated(keys[1:], parts, length)
        fresh = part >= known
        part, offset = part[fresh], offset[fresh]
        new = np.r_[True, (part[1:] != part[:-1]) | (offset[1:] > offset[:-1] + length)][: len(part)]
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(part)) - 1 if len(a) else a
        at = keys[:, part[a]]
        arrays = [at[1], at[2], at[3] + offset[a], at[3] + offset[b] + length]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["id", "t", "start", "stop"]), gone

    return rows.mapInArrow(run, f"{KEY}, start bigint, stop bigint")


def remove(texts: DataFrame, kind: str, id_col: str) -> DataFrame:
    """(id, n_bytes, spans, kept) of ``texts`` (id, text, covered)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = [], []
            for text, covered in zip(batch.column(1), batch.column(2), strict=True):
                text, runs, rest, at = text.as_py(), [], [], 0
                for c in covered.as_py() or ():  # sorted by start
                    if runs and c["start"] <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], c["stop"])
                    else:
                        runs.append(c)
                for r in runs:
                    rest.append(text[at : r["start"]])
                    at = r["stop"]
                found.append(runs)
                kept.append(b"".join([*rest, text[at:]]))
            arrays = [batch.column(0), pa.compute.binary_length(batch.column(1)).cast(pa.int64()), pa.array(found, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_bytes", "spans", "kept"])

    return texts.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, spans (start, stop: maximal removed runs, in bytes of UTF-8), kept (the remaining bytes).

    A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a document of smaller id, or before in the
    same document.  Matches don't cross documents, and strings are judged on the input, not on what is left.  A null or empty text
    has no bytes; a text shorter than ``length`` stays whole.  Ids are integers; a null id counts as the smallest.  Rows that share an id are
    documents ordered by a hash of their texts; rows that share id and text are one document and get the same result.
    Other columns don't matter.  Fragments are told apart by two hashes of 64 bits, of the anchor and of the whole.

    An anchor that very many different fragments share is resolved window by window, so what is sorted together stays bounded.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"ids of type {kind} aren't integers")
    if length < GRAM:
        raise ValueError(f"strings of fewer than {GRAM} bytes have no anchor")
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    texts = docs.select(docs[id_col].alias("own"), F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    with scratch(docs.sparkSession):
        found = materialise(firsts(anchors(texts.select("id", "t", "text"), length)), "fragments", keep=True)
        alone = found.where(~F.col("later"))
        hot = alone.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("hot"))
        wanted = alone.join(hot, "h", "left").groupBy("id", "t").agg(F.collect_list(F.struct("h", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
        some = bodies(texts.select("id", "t", "text").join(wanted, ["id", "t"]), length).repartition("route").sortWithinPartitions("route", "id", "t", "start")
        covered = sort_fragments(some, length).unionByName(found.where("later").select("id", "t", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop")))
        covered = covered.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("covered"))
        return remove(texts.join(covered, ["id", "t"], "left").select("own", "text", "covered"), kind, id_col)
