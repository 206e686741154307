"""Operator 6: near duplicates by fast similarity sketching, banding and exact verification.

A document is its set of word shingles, as 64-bit hashes.  Its sketch has a fixed number of bins.  In a round every element
is hashed to a bin and a value, and a bin keeps the least value of the first round that reached it;
rounds go on until all bins are filled, and in the last rounds element and round alone name the bin, so that every
coordinate fills.  Two sketches agree in a coordinate with the probability of the sets' similarity, with concentration
bounds as strong as those of independent samples.  Groups of coordinates (bands) give bucket keys; there are so many bands that a
linked pair shares none with a probability of at most ``miss``.  Links are confirmed on the full sets of the shingles
themselves, not of hashes.

Texts with the same words in a row (by a cryptographic digest) are one node.  A bucket never expands into its pairs: its members meet one leader first, then only members
outside the bucket's largest component become leaders, for members of other components that they can be linked with by a bound on sizes and shared elements.  A pair of different
components that shares a bucket is compared unless that bound rules it out, so the components are those of all candidates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, scratch, text_slices
from .components import components
from .hashing import finish

BATCH_BYTES = 1 << 19
#: A sketch has at most so many bins.
MAX_BINS = 360
#: Shared elements are counted in so many classes to bound what two sets can have in common.
CLASSES = 32
#: Partners of a text that are compared with it in one task.
PART = 4096
#: Parts of a bucket that choose leaders apart from each other.
SALTS = 64


def banding(threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the longest bands for which a pair at the threshold is missed with probability ``miss`` at most."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
        if rows * bands <= MAX_BINS or rows == 1:
            return bands, rows
    raise AssertionError


class Words(dict):
    """Numbers of words in a worker, and a 64-bit cryptographic hash of each; begun anew when there are more than LIMIT, which is below 2**20."""

    LIMIT = 100_000

    def __init__(self):
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
        self.hashes[n] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return n


WORDS = Words()


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, parted by ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(texts: list[list[bytes]], k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For the words of each text: sorted numbers of its distinct k-word shingles, and a 64-bit hash of each of these.

    Equal shingles, and only these, have equal numbers within a call, so sizes and intersections are exact; hashes are equal across calls.
    With fewer words the whole sequence is the one shingle.
    """
    if len(WORDS) > Words.LIMIT:
        WORDS.clear()
    flat = np.fromiter((WORDS[w] for t in texts for w in t), np.int64, sum(map(len, texts)))
    base, n = len(WORDS) + 1, len(flat)
    ends = np.cumsum([len(t) for t in texts])
    number = np.zeros(n, np.int64)
    top = 1  # numbers are below it
    for j in range(k):
        if top * base >= 2**62:
            found, number = np.unique(number, return_inverse=True)
            top = len(found)
        number = number * base
        number[: max(0, n - j)] += flat[j:] + 1
        top *= base
    numbers, hashes = [], []
    for stop, size in zip(ends.tolist(), map(len, texts), strict=True):
        start = stop - size
        if size >= k:
            value, first = np.unique(number[start : stop - k + 1], return_index=True)
            at = flat[start + first[:, None] + np.arange(k)]
        elif size:
            value, at = None, flat[None, start:stop]
        else:
            value, at = np.zeros(0, np.int64), np.zeros((0, 1), np.int64)
        h = np.full(len(at), finish(np.uint64([at.shape[1]]), 6))
        for j in range(at.shape[1]):
            h = finish(h ^ WORDS.hashes[at[:, j]], 7)
        numbers.append(value)
        hashes.append(h)
    # sequences shorter than k words are numbered apart, by themselves
    short = {}
    for i, t in enumerate(texts):
        if numbers[i] is None:
            numbers[i] = np.array([-1 - short.setdefault(tuple(t), len(short))], np.int64)
    return numbers, hashes


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of ``bins`` coordinates for each set; those of an empty set are all ones."""
    empty = np.uint64(2**64 - 1)
    out = np.full((len(sets), bins), empty)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner, items = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    flat = out.ravel()
    for turn in range(2 * bins):
        if not len(items):
            break
        h = finish(items, 100 + turn)
        value = (np.uint64(turn) << np.uint64(48)) | (h >> np.uint64(16))
        bin_ = (h % np.uint64(bins)).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(flat, owner * bins + bin_, value)
        open_ = (out == empty).any(axis=1)[owner]
        owner, items = owner[open_], items[open_]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band of each sketch."""
    grouped = sketches.reshape(len(sketches), bands, rows)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(sketches), axis=0)
    for r in range(rows):
        key = finish(key ^ finish(grouped[:, :, r], 11), 12)
    return key.view(np.int64)


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, sha, n, digest, keys) of (id, sha, text) rows: the digest is of the sequence of words; without words there are neither digest nor keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 2, BATCH_BYTES):
                words = [words_of(t) for t in texts]
                sets = shingles(words, k)[1]
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                keys = band_keys(sketch(sets, bands * rows), bands, rows)
                digest = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0))))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(digest, pa.binary()), lists], ["id", "sha", "n", "digest", "keys"])

    return docs.mapInArrow(run, "id long, sha binary, n long, digest binary, keys array<long>")


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    The text of ``a`` is sent once for each part of its partners, theirs once a pair; a task reads them as a stream, ``a`` first, so no group is held.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).where("parts > 1")
    parted = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).alias("part"))
    right = parted.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "part", "b", "text")
    left = parted.select("a", "part").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    met = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in batches:
            for part, some in text_slices(batch, 3, BATCH_BYTES):
                words = [words_of(t) for t in some]
                left, right = part.column(0).to_pylist(), part.column(2).to_pylist()
                if leader is not None:  # of the rows before
                    words, left, right = [leader, *words], [None, *left], [None, *right]
                sets = shingles(words, k)[0]
                a, b = [], []
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    if y is None:
                        leader, own = words[i], sets[i]
                        continue
                    small, large = sorted((len(own), len(sets[i])))
                    if 100 * small < percent * large:
                        continue
                    both = len(np.intersect1d(own, sets[i], assume_unique=True))
                    if 100 * both >= percent * (small + large - both):
                        a.append(x)
                        b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def common_sizes(texts: DataFrame, k: int) -> DataFrame:
    """(node, n, c, h0, h1, ...) of (node, text) rows: the size of the shingle set, how many of it any other row seems to have too, and these by CLASSES of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in text_slices(batch, 1, BATCH_BYTES):
                sets = shingles([words_of(t) for t in some], k)[1]
                nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in text_slices(batch, 1, BATCH_BYTES):
                table = np.array([np.bincount((s % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES) for s in shingles([words_of(t) for t in some], k)[1]])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(table[:, c]) for c in range(CLASSES))], ["node", *(f"t{c}" for c in range(CLASSES))])

    texts = texts.select("node", "text")
    each = texts.mapInArrow(run, "node long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("node"))
    kind = F.pmod(F.col("shingle"), F.lit(CLASSES))  # of the signed hash: CLASSES is a power of two
    alone = each.where("rows = 1").groupBy("node").agg(*[F.sum((kind == c).cast("int")).alias(f"a{c}") for c in range(CLASSES)])
    every = texts.mapInArrow(count, "node long, " + ", ".join(f"t{c} long" for c in range(CLASSES))).join(alone, "node", "left")
    shared = [F.col(f"t{c}") - F.coalesce(f"a{c}", F.lit(0)) for c in range(CLASSES)]
    total = lambda cols: sum(cols[1:], cols[0])
    return every.select("node", total([F.col(f"t{c}") for c in range(CLASSES)]).alias("n"), total(shared).alias("c"), *(x.alias(f"h{c}") for c, x in enumerate(shared)))


def size_class(n):
    """Sizes by steps of about two per cent."""
    return F.floor(F.log2(n.cast("double")) * 32).cast("int")


def near_components(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that share a bucket with another one.  ``nodes``: (node, id, sha, n, keys); ``texts``: (id, sha, text), in which a node is found by id and sha.

    After the first leaders, buckets with several components remain.  There a pair must still be compared unless it can't be linked:
    two sets differ at least in the elements that no other open node has, and in each class of hashes by the difference of the
    counts of the others.  If that is over (100 - percent) / (100 + percent) of n + n', they can't be linked.  Sizes that can
    meet are met by size class.
    """
    placed = nodes.select("node", F.explode("keys").alias("key"))
    leaders = placed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader < other").select("key", "leader")
    members = materialise(placed.join(leaders, "key"), "buckets")
    of = nodes.select("node", "id", "sha").join(members.select("node").distinct(), "node", "left_semi")
    texts = materialise(texts.join(of, ["id", "sha"]).select("node", "text"), "bucket-texts")
    if texts.count() > of.count():  # rows equal in id and text
        texts = materialise(texts.dropDuplicates(["node"]), "bucket-texts")
    label = members.select("node").distinct().withColumn("component", F.col("node"))
    sizes = nodes.select("node", "n")
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(sizes.withColumnsRenamed({"node": "a", "n": "m"}), "a").join(sizes.withColumnRenamed("node", "b"), "b")
    pairs = pairs.where((100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n"))).select("a", "b")
    led = members.select("key", F.col("leader").alias("node")).distinct()
    seen, turn = None, 0
    while True:
        pairs = materialise(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        links = linked(pairs, texts, k, percent)
        if turn:  # between components so far
            links = links.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(materialise(links, "links")).withColumnRenamed("component", "into").withColumnRenamed("node", "component")
        label = label.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        label = materialise(label, "labels")
        turn += 1
        now = members.select("key", "node").join(label, "node")
        parts = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        parts = parts.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main")
        now = materialise(now.join(parts, "key"), "members")
        if turn == 1:
            open_ = texts.join(now.select("node").distinct(), "node", "left_semi")
            counted = materialise(common_sizes(open_, k), "common")
            members = now.select("key", "node")
        now = materialise(now.join(counted, "node"), "members")
        low, high = F.ceil(F.col("n") * percent / 100), F.floor(F.col("c") * (100 + percent) / percent) - F.col("n")
        outside = now.where("component <> main").join(led, ["key", "node"], "left_anti").withColumn("low", low).withColumn("high", F.least(high, F.floor(F.col("n") * 100 / percent))).where("low <= high")
        # a share of the leaders from each of SALTS parts, so that a large bucket is not one task
        salted = Window.partitionBy("key", F.pmod(F.xxhash64("node"), F.lit(SALTS))).orderBy("node")
        some = outside.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= max(1, 16**turn // SALTS))
        some = materialise(some.select("key", F.col("node").alias("leader"), F.col("component").alias("own"), F.col("n").alias("own_n"), F.col("c").alias("own_c"), "low", "high", *(F.col(f"h{c}").alias(f"own_h{c}") for c in range(CLASSES))), "leaders")
        if not some.limit(1).count():
            return label
        led = materialise(led.unionByName(some.select("key", F.col("leader").alias("node"))), "led")
        some = some.withColumn("size", F.explode(F.sequence(size_class(F.greatest("low", F.lit(1))), size_class(F.col("high")))))
        apart = F.col("n") - F.col("c") + F.col("own_n") - F.col("own_c")
        for c in range(CLASSES):
            apart = apart + F.abs(F.col(f"h{c}") - F.col(f"own_h{c}"))
        can = F.col("n").between(F.col("low"), F.col("high")) & (F.col("component") != F.col("own")) & (apart * (100 + percent) <= (F.col("n") + F.col("own_n")) * (100 - percent))
        now = now.withColumn("size", size_class(F.col("n")))
        met = some.alias("s").join(now.alias("m"), (F.col("s.key") == F.col("m.key")) & (F.col("s.size") == F.col("m.size")) & can)
        pairs = met.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()


def judged(docs: DataFrame, k: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """id, sha (SHA-256 of the text), n, component, kept of each row; see near_duplicates()."""
    bands, rows = banding(percent / 100, miss)
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    texts = texts.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text")
    with scratch(docs.sparkSession):
        found = materialise(sketched(texts, k, bands, rows), "sketches")
        first = F.min(F.struct("id", "sha"))
        nodes = found.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(first.alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "first.id", "first.sha", "n", "keys"), "nodes")
        label = near_components(nodes.drop("digest"), texts, k, percent)
        of = nodes.select("digest", "node", "id").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = of.groupBy("component").agg(F.min("id").alias("least"))
        of = of.join(least, "component").select("digest", "least")
        out = found.select("id", "sha", "n", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(of, "digest", "left")
        component = F.coalesce("least", "id")
        return materialise(out.select("id", "sha", "n", component.alias("component"), component.eqNullSafe(F.col("id")).alias("kept")), "near-duplicates", keep=True)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (the smallest id reachable over links), kept (id = component_id).

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets.  A null, empty or blank text has
    no shingles and is linked with nothing; with fewer than ``k`` words the whole sequence is the one shingle.  A row with
    a null id takes no part: its component is null and it is kept.  Rows that repeat an id are judged by their own
    texts.  Texts are used whole, compared exactly, and no bucket is capped.
    """
    out = judged(docs, k, percent, miss, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns that stand for their group of near duplicates: the one with the least id, then the least
    digest of its text.  Rows equal in both all stay, and so do those with a null id.
    """
    rows = judged(docs, k, percent, miss, id_col, text_col).where("kept")
    empty = rows.where("n = 0 OR id IS NULL").select("id", "sha")
    kept = rows.where("n > 0 AND id IS NOT NULL").groupBy("id", "component").agg(F.min("sha").alias("sha")).select("id", "sha").unionByName(empty)
    kept = kept.select(F.col("id").alias("__kept_id"), F.col("sha").alias("__kept_sha"))
    sha = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256))
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col("__kept_id")) & (sha == F.col("__kept_sha")), "left_semi")
