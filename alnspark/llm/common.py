"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in the sense of the query contracts: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset; a temporary folder is then set for the life of the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that the driver and all executors share")
        base = getattr(scratch_dir, "_local", None)
        if base is None:
            base = scratch_dir._local = tempfile.mkdtemp(prefix="alnspark-")
    return base.rstrip("/")


#: Paths of the tables written within the innermost scratch().
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage at files that outlive any executor.  Within scratch() they are removed at its end unless ``keep``; others
    stay: whoever reads a lazy result needs them until it is written, and their retention belongs to the cluster.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep and WRITTEN.get() is not None:
        WRITTEN.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what materialise() writes within it, on leaving.  Results must be written with ``keep`` before."""
    token = WRITTEN.set([])
    try:
        yield
    finally:
        paths = WRITTEN.get()
        WRITTEN.reset(token)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(hadoop).delete(path, True)


def text_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``limit`` bytes of text each, or one longer row, and their texts, null as empty.

    Spark bounds a batch by bytes; only a slice of it is held as Python strings at once.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in spans(sizes, int, limit):
        part = batch.slice(a, b - a)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def spans(items: list, size, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive [from, to) slices of ``items`` of about ``limit`` in total ``size`` each."""
    start = total = 0
    for k, item in enumerate(items):
        n = size(item) + 1
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(items):
        yield start, len(items)


def pieces(text: str, limit: int, ends: tuple[re.Pattern, ...]) -> Iterator[tuple[int, int]]:
    """[from, to) of pieces of at least ``limit`` and at most twice as many characters, but for the last: cut after the first match of the first pattern that has one there, or anywhere."""
    at = 0
    while len(text) - at > 2 * limit:
        to = at + limit
        to = next((m.end() for p in ends if (m := p.search(text, to, to + limit))), to)
        yield at, to
        at = to
    yield at, len(text)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0.  Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
