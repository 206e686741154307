"""Blocked gzip files: a stream that may begin at any block, on any file system that pyarrow opens."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases of one piece of a sequence, the unit of work of read_indexed_fasta().
PIECE = 1 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    fs, at = located(path)
    return fs.get_file_info(at).type == pafs.FileType.File


def indexed(path: str) -> bool:
    """Whether .fai and .gzi lie beside the file; False on a store that only Spark's readers open."""
    try:
        return exists(path + ".fai") and exists(path + ".gzi")
    except (pa.ArrowInvalid, OSError):
        return False


def content(path: str) -> bytes:
    fs, at = located(path)
    with fs.open_input_file(at) as file:
        return file.read()


class BlockStream:
    """Reads a blocked gzip file from a block's start; tell() is the virtual offset, block start and place in it, of the next byte."""

    def __init__(self, file, block: int = 0, skip: int = 0):
        self.file, self.start, self.next, self.data, self.at = file, block, block, b"", 0
        file.seek(block)
        if skip:
            self.load()
            self.at = skip

    def load(self) -> bool:
        head = self.file.read(12)
        self.start, self.data, self.at = self.next, b"", 0
        if not head:
            return False
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0]) if head[:4] == b"\x1f\x8b\x08\x04" else b""
        size, k = None, 0
        while k + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"BC":
                size = struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        if size is None:
            raise ValueError("not a blocked gzip file")
        body = self.file.read(size - 12 - len(extra))
        if len(body) < size - 12 - len(extra):
            raise ValueError("the file ends within a block")
        self.data = zlib.decompress(body[:-8], -15)
        self.next = self.start + size
        return True

    def after(self) -> int:
        """Where the block after the current one begins, or the file's end."""
        if not self.data:
            self.load()
        return self.next

    def tell(self) -> int:
        while self.at >= len(self.data) and self.load():
            pass
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        out = []
        while n > 0:
            if self.at >= len(self.data):
                if not self.load():
                    break
                continue
            some = self.data[self.at : self.at + n]
            self.at += len(some)
            n -= len(some)
            out.append(some)
        return b"".join(out)


def block_starts(gzi: bytes) -> list[tuple[int, int]]:
    """(uncompressed, compressed) block starts of a .gzi, the first block's included."""
    (n,) = struct.unpack_from("<Q", gzi)
    return sorted({(0, 0), *((b, a) for a, b in struct.iter_unpack("<QQ", gzi[8 : 8 + 16 * n]))})


def read_indexed_fasta(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(name, start, seq): pieces of the named sequences, or of all, of a bgzip FASTA with its .fai and .gzi beside it.

    Only the blocks that hold a piece are read, each piece by its own task's seek; an error names sequences the index lacks.
    """
    from .text import read_fai

    fai = read_fai(spark, path + ".fai")
    if names is not None:
        wanted = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
        lacks = F.when(F.col("length").isNull(), F.raise_error(F.concat(F.lit("the index has no sequence "), "name"))).otherwise(F.col("length"))
        fai = wanted.join(fai, "name", "left").withColumn("length", lacks)
    step = F.greatest(F.lit(1), F.floor(F.lit(PIECE) / F.greatest("line_bases", F.lit(1)))) * F.greatest("line_bases", F.lit(1))
    pieces = fai.withColumn("step", step).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.col("step"))))
    line = F.floor(F.col("start") / F.greatest("line_bases", F.lit(1)))  # pieces begin with a line
    pieces = pieces.select("name", "start", (F.col("offset") + line * F.col("line_width")).alias("at"), F.least("step", F.col("length") - F.col("start")).alias("n"), "line_bases", "line_width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = block_starts(content(path + ".gzi"))
        fs, where = located(path)
        with fs.open_input_file(where) as file:
            for batch in batches:
                for r in batch.to_pylist():
                    begin, block = starts[bisect_right(starts, (r["at"], 1 << 62)) - 1]
                    stream = BlockStream(file, block)
                    stream.read(r["at"] - begin)
                    ends = (r["n"] - 1) // r["line_bases"] * (r["line_width"] - r["line_bases"]) if r["n"] else 0
                    seq = stream.read(r["n"] + ends).translate(None, b"\r\n").decode()
                    if len(seq) != r["n"]:
                        raise ValueError(f"{path} doesn't fit its index at {r['name']}")
                    yield pa.RecordBatch.from_arrays([pa.array([r["name"]]), pa.array([r["start"]], pa.int64()), pa.array([seq])], ["name", "start", "seq"])

    return pieces.repartition("name", "start").mapInArrow(run, "name string, start long, seq string")
