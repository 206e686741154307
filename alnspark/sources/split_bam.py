"""Alignments dealt to BAM files by target: part files from all tasks, listed by one manifest, and if asked one file a target."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from ..schema import ALIGNMENTS
from .bam import END_BLOCK, BamWriter, header_blocks, header_references, record_blocks
from .bgzf import content, located

MANIFEST = "_manifest.json"
COPY_BYTES = 1 << 22


def file_name(target: str) -> str:
    """The target as one component of a path that isn't hidden."""
    name = quote(target, safe="")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in (".", "_") else name


@dataclass
class Parts(WriterCommitMessage):
    """(target, name below the path, rows, bytes of the header) of the files of a task."""

    files: list[tuple[str, str, int, int]]


class SplitBamWriter(BamWriter):
    """A file for each target of a partition, whose rows are ordered by target; files and manifest appear when all are written."""

    def write(self, iterator: Iterator[Row]) -> Parts:
        task = TaskContext.get()
        fs, at = located(self.path)
        refs = header_references(self.header)
        index = {name: k for k, (name, _) in enumerate(refs)}
        head = b"".join(header_blocks(refs, self.header))
        files = []
        for target, rows in itertools.groupby(iterator, key=lambda r: r["target"]):
            name = f"{file_name(target)}/part-{task.partitionId():05}-{task.taskAttemptId()}-{self.staged[-8:]}.bam"
            if files and name in {f[1] for f in files}:
                raise ValueError(f"rows of {target} aren't together")
            fs.create_dir(f"{at}/{self.staged}/{file_name(target)}", recursive=True)
            count = itertools.count()
            with fs.open_output_stream(f"{at}/{self.staged}/{name}", compression=None) as out:
                out.write(head)
                for block in record_blocks((r for r, _ in zip(rows, count, strict=False)), index):
                    out.write(block)
                out.write(END_BLOCK)
            files.append((target, name, next(count), len(head)))
        return Parts(files)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, at = located(self.path)
        fs.create_dir(at, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        for target in {f[0] for f in files}:
            fs.create_dir(f"{at}/{file_name(target)}", recursive=True)
        for _, name, _, _ in files:
            fs.move(f"{at}/{self.staged}/{name}", f"{at}/{name}")
        with fs.open_output_stream(f"{at}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([dict(zip(("target", "name", "rows", "head"), f, strict=True)) for f in sorted(files)]).encode())
        self.abort(messages)


class SplitBamSource(DataSource):
    """``df.write.format("bam_by_target").option("header", text).mode("append").save(path)`` for alignments with a target, ordered by it within partitions."""

    @classmethod
    def name(cls) -> str:
        return "bam_by_target"

    def schema(self) -> StructType:
        return StructType(ALIGNMENTS.fields).add("target", StringType())

    def writer(self, schema, overwrite: bool) -> SplitBamWriter:
        return SplitBamWriter(self.options, overwrite)


def manifest(path: str) -> list[dict]:
    """Files of a split: target, name, rows, head (bytes before the first record)."""
    return json.loads(content(f"{path.rstrip('/')}/{MANIFEST}"))


def write_split_bam(split: DataFrame, header: str, path: str, targets: list[str] | None = None, basename: str = "", single: bool = False, files: int | None = None) -> None:
    """Alignments with a target as BAM, those of a target in the order of their input; rows without one are left out.  The path must be new.

    Rows are dealt by ranges of target and record, so a target that most rows share is many part files, ``path/<target>/part-*.bam``, each whole
    with its header.  ``single`` joins them to ``path/<basename><target>.bam``: a task a target copies the compressed blocks of its parts, without reading records.
    ``targets`` without rows get a file with the header only.  Names are escaped where they aren't fit for a path.
    """
    spark = split.sparkSession
    path = path.rstrip("/")
    fs, at = located(path)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} exists")
    spark.dataSource.register(SplitBamSource)
    rows = split.where("target IS NOT NULL").select(*ALIGNMENTS.fieldNames(), "target")
    key = ["target", "rec_idx"]
    dealt = rows.repartitionByRange(files, *key) if files else rows.repartitionByRange(*key)
    dealt.sortWithinPartitions(*key).write.format("bam_by_target").option("header", header).mode("append").save(path)
    if single:
        join_parts(spark, header, path, targets or [], basename)
    else:
        held = {f["target"] for f in manifest(path)}
        for target in set(targets or []) - held:
            fs.create_dir(f"{at}/{file_name(target)}", recursive=True)
            with fs.open_output_stream(f"{at}/{file_name(target)}/part-empty.bam", compression=None) as out:
                out.write(b"".join(header_blocks(header_references(header), header)) + END_BLOCK)


def join_parts(spark: SparkSession, header: str, path: str, targets: list[str], basename: str = "") -> None:
    """One file a target from the parts that the manifest lists, which are removed once all are joined."""
    parts = manifest(path)
    listed = [(f["target"], f["name"], f["head"]) for f in parts] + [(t, None, None) for t in sorted(set(targets) - {f["target"] for f in parts})]
    if not listed:
        return
    of = spark.createDataFrame(listed, "target string, name string, head long").groupBy("target").agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "head")))).alias("parts"))
    begin = b"".join(header_blocks(header_references(header), header))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = located(path)
        for batch in batches:
            for r in batch.to_pylist():
                whole = f"{at}/{basename}{file_name(r['target'])}.bam"
                staged = f"{at}/_temporary-{TaskContext.get().taskAttemptId()}-{file_name(r['target'])}"
                with fs.open_output_stream(staged, compression=None) as out:
                    out.write(begin)
                    for p in r["parts"]:
                        with fs.open_input_file(f"{at}/{p['name']}") as part:
                            left = part.size() - p["head"] - len(END_BLOCK)
                            part.seek(p["head"])
                            while left > 0:
                                some = part.read(min(left, COPY_BYTES))
                                out.write(some)
                                left -= len(some)
                    out.write(END_BLOCK)
                fs.move(staged, whole)
                yield pa.RecordBatch.from_arrays([pa.array([r["target"]])], ["target"])

    of.repartition(len({t for t, _, _ in listed}), "target").mapInArrow(run, "target string").write.format("noop").mode("overwrite").save()
    fs, at = located(path)
    for f in fs.get_file_info(pafs.FileSelector(at)):
        if f.base_name.startswith("_temporary-"):  # of attempts that were lost
            fs.delete_file(f.path)
    for name in {file_name(f["target"]) for f in parts}:
        fs.delete_dir(f"{at}/{name}")
    fs.delete_file(f"{at}/{MANIFEST}")
