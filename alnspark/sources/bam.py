"""BAM: a Python data source that reads records, a file split where its index says that records begin, and writes a file a partition."""

from __future__ import annotations

import io
import operator
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..schema import ALIGNMENTS
from .bgzf import BlockStream, content, exists, located

#: Fixed values of the format.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
FIXED = struct.Struct("<iiBBHHHiiii")
SCALARS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
#: The bin of an index that holds counts rather than chunks.
COUNTS_BIN = 37450
#: Levels of nested bins: the first bin of a level and the bits of its width; positions end at 2^29.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
LINEAR = 14
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

#: Bytes of a block before compression; qualities as letters.
BLOCK_BYTES = 60_000
SHIFT = bytes((b + 33) & 255 for b in range(256))


def read_tags(data: bytes) -> dict[str, str]:
    """Tags as "type:value"; integers of all widths are i."""
    out, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[name] = f"A:{chr(data[at])}"
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            out[name] = f"{kind}:{data[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            one = struct.Struct(SCALARS[sub])
            values = [one.unpack_from(data, at + 5 + k * one.size)[0] for k in range(n)]
            out[name] = f"B:{sub}," + ",".join(map(str, values))
            at += 5 + n * one.size
        else:
            one = struct.Struct(SCALARS[kind])
            out[name] = f"{'f' if kind == 'f' else 'i'}:{one.unpack_from(data, at)[0]}"
            at += one.size
    return out


def write_tags(tags: dict[str, str] | None) -> bytes:
    out = b""
    for name, text in sorted((tags or {}).items()):
        kind, value = text.split(":", 1)
        head = name.encode() + kind.encode()
        if kind in "ZH":
            out += head + value.encode() + b"\0"
        elif kind == "A":
            out += head + value.encode()
        elif kind == "B":
            sub, *items = value.split(",")
            cast = float if sub == "f" else int
            out += head + sub.encode() + struct.pack("<i", len(items)) + b"".join(struct.pack(SCALARS[sub], cast(x)) for x in items)
        else:
            out += head + struct.pack(SCALARS[kind], float(value) if kind == "f" else int(value))
    return out


def read_header(stream) -> tuple[str, list[tuple[str, int]]]:
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.read(struct.unpack("<i", stream.read(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", stream.read(4))[0]))
    return text, refs


def read_records(stream: BlockStream, refs: list[tuple[str, int]], names: list[str], stop: int | None = None, wanted: Callable[[dict], bool] | None = None) -> Iterator[tuple]:
    """The named columns of the records before virtual offset ``stop`` whose fixed fields are ``wanted``; others aren't decoded.  rec_idx is a record's virtual offset."""
    name_of = lambda k: refs[k][0] if k >= 0 else None
    place = lambda k: k if k >= 0 else None
    while (at := stream.tell()) < (1 << 63 if stop is None else stop) and (head := stream.read(4)):
        data = stream.read(struct.unpack("<i", head)[0])
        ref, pos, n_name, q, _, n_ops, flag, n_seq, mate, mate_pos, tlen = FIXED.unpack_from(data)
        ops_at = FIXED.size + n_name
        seq_at = ops_at + 4 * n_ops
        qual_at = seq_at + (n_seq + 1) // 2
        got = {"rec_idx": at, "flag": flag, "rname": name_of(ref), "pos": place(pos), "mapq": q, "rnext": name_of(mate), "pnext": place(mate_pos), "tlen": tlen}
        if wanted and not wanted(got):
            continue
        if "qname" in names:
            name = data[FIXED.size : ops_at - 1].decode()
            got["qname"] = None if name == "*" else name
        if "cigar" in names:
            got["cigar"] = [Row(n=x >> 4, op=OPS[x & 15]) for x in struct.unpack_from(f"<{n_ops}I", data, ops_at)]
        if "seq" in names:
            got["seq"] = "".join(BASES[b >> 4] + BASES[b & 15] for b in data[seq_at:qual_at])[:n_seq] or None
        if "qual" in names:
            raw = data[qual_at : qual_at + n_seq]
            got["qual"] = None if not n_seq or raw[0] == 255 else raw.translate(SHIFT).decode()
        if "tags" in names:
            got["tags"] = read_tags(data[qual_at + n_seq :])
        yield tuple(got[n] for n in names)


@dataclass
class FileIndex:
    """A .bai: for each reference the chunks of each bin, and the first virtual offset of each window of 2^14 positions."""

    bins: list[dict[int, list[tuple[int, int]]]]
    linear: list[tuple[int, ...]]

    def starts(self) -> list[int]:
        """Virtual offsets at which a record begins: the starts of all chunks."""
        return sorted({a for of in self.bins for chunks in of.values() for a, _ in chunks})

    def chunks(self, ref: int, low: int | None, high: int | None) -> list[tuple[int, int]]:
        """Stretches, in order and apart, that hold the records of a reference that begin from ``low`` to ``high``; all its records if both are None."""
        if ref >= len(self.bins):
            return []
        of, least = self.bins[ref], 0
        if low is None and high is None:
            found = [c for chunks in of.values() for c in chunks]
        else:
            first, last = max(low or 0, 0), min((1 << LEVELS[0][1]) - 1 if high is None else high, (1 << LEVELS[0][1]) - 1)
            met = [range(base + (first >> bits), base + (last >> bits) + 1) for base, bits in LEVELS]
            found = [c for k, chunks in of.items() if any(k in r for r in met) for c in chunks] if first <= last else []
            windows = self.linear[ref]
            least = windows[first >> LINEAR] if first >> LINEAR < len(windows) else 0
        return apart([(a, b) for a, b in found if b > least])


def read_index(bai: bytes) -> FileIndex:
    if bai[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    at, all_bins, linear = 8, [], []
    for _ in range(struct.unpack_from("<i", bai, 4)[0]):
        (n_bins,) = struct.unpack_from("<i", bai, at)
        at, bins = at + 4, {}
        for _ in range(n_bins):
            bin_, n = struct.unpack_from("<Ii", bai, at)
            if bin_ != COUNTS_BIN:
                bins[bin_] = [struct.unpack_from("<QQ", bai, at + 8 + 16 * k) for k in range(n)]
            at += 8 + 16 * n
        (n,) = struct.unpack_from("<i", bai, at)
        linear.append(struct.unpack_from(f"<{n}Q", bai, at + 4))
        all_bins.append(bins)
        at += 4 + 8 * n
    return FileIndex(all_bins, linear)


def apart(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, cut so that none overlaps the ones before."""
    out, reached = [], 0
    for a, b in sorted(ranges):
        if b > max(a, reached):
            out.append((max(a, reached), b))
            reached = b
    return out


def next_block(file, at: int, size: int) -> int:
    """The first place from ``at`` on where a block begins, or the file's size: a block's head that another one or the end follows."""
    seen, start = b"", at
    while True:
        k = seen.find(END_BLOCK[:4])
        while k < 0 or k + 18 > len(seen):
            cut = len(seen) - 3 if k < 0 else k
            start, seen = start + max(cut, 0), seen[max(cut, 0) :]
            file.seek(start + len(seen))
            more = file.read(1 << 16)
            if not more:
                return size
            seen += more
            k = seen.find(END_BLOCK[:4])
        if seen[k + 12 : k + 14] == b"BC":
            after = start + k + struct.unpack_from("<H", seen, k + 16)[0] + 1
            file.seek(after)
            if after == size or file.read(4) == END_BLOCK[:4]:
                return start + k
        start, seen = start + k + 1, seen[k + 1 :]


def record_length(data: bytes | bytearray, at: int, refs: list[tuple[str, int]]) -> int | None:
    """Bytes of the record that could begin at ``at``, as far as what is there tells; None if none could, 0 if too little is there to tell."""
    if at + 4 + FIXED.size > len(data):
        return 0
    (length,) = struct.unpack_from("<i", data, at)
    ref, pos, n_name, _, _, n_ops, _, n_seq, mate, mate_pos, _ = FIXED.unpack_from(data, at + 4)
    for r, p in ((ref, pos), (mate, mate_pos)):
        if not -1 <= r < len(refs) or p < -1 or (r >= 0 and 0 < refs[r][1] <= p):
            return None
    if n_name < 1 or n_seq < 0 or length < FIXED.size + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq:
        return None
    name = data[at + 4 + FIXED.size : at + 4 + FIXED.size + n_name]
    if any(not 33 <= c <= 126 for c in name[: n_name - 1]) or (len(name) == n_name and name[-1]):
        return None
    ops_at = at + 4 + FIXED.size + n_name
    items = data[ops_at : ops_at + 4 * n_ops]
    if any(x & 15 >= len(OPS) for (x,) in struct.iter_unpack("<I", items[: len(items) // 4 * 4])):
        return None
    return 4 + length


def next_record(file, at: int, size: int, refs: list[tuple[str, int]], least: int = 8) -> int:
    """Virtual offset of the first record that begins in a block at or after byte ``at``; the file's end if there is none.

    A place is taken for one if ``least`` records follow each other from there, or all up to the end of the file.
    """
    block = next_block(file, at, size)
    while block < size:
        stream = BlockStream(file, block)
        stream.load()
        here, data, ended = len(stream.data), bytearray(stream.data), False
        for u in range(here):
            k, n = u, 0
            while n < least:
                length = record_length(data, k, refs)
                if length is None:
                    break
                if length and k + length <= len(data):
                    k, n = k + length, n + 1
                elif ended:
                    break
                elif stream.load():
                    data += stream.data
                else:
                    ended = True
                if ended and k == len(data):
                    n = least
            if n >= least:
                return block << 16 | u
        block = BlockStream(file, block).after()
    return size << 16


def names_and_places(filters: list[Filter]) -> tuple[set[str] | None, int | None, int | None]:
    """The reference names that filters leave, None for all, and the least and greatest position."""
    names, low, high = None, None, None
    for f in filters:
        column = f.attribute[0]
        if column == "rname" and isinstance(f, EqualTo | In):
            some = set(f.value) if isinstance(f, In) else {f.value}
            names = some if names is None else names & some
        if column == "pos" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            at = f.value + isinstance(f, GreaterThan)
            low = at if low is None else max(low, at)
        if column == "pos" and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            at = f.value - isinstance(f, LessThan)
            high = at if high is None else min(high, at)
    return names, low, high


#: Columns of a record's fixed part, and what filters on them ask.
FIXED_COLUMNS = ("flag", "rname", "pos", "mapq", "rnext", "pnext", "tlen")
ASKED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, some: x in some}


def answers(filters: list[Filter]) -> Callable[[dict], bool] | None:
    """Whether a record's fixed fields meet all filters; a null meets IsNull only."""
    nulls = [(f.attribute[0], isinstance(f, IsNull)) for f in filters if isinstance(f, IsNull | IsNotNull)]
    asked = [(f.attribute[0], ASKED[type(f)], f.value) for f in filters if type(f) in ASKED]
    return (lambda got: all((got[c] is None) == is_null for c, is_null in nulls) and all(got[c] is not None and ask(got[c], value) for c, ask, value in asked)) if filters else None


@dataclass
class Span(InputPartition):
    """Records of stretches of a file, from one virtual offset to another, each open where None; if ``sought``, from the first record at or after one byte to that of another."""

    path: str
    ranges: list[tuple[int | None, int | None]]
    sought: bool = False


class BamReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.paths, self.names, self.split = options["path"].split(","), names, int(options.get("splitBytes", 64 << 20))
        self.filters: list[Filter] = []

    def files(self) -> Iterator[str]:
        for path in self.paths:
            fs, at = located(path)
            if fs.get_file_info(at).type == pafs.FileType.Directory:
                found = sorted(f.path[len(at.rstrip("/")) + 1 :] for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.base_name.endswith(".bam"))
                yield from (f"{path.rstrip('/')}/{name}" for name in found if not any(x.startswith(("_", ".")) for x in name.split("/")))
            else:
                yield path

    def partitions(self) -> list[InputPartition]:
        names, low, high = names_and_places(self.filters)
        out: list[InputPartition] = []
        for path in self.files():
            if not exists(path + ".bai"):
                fs, at = located(path)
                cuts = list(range(self.split, fs.get_file_info(at).size, self.split))
                out += [Span(path, [(a, b)], sought=True) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]
                continue
            index = read_index(content(path + ".bai"))
            if names is None:
                cuts = []
                for start in index.starts():
                    if (start >> 16) - ((cuts[-1] if cuts else 0) >> 16) >= self.split:
                        cuts.append(start)
                out += [Span(path, [(a, b)]) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]
                continue
            fs, at = located(path)
            with fs.open_input_file(at) as file:
                _, refs = read_header(BlockStream(file))
            held = 0
            for a, b in apart(c for k, (name, _) in enumerate(refs) if name in names for c in index.chunks(k, low, high)):
                if not held:
                    out.append(Span(path, []))
                out[-1].ranges.append((a, b))
                held = held + (b >> 16) - (a >> 16) + 1
                held = 0 if held >= self.split else held
        return out

    def read(self, partition: Span | None) -> Iterator[tuple]:
        if partition is None:  # Spark's single partition where there are none
            return
        wanted = answers(self.filters)
        fs, at = located(partition.path)
        with fs.open_input_file(at) as file:
            stream = BlockStream(file)
            _, refs = read_header(stream)
            for start, stop in partition.ranges:
                if partition.sought:
                    first = stream.tell()
                    size = file.size()
                    start, stop = (None if x is None else max(first, next_record(file, x, size, refs)) for x in (start, stop))
                    stream = BlockStream(file, first >> 16, first & 0xFFFF)
                if start is not None:
                    stream = BlockStream(file, start >> 16, start & 0xFFFF)
                yield from read_records(stream, refs, self.names, stop, wanted)
                if partition.sought and stop is not None and stream.tell() != stop:
                    raise ValueError(f"{partition.path}: no record ends at {stop >> 16}; read it with its .bai or a larger splitBytes")


class PruningBamReader(BamReader):
    """A reader that answers filters itself: those on names and positions by the .bai, all on fixed fields before anything else of a record is decoded."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in (*ASKED, IsNull, IsNotNull) and f.attribute in [(c,) for c in FIXED_COLUMNS]:
                self.filters.append(f)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    name: str


class BamWriter(DataSourceWriter):
    """One file a partition, each with the header; files appear under their names when all are written."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"].rstrip("/"), options.get("header", ""), overwrite
        self.staged = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05}-{task.taskAttemptId()}-{self.staged[-8:]}.bam"
        fs, at = located(self.path)
        fs.create_dir(f"{at}/{self.staged}", recursive=True)
        refs = header_references(self.header)
        with fs.open_output_stream(f"{at}/{self.staged}/{name}", compression=None) as out:
            for block in bam_blocks(iterator, refs, self.header):
                out.write(block)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = located(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.base_name.endswith(".bam"):
                    fs.delete_file(f.path)
        for m in messages:
            if m is not None:
                fs.move(f"{at}/{self.staged}/{m.name}", f"{at}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = located(self.path)
        if fs.get_file_info(f"{at}/{self.staged}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.staged}")


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: files, folders of them, or a comma-separated list, on file systems that executors open.

    A file with its .bai beside it is split at record starts at least ``splitBytes`` apart, others at the first record that is found after each
    ``splitBytes``; a task whose records don't end where the next one's begin fails.  With ``.schema(...)`` only those columns of ALIGNMENTS are decoded.
    Option ``prune`` pushes filters down, see read_alignments().  ``df.write.format("bam").option("header", text).mode("append").save(path)`` writes.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return ALIGNMENTS

    def reader(self, schema) -> BamReader:
        kind = PruningBamReader if str(self.options.get("prune", "false")).lower() == "true" else BamReader
        return kind(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


def read_alignments(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Alignments of BAM files whose scan prunes rows: filters on flag, rname, pos, mapq, rnext, pnext and tlen are answered by the source.

    With a .bai, equality or membership in ``rname`` and bounds on ``pos`` read the chunks of the index only.  ``columns`` are those to decode, all if
    None.  Spark asks for a session setting to push filters to Python sources, which this turns on; sources without push-down aren't affected.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    schema = ALIGNMENTS if columns is None else StructType([ALIGNMENTS[c] for c in columns])
    return spark.read.format("bam").schema(schema).option("prune", "true").option("splitBytes", split_bytes).load(path)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files that only Spark's file systems reach: a file is a row of bytes up to 2 GB; the ``bam`` format has no such bound."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = ALIGNMENTS.fieldNames()

    def run(rows):
        for row in rows:
            stream = BlockStream(io.BytesIO(row["content"]))
            _, refs = read_header(stream)
            yield from read_records(stream, refs, names)

    return spark.createDataFrame(files.rdd.mapPartitions(run), ALIGNMENTS)


def bam_record(row: Row, index: dict[str, int]) -> bytes:
    name = (row["qname"] or "*").encode() + b"\0"
    seq = row["seq"] or ""
    codes = [BASES.find(c) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    qual = bytes(ord(c) - 33 for c in row["qual"]) if row["qual"] else b"\xff" * len(seq)
    ops = struct.pack(f"<{len(row['cigar'])}I", *(x["n"] << 4 | OPS.index(x["op"]) for x in row["cigar"]))
    pos = -1 if row["pos"] is None else row["pos"]
    mate = -1 if row["pnext"] is None else row["pnext"]
    length = sum(x["n"] for x in row["cigar"] if x["op"] in "M=XDN") or 1
    start, stop = max(pos, 0), max(pos, 0) + length - 1
    bin_ = next((base + (start >> shift) for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)) if start >> shift == stop >> shift), 0)
    fixed = FIXED.pack(index.get(row["rname"], -1), pos, len(name), 255 if row["mapq"] is None else row["mapq"], bin_, len(row["cigar"]), row["flag"], len(seq), index.get(row["rnext"], -1), mate, row["tlen"] or 0)
    data = fixed + name + ops + bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(codes), 2)) + qual + write_tags(row["tags"])
    return struct.pack("<i", len(data)) + data


def bgzf_block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header_references(header: str) -> list[tuple[str, int]]:
    """(name, length) of the @SQ lines."""
    lines = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in header.splitlines() if line.startswith("@SQ\t")]
    return [(f["SN"], int(f.get("LN", 0))) for f in lines]


def header_blocks(refs: list[tuple[str, int]], header: str) -> Iterator[bytes]:
    """Blocks that hold a BAM file's header and nothing else."""
    text = header.encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in refs)
    for k in range(0, len(head), BLOCK_BYTES):
        yield bgzf_block(head[k : k + BLOCK_BYTES])


def record_blocks(rows: Iterator[Row], index: dict[str, int]) -> Iterator[bytes]:
    """Blocks of records, each made as soon as it is full; ``index`` numbers the references."""
    block = bytearray()
    for row in rows:
        block += bam_record(row, index)
        if len(block) >= BLOCK_BYTES:
            full = len(block) // BLOCK_BYTES * BLOCK_BYTES
            yield from (bgzf_block(bytes(block[k : k + BLOCK_BYTES])) for k in range(0, full, BLOCK_BYTES))
            del block[:full]
    if block:
        yield bgzf_block(bytes(block))


def bam_blocks(rows: Iterator[Row], refs: list[tuple[str, int]], header: str) -> Iterator[bytes]:
    """The blocks of a BAM file."""
    yield from header_blocks(refs, header)
    yield from record_blocks(rows, {name: k for k, (name, _) in enumerate(refs)})
    yield END_BLOCK
