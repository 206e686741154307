"""Projection of alignments to another sequence of the multiple alignment, with runs of indels aligned anew.

Alignments meet *chunks*: for a window of the positions of a sequence, the blocks of it and of the target over that window and the
target's bases.  A window is twice as long as its step, and the step is at least as long as the alignment, so an alignment is worked on
with the one chunk its start falls in, and neither index nor reference is held as a whole anywhere.  Steps double from level to
level: a long alignment meets a long chunk and leaves those of the others as they are.  A group of alignments and its chunk are sent once, by cogroup;
a chunk of many alignments is dealt in several groups.
"""

from __future__ import annotations

import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import cigar as C
from ..functions.text import chr_of, seq_of
from ..schema import CIGAR_DDL
from .align import Scores
from .coordinates import positions_within, project_positions
from .filters import REVERSE, projectable
from .overlap import BIN
from .rewrite import CODE_OF, CODES, Chunk, Ops, realign, rewrite

STEP = 1024
#: Alignments worked on together at most, about.
GROUP = 20_000
RANGES = "array<struct<location:bigint,length:bigint>>"
KEY = ["chr", "seq_id", "level", "bin"]


#: One statement is analysed once, where as many DataFrame calls would each analyse all before them.
_CHUNKS = """
WITH windows AS (SELECT *, coalesce(bin * size, 0) AS w_lo, coalesce((bin + 2) * size, 0) AS w_hi FROM (SELECT chr, seq_id, level, bin, parts, {step} * CAST(pow(2, level) AS BIGINT) AS size FROM {wanted})),
own AS (SELECT chr, seq_id, seq_start, aln_start, len, explode(sequence(floor(seq_start / {width}), floor((seq_start + len - 1) / {width}))) AS b_bin FROM {blocks}),
grouped AS (
    SELECT w.chr, w.seq_id, level, bin, parts, sort_array(collect_set(struct(seq_start, aln_start, len))) AS src, min(aln_start + greatest(seq_start, w_lo) - seq_start) AS lo, max(aln_start + least(seq_start + len, w_hi) - 1 - seq_start) AS hi
    FROM (SELECT *, explode_outer(sequence(floor(w_lo / {width}), floor((w_hi - 1) / {width}))) AS b_bin FROM windows) w JOIN own b ON w.chr = b.chr AND w.seq_id = b.seq_id AND w.b_bin = b.b_bin AND seq_start < w_hi AND seq_start + len > w_lo
    GROUP BY w.chr, w.seq_id, level, bin, parts),
target AS (
    SELECT chr, seq_start AS t_seq, aln_start AS t_aln, len AS t_len, coalesce(lead(aln_start) OVER (PARTITION BY chr ORDER BY aln_start), aln_start + len) AS t_next, lag(aln_start) OVER (PARTITION BY chr ORDER BY aln_start) IS NULL AS t_first
    FROM {blocks} WHERE seq_id = {target}),
spread AS (SELECT *, explode(sequence(CASE WHEN t_first THEN 0 ELSE floor(t_aln / {width}) END, floor((t_next - 1) / {width}))) AS a_bin FROM target),
dst AS (
    SELECT g.chr, seq_id, level, bin, sort_array(collect_set(CASE WHEN t_aln <= hi AND t_aln + t_len > lo THEN struct(t_seq, t_aln, t_len) END)) AS dst,
        max(CASE WHEN t_aln <= lo THEN t_seq + least(lo - t_aln, t_len) END) AS before, max(CASE WHEN t_aln <= hi THEN t_seq + least(hi - t_aln, t_len) END) AS after
    FROM (SELECT *, explode(sequence(floor(lo / {width}), floor(hi / {width}))) AS a_bin FROM grouped) g JOIN spread t ON g.chr = t.chr AND g.a_bin = t.a_bin GROUP BY g.chr, seq_id, level, bin),
ends AS (SELECT chr, max(seq_start + len) AS t_end FROM {blocks} WHERE seq_id = {target} GROUP BY chr),
placed AS (
    SELECT g.*, coalesce(dst, array()) AS dst, CASE WHEN bits.before IS NOT NULL THEN bits.before WHEN bits.chr IS NULL THEN t_end ELSE 0 END AS before, CASE WHEN bits.after IS NOT NULL THEN bits.after WHEN bits.chr IS NULL THEN t_end ELSE 0 END AS after
    FROM grouped g LEFT JOIN dst bits ON g.chr = bits.chr AND g.seq_id = bits.seq_id AND g.level = bits.level AND g.bin = bits.bin JOIN ends ON g.chr = ends.chr),
pieces AS (
    SELECT name AS chr, piece, greatest(piece * {step}, start) AS begin, substring(seq, CAST(greatest(piece * {step}, start) - start + 1 AS INT), CAST((piece + 1) * {step} - greatest(piece * {step}, start) AS INT)) AS text
    FROM (SELECT *, explode(sequence(floor(start / {step}), floor((start + length(seq) - 1) / {step}))) AS piece FROM {reference} WHERE length(seq) > 0)),
texts AS (
    SELECT p.chr, seq_id, level, bin, sort_array(collect_list(struct(begin, text))) AS texts FROM (SELECT chr, seq_id, level, bin, explode(sequence(floor(before / {step}), floor(after / {step}))) AS piece FROM placed) p
    JOIN pieces t ON p.chr = t.chr AND p.piece = t.piece GROUP BY p.chr, seq_id, level, bin)
SELECT p.chr, p.seq_id, p.level, p.bin, parts, src, dst, before, coalesce(array_join(transform(texts, x -> x.text), ''), '') AS bases, coalesce(texts[0].begin, 0) AS base_start
FROM placed p LEFT JOIN texts t ON p.chr = t.chr AND p.seq_id = t.seq_id AND p.level = t.level AND p.bin = t.bin"""


def chunks(wanted: DataFrame, blocks: DataFrame, reference: DataFrame, target: str, step: int = STEP) -> DataFrame:
    """``wanted`` (chr, seq_id, level, bin, parts) with src, dst, before, bases, base_start of the window [bin * size, (bin + 2) * size), size = step * 2 ** level.

    A column of the target belongs to the last block that begins at or before it, so each block is spread over the bins of columns up to the
    next one, the first from column 0; columns in bins after the last block have all bases of the target before them.
    """
    if "start" not in reference.columns:
        reference = reference.select("name", F.lit(0).cast("long").alias("start"), "seq")
    return wanted.sparkSession.sql(_CHUNKS, wanted=wanted, blocks=blocks, reference=reference, target=target, step=step, width=BIN)


def blocks_array(items: list[dict]) -> np.ndarray:
    return np.array([tuple(x.values()) for x in items], np.int64).reshape(-1, 3)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed at every level, as Python may give them."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    return T.MapType(kind.keyType, nullable(kind.valueType)) if isinstance(kind, T.MapType) else kind


def flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, null as empty, and where each begins; taken from Arrow's own buffers."""
    texts = pa.compute.fill_null(column, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends[:-1] - ends[0]


def cigar_ops(column: pa.Array) -> Ops:
    owner = np.repeat(np.arange(len(column)), pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    items = column.flatten()
    ops, at = joined_bytes(items.field("op"))
    if len(ops) != len(items) or (at != np.arange(len(items))).any():
        raise ValueError("an operation of a CIGAR isn't one letter")
    return Ops(owner, items.field("n").to_numpy(zero_copy_only=False).astype(np.int64), CODE_OF[ops])


def lists(owner: np.ndarray, total: int, **fields: pa.Array) -> pa.ListArray:
    """A list for each of ``total`` owners of structs of the fields."""
    offsets = pa.array(np.searchsorted(owner, np.arange(total + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def project_cigars(df: DataFrame, blocks: DataFrame, reference: DataFrame, target: str, gap_open: float = 0, gap_extend: float = -1, use_qualities: bool = False, anew: bool = True, step: int = STEP, group: int = GROUP, columns: Collection[str] | None = None) -> DataFrame:
    """``df`` (chr, seq_id, pos, cigar, seq, qual and other columns) with dst_pos, dst_cigar, ref_ranges, query_ranges.

    ``columns`` names those of all these that are wanted beside chr and seq_id, as Spark tells a Python stage nothing of pruning: others aren't
    shuffled or sent back.  All alignments are worked on whatever is wanted.

    ``blocks`` is the index, ``reference`` (name, seq and, if in pieces, start) the target's bases for each chromosome, ``target`` its sequence
    id.  A sequence or target that the index lacks, and an alignment that doesn't lie within its sequence, are errors that name them.
    """
    length = C.reference_length(F.col("cigar")).cast("long")
    wanted = lambda c: columns is None or c in columns
    kept = [c for c in df.columns if c not in ("chr", "seq_id") and wanted(c)]
    sent = [c for c in df.columns if c in kept or c in ("cigar", "seq") or (c == "qual" and use_qualities and anew)]
    reads = df.select("chr", "seq_id", F.col("pos").cast("long").alias("at"), F.coalesce(length, F.lit(0)).alias("of"), *sent).where("chr IS NOT NULL AND seq_id IS NOT NULL AND at IS NOT NULL")
    reads = positions_within(reads, blocks, "chr", "seq_id", "at", "of", target)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("of", F.lit(1)) / step))).cast("int")
    size = F.lit(step) * F.pow(F.lit(2), F.col("level")).cast("long")
    reads = reads.withColumn("level", level).withColumn("bin", F.coalesce(F.floor(F.col("at") / size), F.lit(0)))
    # keys without nulls, and chunks that carry ``parts``: so both uses of the counts have one plan, and the alignments are read once for them
    counts = reads.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    # of n alignments at most n / group chunks are deep, so these are few whatever the index's size and the alignments are shuffled once
    dealt = reads.join(F.broadcast(counts.where("parts > 1")), KEY, "left")
    hashed = F.xxhash64("at", *[f.name for f in df.schema if f.name in sent and "map<" not in f.dataType.simpleString()])
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(hashed, F.col("parts")).cast("int"))
    dealt = dealt.select(*KEY, part.alias("part"), "at", *sent)
    made = chunks(counts, blocks, reference, target, step).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    made = made.select(*[F.col(c).alias(f"c_{c}") for c in made.columns])
    new = [f for f in T.StructType.fromDDL(f"dst_pos bigint, dst_cigar {CIGAR_DDL}, ref_ranges {RANGES}, query_ranges {RANGES}") if wanted(f.name)]
    schema = T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in [*(df.schema[c] for c in kept), *T.StructType.fromDDL("chr string, seq_id string"), *new]])
    arrow = to_arrow_schema(schema)
    scores = Scores(gap_open, gap_extend)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = right.slice(0, 1).to_pylist()[0]
        chunk = Chunk(blocks_array(c["c_src"]), blocks_array(c["c_dst"]), c["c_before"], c["c_bases"].encode(), c["c_base_start"])
        starts, total = left["at"].to_numpy(), len(left)
        reads, read_at = joined_bytes(flat(left["seq"]))
        first, ops = rewrite(cigar_ops(flat(left["cigar"])), starts, reads, read_at, chunk)
        none = np.zeros(0, np.int64)
        mine, on_ref, gone, on_read, added = none, none, none, none, none
        if anew:
            quality = [np.frombuffer(q.encode(), np.uint8).astype(np.int64) - 33 if q and q != "*" else None for q in left["qual"].to_pylist()] if use_qualities else None
            ops, mine, on_ref, gone, on_read, added = realign(ops, first, reads, read_at, quality, chunk, scores)
        out = left.select([*kept, "chr", "seq_id"])
        made_here = {
            "dst_pos": lambda: pa.array(first, pa.int64()),
            "dst_cigar": lambda: lists(ops.owner, total, n=pa.array(ops.n.astype(np.int32)), op=pa.array(list(CODES)).take(pa.array(ops.op))),
            "ref_ranges": lambda: lists(mine, total, location=pa.array(on_ref), length=pa.array(gone)),
            "query_ranges": lambda: lists(mine, total, location=pa.array(on_read), length=pa.array(added)),
        }
        for f in new:
            out = out.append_column(f.name, made_here[f.name]())
        return out.cast(arrow)

    return dealt.groupBy(*KEY, "part").cogroup(made.groupBy(*[f"c_{c}" for c in (*KEY, "part")])).applyInArrow(run, schema)


def original_alignment(rname: Column, pos: Column, flag: Column, cigar: Column, mapq: Column, nm: Column, before: Column, one_based: bool = True) -> Column:
    """The OA tag with one more alignment: ``RNAME,POS,strand,CIGAR,MAPQ,NM;``."""
    strand = F.when(flag.bitwiseAND(F.lit(REVERSE)) != 0, "-").otherwise("+")
    entry = F.concat(F.concat_ws(",", rname, (pos + (1 if one_based else 0)).cast("string"), strand, C.render(cigar), mapq.cast("string"), F.coalesce(nm.cast("string"), F.lit(""))), F.lit(";"))
    return F.concat(F.coalesce(before, F.lit("")), entry)


def flat_ranges(ranges: Column) -> Column:
    """[start, end, start, end, ...] of (location, length) items."""
    return F.flatten(F.transform(ranges, lambda x: F.array(x["location"], x["location"] + x["length"])))


def project_mates(df: DataFrame, blocks: DataFrame, target: str, separator: str = "/", strict: bool = False) -> DataFrame:
    """Adds ``mate_chr`` and ``mate_pos``: the mate's place on the target, by the mate's own sequence; null without one.

    A mate on a sequence that the index lacks, or beyond its end, has a null place or, if ``strict``, is an error that names it.
    """
    has = F.col("rnext").isNotNull() & F.col("pnext").isNotNull()
    df = df.withColumn("mate_chr", F.when(has, chr_of(F.col("rnext"), separator))).withColumn("mate_seq", F.when(has, seq_of(F.col("rnext"), separator))).withColumn("mate_at", F.when(has, F.col("pnext").cast("long"))).withColumn("mate_dst", F.lit(target))
    if strict:
        df = positions_within(df, blocks, "mate_chr", "mate_seq", "mate_at", None, target)
    met = project_positions(df, blocks, "mate_chr", "mate_seq", "mate_dst", "mate_at", "mate_pos")
    return met.drop("mate_seq", "mate_at", "mate_dst", "aln", "dst_gap")


#: Columns of project_alignments() and what each is made of, beside the places that every alignment needs.
PROJECTED = {
    "rec_idx": ("rec_idx",), "qname": ("qname",), "flag": ("flag",), "rname": (), "pos": ("dst_pos",), "mapq": ("mapq",), "cigar": ("dst_cigar",), "rnext": (), "pnext": (), "seq": ("seq",), "qual": ("qual",),
    "o_rname": ("rname",), "o_pos": ("pos",), "o_rnext": (), "o_pnext": (), "oa": ("rname", "pos", "flag", "cigar", "mapq", "oa_nm", "oa_before"), "xb": ("query_ranges",), "yb": ("ref_ranges",),
}


def project_alignments(df: DataFrame, blocks: DataFrame, reference: DataFrame, target: str, separator: str = "/", columns: Collection[str] | None = None, **how) -> DataFrame:
    """Alignments on the target: new rname, pos, cigar, rnext, pnext, the original places (o_rname, o_pos, o_rnext, o_pnext), oa, and the ranges
    aligned anew as flat arrays (xb on the read, yb on the target).  Rows that projectable() drops are left out; a read or mate on a sequence that
    the index lacks or beyond its end, and a chromosome without the target, are errors that name them.

    ``columns`` names those that are wanted (all, if None): each alignment is projected and checked all the same, but what only others need isn't
    shuffled or sent through Python."""
    if odd := [c for c in columns or () if c not in PROJECTED]:
        raise ValueError(f"projection has no columns {odd}")
    columns = [c for c in PROJECTED if columns is None or c in columns]
    needed = {"rec_idx", "rnext", "pnext"}.union(*(PROJECTED[c] for c in columns))
    df = projectable(df).withColumn("chr", chr_of(F.col("rname"), separator)).withColumn("seq_id", seq_of(F.col("rname"), separator))
    if "oa" in columns:
        value = lambda n: F.regexp_extract(F.try_element_at("tags", F.lit(n)), ":(.*)$", 1) if "tags" in df.columns else F.lit(None).cast("string")
        df = df.withColumns({"oa_nm": value("NM"), "oa_before": value("OA")})
    met = project_mates(project_cigars(df, blocks, reference, target, columns=needed, **how), blocks, target, separator, strict=True)
    made = {
        "rname": "chr", "pos": "dst_pos", "cigar": "dst_cigar", "rnext": "mate_chr", "pnext": "mate_pos", "o_rname": "rname", "o_pos": "pos", "o_rnext": "rnext", "o_pnext": "pnext",
    }
    longer = {
        "oa": lambda: original_alignment(F.col("rname"), F.col("pos"), F.col("flag"), F.col("cigar"), F.col("mapq"), F.col("oa_nm"), F.col("oa_before")),
        "xb": lambda: flat_ranges(F.col("query_ranges")),
        "yb": lambda: flat_ranges(F.col("ref_ranges")),
    }
    return met.select(*[(longer[c]() if c in longer else F.col(made.get(c, c))).alias(c) for c in columns])


#: Default names of the tags that keep where an alignment came from.
PROVENANCE = {"o_rname": "XR", "o_pos": "XP", "o_rnext": "YR", "o_pnext": "YP", "xb": "XB", "yb": "YB", "rec_idx": "XI"}


def provenance_tags(projected: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Sets ``tags`` from the columns of project_alignments(): original and mate places (0-based), ranges aligned anew as [start, end) numbers, and
    the record's index; a column whose name is empty is left out."""
    from ..functions.text import with_tags

    names = PROVENANCE | (names or {})
    for n in names.values():
        if n and not re.fullmatch("[XYZ][A-Za-z0-9]", n):
            raise ValueError(f"{n} is not a tag name for local use")
    text = {c: F.concat(F.lit("Z:"), c) for c in ("o_rname", "o_rnext")} | {c: F.concat(F.lit("i:"), F.col(c).cast("string")) for c in ("o_pos", "o_pnext", "rec_idx")}
    text |= {c: F.when(F.size(c) > 0, F.concat(F.lit("B:I,"), F.array_join(c, ","))) for c in ("xb", "yb")}
    tags = F.col("tags") if "tags" in projected.columns else F.lit(None).cast("map<string,string>")
    return projected.withColumn("tags", with_tags(tags, **{n: text[c] for c, n in names.items() if n}))


def realigned_ranges(projected: DataFrame) -> DataFrame:
    """Distinct (rname, location, length) on the target, in order."""
    pair = F.explode(F.sequence(F.lit(0), F.size("yb") - 1, F.lit(2)))
    each = projected.where(F.size("yb") > 0).select("rname", "yb", pair.alias("k"))
    return each.select("rname", F.get("yb", F.col("k")).alias("location"), (F.get("yb", F.col("k") + 1) - F.get("yb", F.col("k"))).alias("length")).distinct().orderBy("rname", "location", "length")
