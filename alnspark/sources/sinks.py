"""Text forms of tables, and writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.text import ungapped
from ..schema import ALIGNMENTS


def wrapped(seq: Column, width: int) -> Column:
    """A newline after every ``width`` letters; 0 keeps one line."""
    return F.regexp_replace(seq, f"(.{{{width}}})", "$1\n") if width else seq


def fasta_records(aligned: DataFrame, width: int = 60) -> DataFrame:
    """(fasta): ``>chr/seq_id`` and the bases without gaps, wrapped."""
    return aligned.select(F.concat(F.lit(">"), "chr", F.lit("/"), "seq_id", F.lit("\n"), wrapped(ungapped(F.col("seq")), width)).alias("fasta"))


def write_fasta(sequences: DataFrame, path: str, width: int = 0) -> None:
    """Sequences (name, seq) as FASTA text."""
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.col("seq"), width)).alias("value")).write.text(path)


def sam_lines(df: DataFrame) -> DataFrame:
    """(value): alignments as SAM lines; positions become 1-based, nulls their marks."""
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    one = lambda c: (F.coalesce(F.col(c), F.lit(-1)) + 1).cast("string")
    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    rnext = F.when(F.col("rnext").isNotNull() & (F.col("rnext") == F.col("rname")), "=").otherwise(star("rnext"))
    fields = [star("qname"), F.col("flag").cast("string"), star("rname"), one("pos"), F.coalesce(F.col("mapq"), F.lit(255)).cast("string"), C.render(F.col("cigar")), rnext, one("pnext"), F.coalesce(F.col("tlen"), F.lit(0)).cast("string"), star("seq"), star("qual")]
    return df.select(F.array_join(F.concat(F.array(*fields), tags), "\t").alias("value"))


def header_lines(refs: DataFrame, programs: DataFrame | None = None, order: str = "unsorted", groups: DataFrame | None = None, comments: DataFrame | None = None) -> DataFrame:
    """(value): the header of references (ref_idx, name, length), read groups (place, id, fields), programs and comments (place, text), as read_sam_header() gives them."""
    first = refs.sparkSession.createDataFrame([(0, 0, f"@HD\tVN:1.6\tSO:{order}")], "part int, k long, value string")
    lines = refs.select(F.lit(1).alias("part"), F.col("ref_idx").cast("long").alias("k"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.coalesce("length", F.lit(0)).cast("string")).alias("value"))
    out = first.unionByName(lines)
    opt = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\t{tag}:"), c)).otherwise(F.lit(""))
    if groups is not None:
        rest = F.transform(F.array_sort(F.map_entries(F.map_filter("fields", lambda k, _: k != "ID"))), lambda e: F.concat(F.lit("\t"), e["key"], F.lit(":"), e["value"]))
        out = out.unionByName(groups.select(F.lit(2).alias("part"), F.col("place").cast("long").alias("k"), F.concat(F.lit("@RG\tID:"), "id", F.array_join(rest, "")).alias("value")))
    if programs is not None:
        out = out.unionByName(programs.select(F.lit(3).alias("part"), F.col("place").cast("long").alias("k"), F.concat(F.lit("@PG\tID:"), "id", opt("PN", "name"), opt("CL", "command"), opt("VN", "version"), opt("PP", "previous")).alias("value")))
    if comments is not None:
        out = out.unionByName(comments.select(F.lit(4).alias("part"), F.col("place").cast("long").alias("k"), F.concat(F.lit("@CO\t"), "text").alias("value")))
    return out.orderBy("part", "k").select("value")


def header_text(*args, **how) -> str:
    """header_lines() as one text; a header has a line a reference, group, program and comment."""
    return "".join(r["value"] + "\n" for r in header_lines(*args, **how).collect())


def write_sam(df: DataFrame, refs: DataFrame, path: str, programs: DataFrame | None = None, order: str = "unsorted", groups: DataFrame | None = None, comments: DataFrame | None = None) -> None:
    """Alignments as SAM files, one a partition, each with the whole header."""
    head = header_text(refs, programs, order, groups, comments).removesuffix("\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    sam_lines(df).mapInArrow(run, "value string").write.text(path)


def write_bam(df: DataFrame, refs: DataFrame, path: str, programs: DataFrame | None = None, order: str = "unsorted", groups: DataFrame | None = None, comments: DataFrame | None = None) -> None:
    """Alignments as BAM files, one a partition, each with the whole header."""
    from .bam import BamSource

    head = header_text(refs, programs, order, groups, comments)
    df.sparkSession.dataSource.register(BamSource)
    df.select(*ALIGNMENTS.fieldNames()).write.format("bam").option("header", head).mode("append").save(path)


def write_split(df: DataFrame, path: str) -> None:
    """Alignments with a target, one folder of Parquet for each; ``split_bam.write_split_bam`` writes BAM."""
    df.where("target IS NOT NULL").write.partitionBy("target").parquet(path)


def write_index(blocks: DataFrame, path: str) -> None:
    """Fails where there is an index already."""
    blocks.write.mode("errorifexists").parquet(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header)


def write_bed(regions: DataFrame, path: str) -> None:
    write_tsv(regions.select("chr", "lb", "rb"), path, header=False)


def report_lines(variants: DataFrame, support: DataFrame) -> DataFrame:
    """(var_id, part, value): V lines of variant_rows() and R lines of supporting_reads(), an empty allele as ``<DEL>``; those of a variant belong together in order of part."""
    v = variants.select("var_id", F.lit(0).alias("part"), F.concat_ws("\t", F.lit("V"), "chrom", F.col("pos").cast("string"), "ids", "ref", "alts", F.col("zygosity").cast("string"), F.col("is_reversed").cast("string")).alias("value"))
    r = support.select("var_id", F.lit(1).alias("part"), F.concat_ws("\t", F.lit("R"), F.col("n").cast("string"), F.when(F.col("allele") == "", "<DEL>").otherwise(F.col("allele"))).alias("value"))
    return v.unionByName(r)


def write_report(variants: DataFrame, support: DataFrame, counters: DataFrame, path: str, files: int | None = None) -> None:
    """A support report as text files in order: the V line of each variant by chromosome and position with its R lines, then the lines of ``counters``.

    Lines are dealt by ranges of variants, so those of a variant stand together in one file whatever the number of files.
    """
    place = variants.select("var_id", "chrom", "pos")
    lines = report_lines(variants, support).join(place, "var_id").withColumn("tail", F.lit(0))
    last = counters.select(F.lit(None).cast(lines.schema["var_id"].dataType).alias("var_id"), F.lit(2).alias("part"), F.concat_ws("\t", "line", "metric", F.col("n").cast("string")).alias("value"))
    last = last.withColumn("chrom", F.lit(None).cast("string")).withColumn("pos", F.lit(None).cast("long")).withColumn("tail", F.lit(1))
    key = ["tail", "chrom", "pos", "var_id"]
    dealt = lines.unionByName(last)
    dealt = dealt.repartitionByRange(files, *key) if files else dealt.repartitionByRange(*key)
    dealt.sortWithinPartitions(*key, "part", "value").select("value").write.text(path)
