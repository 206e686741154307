"""Alignment statistics: counts, mapping qualities, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C

#: Positions of a contig whose coverage one task sums.
COVERAGE_BIN = 1 << 16


def count_by_contig(df: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_idx, name, n) for every reference of ``refs`` (ref_idx, name), in the header's order."""
    counts = df.groupBy(F.col("rname").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return refs.select("ref_idx", "name").join(counts, "name", "left").select("ref_idx", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy("ref_idx")


def mapq_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("mapq").agg(F.count(F.lit(1)).alias("n")).orderBy("mapq")


def mapq_box_plot(df: DataFrame, bin_width: int = 100_000) -> DataFrame:
    """Quantiles of the mapping quality for each bin of positions that has any; 255 (unavailable) is left out.  Quantiles are exact."""
    q = lambda p: F.percentile("mapq", F.lit(p))
    return (
        df.where("mapq <> 255 AND pos >= 0")
        .groupBy(F.floor(F.col("pos") / bin_width).alias("bin"))
        .agg(F.min("mapq").alias("min"), q(0.1).alias("q10"), q(0.25).alias("q25"), q(0.5).alias("med"), q(0.75).alias("q75"), q(0.9).alias("q90"), F.max("mapq").alias("max"), F.count(F.lit(1)).alias("n"))
    )


def coverage(df: DataFrame, include_clipping: bool = False, explicit_ends: bool = False, width: int = COVERAGE_BIN) -> DataFrame:
    """(rname, position, coverage) of every covered position.

    Reads are cut at bins of positions, so a bin is summed by itself and a long contig isn't one task.  Starts and ends
    are counted per position before they are shuffled.  ``explicit_ends`` also gives a row of 0 after each covered stretch.
    """
    end = F.col("pos") + C.record_length(F.col("cigar"), include_clipping)
    reads = df.select("rname", F.col("pos").cast("long").alias("s"), end.cast("long").alias("e")).where("s < e")
    cut = reads.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    begin, stop = F.greatest("s", F.col("bin") * width), F.least("e", (F.col("bin") + 1) * width)
    each = cut.select("rname", "bin", F.explode(F.array(F.struct(begin.alias("at"), F.lit(1).alias("d")), F.struct(stop.alias("at"), F.lit(-1).alias("d")))).alias("x"))
    change = each.groupBy("rname", "bin", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    within = Window.partitionBy("rname", "bin").orderBy("at")
    runs = change.withColumn("coverage", F.sum("d").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(within))
    out = runs.where("coverage > 0").select("rname", F.explode(F.sequence("at", F.col("next") - 1)).alias("position"), "coverage")
    if explicit_ends:
        ends = out.select("rname", F.explode(F.array(F.struct("position", F.lit(1).alias("has")), F.struct((F.col("position") + 1).alias("position"), F.lit(0).alias("has")))).alias("x"))
        ends = ends.groupBy("rname", F.col("x.position").alias("position")).agg(F.max("x.has").alias("has")).where("has = 0")
        out = out.unionByName(ends.select("rname", "position", F.lit(0).cast("long").alias("coverage")))
    return out


def merge_coverages(*tables: DataFrame) -> DataFrame:
    """Sum of coverage tables (rname, position, coverage) wherever any has a row."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("rname", "position").agg(F.sum("coverage").alias("coverage"))


def coverage_histogram(covered: DataFrame, length: int | None = None) -> DataFrame:
    """(coverage, n) for every value from 0 to the largest; with ``length`` the positions without a row count as 0."""
    counts = covered.groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("coverage").alias("top"), F.sum("n").alias("rows"))
    every = top.select("rows", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("coverage"))
    out = every.join(counts, "coverage", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if length is not None:
        out = out.withColumn("n", F.when(F.col("coverage") == 0, F.col("n") + F.lit(length) - F.col("rows")).otherwise(F.col("n")))
    return out.select("coverage", "n")


def coverage_at(variants: DataFrame, covered: DataFrame) -> DataFrame:
    """(chrom, position, coverage) at every reference base of the variants (chrom, pos, ref), 0 where there is none."""
    bases = variants.select("chrom", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.length("ref") - 1)).alias("position"))
    at = covered.select(F.col("rname").alias("chrom"), "position", "coverage")
    return bases.join(at, ["chrom", "position"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))
