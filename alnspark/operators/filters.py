"""Row filters on alignments and variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SAM flag bits.
PAIRED, UNMAPPED, REVERSE, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = 1, 4, 16, 256, 512, 1024, 2048
PROJECTION_MASK = UNMAPPED | FAILED | DUPLICATE
COUNTING_MASK = PROJECTION_MASK | SUPPLEMENTARY
#: The tags that a projection keeps.
KEPT_TAGS = "AM AS BC BZ CB CO CR CS CT CY E2 FZ LB MI ML MM OA OQ OX PG PU QT QX RX TS".split()


def without_flags(mask: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(mask)) == 0


def countable(df: DataFrame, primary_only: bool = False) -> DataFrame:
    """Alignments used by counting and statistics."""
    return df.where(without_flags(COUNTING_MASK | (SECONDARY if primary_only else 0)))


def projectable(df: DataFrame) -> DataFrame:
    """Alignments used by projection: mapped, passing, no duplicate, with a reference, a position and a sequence."""
    return df.where(without_flags(PROJECTION_MASK) & F.col("rname").isNotNull() & (F.col("pos") >= 0) & (F.length("seq") > 0))


def projection_counters(df: DataFrame) -> DataFrame:
    """How many alignments each filter of projectable() drops; the first that applies counts."""
    flags = ~without_flags(PROJECTION_MASK)
    no_ref, no_pos = F.col("rname").isNull(), F.col("pos").isNull() | (F.col("pos") < 0)
    no_seq = F.coalesce(F.length("seq"), F.lit(0)) == 0
    why = F.when(flags, "flags").when(no_ref, "no_reference").when(no_pos, "no_position").when(no_seq, "no_sequence").otherwise("kept")
    return df.select(why.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def on_contig(df: DataFrame, contig: str | None = None, prefix: str | None = None) -> DataFrame:
    return df.where(F.col("rname") == contig if prefix is None else F.col("rname").startswith(prefix))


def rname_class(rname: Column, names: Sequence[str], prefix: bool = False) -> Column:
    """Index of the last of ``names`` that the reference name equals (or begins with), null if none."""
    fits = [F.when(rname.startswith(n) if prefix else rname == n, F.lit(k)) for k, n in enumerate(names)]
    return F.coalesce(*reversed(fits)) if fits else F.lit(None).cast("int")


def in_classes(df: DataFrame, names: Sequence[str], prefix: bool = False, same_ref: bool = False) -> DataFrame:
    """Alignments to any of the names, with ``ref_class``; ``same_ref`` wants the mate in the same class."""
    df = df.withColumn("ref_class", rname_class(F.col("rname"), names, prefix)).where("ref_class IS NOT NULL")
    return df.where(rname_class(F.col("rnext"), names, prefix) == F.col("ref_class")) if same_ref else df


def mate_on(df: DataFrame, contig: str | None = None, prefix: str | None = None) -> DataFrame:
    """Alignments whose mate is on the wanted references too."""
    return df.where(F.col("rnext") == contig if prefix is None else F.col("rnext").startswith(prefix))


def with_zygosity(variants: DataFrame, z: int) -> DataFrame:
    """Variants with ``z`` alleles other than the reference (a missing allele is one); a negative number keeps all."""
    return variants if z < 0 else variants.where(F.size(F.filter("gt", lambda a: a.isNull() | (a != 0))) == z)


def keep_tags(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    kept = [*KEPT_TAGS, *more]
    return df.withColumn("tags", F.map_filter("tags", lambda k, v: k.isin(*kept)))


def removed_tags(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """How often each tag is removed by keep_tags()."""
    each = df.select(F.explode(F.map_keys("tags")).alias("tag"))
    return each.where(~F.col("tag").isin(*KEPT_TAGS, *more)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def exclude_contigs(sequences: DataFrame, excluded: DataFrame) -> DataFrame:
    """Sequences (name, seq) whose name is not among ``excluded`` (name)."""
    return sequences.join(excluded.select("name").distinct(), "name", "left_anti")
