"""Orders, runs of equal names, and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coordinate_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("rname").asc_nulls_last(), "pos", "rec_idx")


def coordinate_places(df: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Adds ``place``: 1, 2, ... of every row in the order of coordinate_sort(), over all references, null as the last one.

    Rows are numbered within ranges of positions; only the number of rows of each range meets in one place.
    """
    df = df.withColumn("slab", F.floor(F.col("pos") / width))
    slabs = df.groupBy("rname", "slab").agg(F.count("*").alias("n"))
    over = Window.partitionBy(F.lit(0)).orderBy(F.col("rname").asc_nulls_last(), "slab")  # a row a range
    slabs = slabs.withColumn("base", F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    slabs = slabs.select(F.col("rname").alias("slab_rname"), F.col("slab").alias("slab_no"), "base")
    out = df.join(slabs, F.col("rname").eqNullSafe(F.col("slab_rname")) & F.col("slab").eqNullSafe(F.col("slab_no")))
    within = Window.partitionBy("rname", "slab").orderBy("pos", "rec_idx")
    return out.withColumn("place", F.row_number().over(within) + F.col("base")).drop("slab", "slab_rname", "slab_no", "base")


def name_sort(df: DataFrame) -> DataFrame:
    """By read name: rows of a read stand together in one partition, as a later grouping by name wants them."""
    return df.repartition("qname").sortWithinPartitions("qname", "rec_idx")


def consecutive_runs(df: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Adds ``run``: 1, 2, ... for each maximal run of rows with the same read name, in the order of rec_idx.

    Rows are numbered within ranges of rec_idx; only the last name and the number of starts of each range meet in one place.
    """
    df = df.withColumn("slab", F.floor(F.col("rec_idx") / width))
    within = Window.partitionBy("slab").orderBy("rec_idx")
    df = df.withColumn("starts", (~F.col("qname").eqNullSafe(F.lag("qname").over(within)) | F.lag("rec_idx").over(within).isNull()).cast("long"))
    slabs = df.groupBy("slab").agg(F.sum("starts").alias("n"), F.min_by("qname", "rec_idx").alias("first"), F.max_by("qname", "rec_idx").alias("last"))
    over = Window.partitionBy(F.lit(0)).orderBy("slab")  # a row a range
    joins = F.coalesce(F.lag("slab").over(over).isNotNull() & F.col("first").eqNullSafe(F.lag("last").over(over)), F.lit(False))
    slabs = slabs.withColumn("own", F.col("n") - joins.cast("long")).withColumn("joins", joins)
    slabs = slabs.withColumn("base", F.sum("own").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    out = df.join(slabs.select("slab", "base"), "slab")
    run = F.sum("starts").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
    return out.withColumn("run", run).drop("slab", "starts", "base")


def unsorted(df: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Records that begin before the one before them on the same reference, in the order of rec_idx.

    Neighbours are compared within ranges of rec_idx; only the last record of each reference in a range meets those of other ranges.
    """
    slabbed = df.withColumn("slab", F.floor(F.col("rec_idx") / width))
    lasts = slabbed.groupBy("rname", "slab").agg(F.max_by("pos", "rec_idx").alias("last"))
    lasts = lasts.withColumn("carried", F.lag("last").over(Window.partitionBy("rname").orderBy("slab")))
    lasts = lasts.select(F.col("rname").alias("l_rname"), F.col("slab").alias("l_slab"), "carried")
    within = Window.partitionBy("rname", "slab").orderBy("rec_idx")
    met = slabbed.join(lasts, F.col("rname").eqNullSafe(F.col("l_rname")) & (F.col("slab") == F.col("l_slab")))
    before = F.when(F.row_number().over(within) == 1, F.col("carried")).otherwise(F.lag("pos").over(within))
    return met.withColumn("before", before).where("pos < before").select(*df.columns)


def distinct_union(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def concatenate(*tables: DataFrame) -> DataFrame:
    """All rows with ``part``, the place of their table."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("part", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out
