"""Subsets of alignments and their distribution to targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_read_id(df: DataFrame, names: DataFrame) -> DataFrame:
    """Alignments of the reads in ``names`` (qname)."""
    return df.join(names.select("qname").distinct(), "qname", "left_semi")


def best_mapq(df: DataFrame, may_repeat: bool = False) -> DataFrame:
    """For each read its first record of the best mapping quality (255 counts as none) and the best record at that one's mate position.

    Without any quality the first record stands for the read and it has no mate here.  ``may_repeat`` lets a record be its own mate,
    where its mate position is its own.
    """
    read = Window.partitionBy("qname")
    known = F.when(F.col("mapq") != 255, F.col("mapq"))
    df = df.withColumn("is_best", F.col("mapq") == F.coalesce(F.max(known).over(read), F.lit(0)))
    first = F.row_number().over(read.orderBy(F.col("is_best").desc(), "rec_idx"))
    df = df.withColumn("place", first)
    chosen = df.where("place = 1").select("qname", F.col("rec_idx").alias("c_idx"), F.col("rnext").alias("c_rnext"), F.col("pnext").alias("c_pnext"))
    at = df.join(chosen, "qname").where("rname = c_rnext AND pos = c_pnext" + ("" if may_repeat else " AND rec_idx <> c_idx"))
    mate = Window.partitionBy("qname")
    at = at.withColumn("m_best", F.coalesce(F.max(known).over(mate), F.lit(0))).where("mapq = m_best")
    at = at.withColumn("m_place", F.row_number().over(mate.orderBy("rec_idx"))).where("m_place = 1")
    names = [c for c in df.columns if c not in ("is_best", "place")]
    return df.where("place = 1").select(*names, F.lit("best").alias("role")).unionByName(at.select(*names, F.lit("mate").alias("role")))


def reference_names(df: DataFrame) -> DataFrame:
    """Sorted distinct reference names in use."""
    return df.where("rname IS NOT NULL").select(F.col("rname").alias("name")).distinct().orderBy("name")


def targets_of(names: DataFrame, wanted: DataFrame, prefix: bool = False) -> DataFrame:
    """(rname, target, new_name): for each name in use the one of ``wanted`` (name, new_name) that it equals or begins with.

    A name in use that several wanted prefixes fit is an error, as is a repeated wanted name.  Names in use are far fewer than
    alignments, so prefixes are expanded on this side and joined by equality.
    """
    wanted = wanted.select(F.col("name").alias("target"), "new_name")
    if prefix:
        cuts = F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.substring(F.col("name"), F.lit(1), k)))
        used = names.select(F.col("name").alias("rname"), cuts.alias("target"))
    else:
        used = names.select(F.col("name").alias("rname"), F.col("name").alias("target"))
    found = used.join(wanted, "target")
    clash = F.count(F.lit(1)).over(Window.partitionBy("rname"))
    checked = F.when(clash == 1, F.col("target")).otherwise(F.raise_error(F.concat(F.lit("several targets for "), F.col("rname"))))
    return found.select("rname", checked.alias("target"), "new_name")


def split_by_reference(df: DataFrame, wanted: DataFrame, prefix: bool = False) -> DataFrame:
    """Alignments with the ``target`` they go to and their name there (``new_name`` where given); others have no target.  A mate's name is changed alike."""
    has_mate = "rnext" in df.columns
    used = df.select(F.explode(F.array("rname", "rnext")).alias("name")) if has_mate else df.select(F.col("rname").alias("name"))
    where = targets_of(used.where("name IS NOT NULL").distinct(), wanted, prefix)
    out = df.join(where, "rname", "left").withColumn("rname", F.coalesce("new_name", "rname")).drop("new_name")
    if has_mate:
        out = out.join(where.select(F.col("rname").alias("rnext"), "new_name"), "rnext", "left").withColumn("rnext", F.coalesce("new_name", "rnext")).drop("new_name")
    return out.select(*df.columns, "target")


def renamed_references(refs: DataFrame, wanted: DataFrame, prefix: bool = False) -> DataFrame:
    """References (ref_idx, name, length) under the names that split_by_reference() gives; those that come to share one are one, in the first's place and with the greatest length."""
    where = targets_of(refs.select("name"), wanted, prefix).select(F.col("rname").alias("name"), "new_name")
    named = refs.join(where, "name", "left").select("ref_idx", F.coalesce("new_name", "name").alias("name"), "length")
    return named.groupBy("name").agg(F.min("ref_idx").alias("ref_idx"), F.max("length").alias("length")).select("ref_idx", "name", "length")


def target_counts(split: DataFrame, wanted: DataFrame) -> DataFrame:
    """(target, n) for every wanted name, 0 where nothing matched."""
    counts = split.where("target IS NOT NULL").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return wanted.select(F.col("name").alias("target")).join(counts, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("n"))
