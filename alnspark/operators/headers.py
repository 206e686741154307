"""Header tables: references, programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chr_of, seq_of


def output_references(refs: DataFrame, target: str, order: DataFrame | None = None, separator: str = "/") -> DataFrame:
    """(out_idx, name, length) of the projected references.

    Input references (ref_idx, name, length) are called chromosome, separator, sequence.  Chromosomes in ``order`` (place, name) come
    first, names there that don't occur are skipped and repeated ones count once; the others follow as they first
    appear.  The length is that of the input whose sequence is ``target``, else null.
    """
    split = refs.select("ref_idx", "length", chr_of(F.col("name"), separator).alias("name"), seq_of(F.col("name"), separator).alias("seq"))
    found = split.groupBy("name").agg(F.min("ref_idx").alias("first"), F.max(F.when(F.col("seq") == target, F.col("length"))).alias("length"))
    if order is None:
        found = found.withColumn("place", F.lit(None).cast("long"))
    else:
        found = found.join(order.groupBy("name").agg(F.min("place").alias("place")), "name", "left")
    number = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col("place").asc_nulls_last(), "first"))  # a row a chromosome
    return found.select((number - 1).alias("out_idx"), "name", "length")


def reference_map(refs: DataFrame, out: DataFrame, separator: str = "/") -> DataFrame:
    """(ref_idx, name, chr, seq_id, out_idx) for each input reference."""
    split = refs.select("ref_idx", "name", chr_of(F.col("name"), separator).alias("chr"), seq_of(F.col("name"), separator).alias("seq_id"))
    return split.join(out.select(F.col("name").alias("chr"), "out_idx"), "chr").select("ref_idx", "name", "chr", "seq_id", "out_idx")


def append_program(programs: DataFrame, prefix: str, name: str, command: str, version: str) -> DataFrame:
    """Programs (place, id, name, command, version, previous) with one more: its id is ``prefix`` and one more than the largest
    number after it, and it follows the last one."""
    number = F.expr("try_cast(substr(id, length(p) + 1) AS INT)")
    rows = programs.withColumn("p", F.lit(prefix))
    new = rows.agg(
        (F.coalesce(F.max("place"), F.lit(-1)) + 1).alias("place"),
        F.concat(F.lit(prefix), (F.coalesce(F.max(F.when(F.col("id").startswith(prefix), number)), F.lit(0)) + 1).cast("string")).alias("id"),
        F.max_by("id", "place").alias("previous"),
    )
    new = new.select("place", "id", F.lit(name).alias("name"), F.lit(command).alias("command"), F.lit(version).alias("version"), "previous")
    return programs.unionByName(new)
