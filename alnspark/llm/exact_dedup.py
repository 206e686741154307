"""Operator 10: exact deduplication against a persistent digest index.

The index is a table of (digest, keep_id, group_size, batch), bucketed and sorted by digest.  A batch is reduced
to its distinct digests first, those already in the index are removed by a sort-merge anti-join, the rest
is appended.  The joins read the index bucket by bucket without shuffling it.

Each digest of the index belongs to the batch that brought it.  What a batch appends is only what the index lacks, and what it keeps
are the digests that are its own; so a job that fails at any point, even amid the append, and is run again as the same batch
completes the append and gets the answer of the first run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, scratch

SCHEMA = "digest binary, keep_id {id}, group_size long, batch string"
#: A group with at least one row in HOT_SHARE of a batch is joined by broadcast: there are at most HOT_SHARE of them.
HOT_SHARE = 2000
HOT_LEAST = 64


class DigestIndex:
    """A persistent index; the same name and path open it again in a later session's catalog.  Without a path it is a managed table of the warehouse.

    One job at a time may add to an index.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            at = f" LOCATION '{path}'" if path else ""
            spark.sql(f"CREATE TABLE {name} ({SCHEMA.format(id=id_type)}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{at}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the groups whose digest the index lacks as those of ``batch``.  ``groups`` must be written already: else the
        optimizer moves the anti-join below their aggregation, and all rows of a hot digest meet in a task.
        """
        new = materialise(groups.join(self.table().hint("merge"), "digest", "left_anti").select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")), "new-digests")
        writer = new.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the text with A-Z lower-cased, null as empty."""
    text = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    return docs.select(docs[id_col].alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def fingerprint(batch: DataFrame) -> str:
    """The same for the same (id, digest) rows in any order."""
    h = F.xxhash64("id", "digest")
    n, x, t = batch.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first()
    return f"rows-{n}-{(x or 0) & (2**64 - 1):016x}-{t or 0}"


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; a null text equals the empty one.  Of equal texts in
    the batch the row with the largest id stays.  If ``index`` holds the digest from another batch, no
    row stays and keep_id and group_size are those of the index.  A null id loses against any other; rows that share
    the largest id and the text are all marked kept, since nothing tells them apart.  Without ``index`` the rows meet a new one, which is
    dropped once the result is written.

    ``batch`` names the rows; run again under that name they get the same answer.  By default the name is drawn from the rows.

    A digest with a large share of the batch is met by broadcast (a number of groups that HOT_SHARE bounds), the others by
    a sort-merge join, so no task gets a hot group.
    """
    spark = docs.sparkSession
    with scratch(spark):
        rows = materialise(digests(docs, id_col, text_col), "digests")
        own = index is None
        if own:
            index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", id_type=rows.schema["id"].dataType.simpleString())
        batch = batch or fingerprint(rows)
        groups = materialise(rows.groupBy("digest").agg(F.max("id").alias("own_id"), F.count(F.lit(1)).alias("own_size")), "groups")
        index.add(groups.select("digest", F.col("own_id").alias("keep_id"), F.col("own_size").alias("group_size")), batch)
        known = index.table().join(groups.select("digest", "own_size").hint("merge"), "digest")
        known = materialise(known.select("digest", "keep_id", "group_size", "own_size", (F.col("batch") == batch).alias("is_new")), "known")
        least = max(HOT_LEAST, rows.count() // HOT_SHARE)
        large, small = known.where(F.col("own_size") >= least), known.where(F.col("own_size") < least)
        rest = rows.join(F.broadcast(large.select("digest")), "digest", "left_anti")
        found = rest.join(small.hint("merge"), "digest").unionByName(rows.join(F.broadcast(large), "digest"))
        found = found.select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("is_new") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
        found = materialise(found, "exact-dedup", keep=True)
        if own:
            index.drop()
    return found


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns that exact_dedup() keeps."""
    kept = exact_dedup(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col(id_col).alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    sha = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256)
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("__kept_id")) & (sha == F.col("__kept_sha")), "left_semi")
