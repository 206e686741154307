"""Mapping qualities recalculated for each read from the scores of all its alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import UNMAPPED, without_flags

NO_NEXT = 255
#: For each least difference to the next score (as a share of the range), the least share of the score and its quality.
DIFFERENCE_TABLE = {
    0.0: ((0.0, 2), (0.67, 6)),
    0.1: ((0.0, 0), (0.67, 7), (0.88, 12), (1.0, 30)),
    0.2: ((0.0, 0), (0.67, 11), (0.88, 17), (1.0, 31)),
    0.3: ((0.0, 3), (0.67, 15), (0.88, 18), (1.0, 32)),
    0.4: ((0.0, 4), (0.68, 14), (0.84, 21), (1.0, 34)),
    0.5: ((0.0, 5), (0.68, 16), (0.84, 25), (1.0, 35)),
    0.6: ((0.0, 22), (1.0, 36)),
    0.7: ((0.0, 26), (1.0, 37)),
    0.8: ((0.0, 27), (1.0, 38)),
    0.9: ((0.0, 33), (1.0, 39)),
}
#: Least share of the score and quality of a read with a single alignment.
UNIQUE_TABLE = ((0.0, 0), (0.3, 3), (0.4, 8), (0.5, 23), (0.6, 24), (0.7, 40), (0.8, 42))


def floor_lookup(table, key: Column, value) -> Column:
    """CASE over descending thresholds."""
    (first, x), *rest = sorted(table, key=lambda t: -t[0])
    out = F.when(key >= first, value(x))
    for t, x in rest:
        out = out.when(key >= t, value(x))
    return out


def least_score(length: Column) -> Column:
    """Score of a barely valid alignment of a read of this length; 0 for no read."""
    return F.when(length == 0, F.lit(0.0)).otherwise(F.lit(-0.6) + F.lit(-0.6) * length)


def mapq(length: Column, mate_length: Column, score: Column, next_score: Column, unique_table: bool = False) -> Column:
    """Quality of an alignment (or a pair with its summed score); ``next_score`` is null without another alignment.

    The next score counts as the least valid one at worst, so a single alignment is judged by its distance from that; ``unique_table``
    uses the table for single alignments instead.
    """
    least = least_score(length) + least_score(mate_length)
    span = F.greatest(F.lit(1.0), -least)
    following = F.greatest(F.coalesce(next_score, least), least)
    share, apart = (score - least) / span, (score - following) / span
    by_difference = floor_lookup(DIFFERENCE_TABLE.items(), apart, lambda row: floor_lookup(row, share, F.lit))
    equal = F.when(share >= 0.67, F.lit(1)).otherwise(F.lit(0))
    out = F.when(score < least, F.lit(0))
    if unique_table:
        out = out.when(next_score.isNull(), floor_lookup(UNIQUE_TABLE, share, F.lit))
    return out.when(score == following, equal).otherwise(by_difference).cast("int")


def recalculate_mapq(df: DataFrame, unique_table: bool = False) -> DataFrame:
    """Mapped alignments with a new ``mapq`` (the old one in ``old_mapq``) and ``pair_score``.

    Needs score (null: none), seq_length, rname, pos, rnext, pnext and the original places o_rname, o_pos, o_rnext, o_pnext.  An
    alignment's mate is the record of the read at the original mate place with the best score (the longer read of equals); a pair's
    score is the sum.  The next score is the best one not above the own at other places of the pair; without one, a pair that none beats
    is judged as the only one, others get 255.  Reads that have both paired and unpaired records are left out.
    """
    read = Window.partitionBy("qname")
    df = df.where(without_flags(UNMAPPED)).withColumn("has_mate", F.col("rnext").isNotNull() & F.col("pnext").isNotNull())
    mixed = F.min("has_mate").over(read) != F.max("has_mate").over(read)
    df = df.withColumn("mixed", mixed).where("NOT mixed AND score IS NOT NULL").drop("mixed")
    place = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("r"), F.col(b).alias("p")))
    df = df.withColumn("own", place("rname", "pos")).withColumn("other", place("rnext", "pnext"))
    pair = F.when(F.col("other").isNull(), F.struct(F.col("own").alias("lo"), F.col("other").alias("hi"))).otherwise(F.struct(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    df = df.withColumn("places", pair).drop("own", "other")
    best = df.where("o_rname IS NOT NULL AND o_pos IS NOT NULL").groupBy("qname", F.col("o_rname").alias("o_rnext"), F.col("o_pos").alias("o_pnext")).agg(F.max(F.struct("score", "seq_length")).alias("mate"))
    df = df.join(best, ["qname", "o_rnext", "o_pnext"], "left")
    df = df.withColumn("mate_score", F.when(F.col("has_mate"), F.coalesce("mate.score", F.lit(0.0))).otherwise(F.lit(0.0)))
    df = df.withColumn("mate_length", F.when(F.col("has_mate"), F.coalesce("mate.seq_length", F.lit(0))).otherwise(F.lit(0))).drop("mate")
    df = df.withColumn("pair_score", F.col("score") + F.col("mate_score"))
    # reads have few alignments; unpaired ones are compared with those of the same sequence
    sequence = F.when(F.col("has_mate"), F.lit("")).otherwise(F.coalesce("seq", F.lit("")))
    df = df.withColumn("sequence", sequence)
    rivals = df.groupBy("qname", "sequence", "places").agg(F.max("pair_score").alias("total"))
    rivals = rivals.groupBy("qname", "sequence").agg(F.collect_list(F.struct("places", "total")).alias("rivals"))
    df = df.join(rivals, ["qname", "sequence"])
    following = F.array_max(F.transform(F.filter("rivals", lambda r: (r["places"] != F.col("places")) & (r["total"] <= F.col("pair_score"))), lambda r: r["total"]))
    beaten = F.exists("rivals", lambda r: r["total"] > F.col("pair_score"))
    df = df.withColumn("next_score", following).withColumn("beaten", beaten)
    value = mapq(F.col("seq_length"), F.col("mate_length"), F.col("pair_score"), F.col("next_score"), unique_table)
    new = F.when(F.col("next_score").isNull() & F.col("beaten"), F.lit(NO_NEXT)).otherwise(value)
    return df.withColumn("old_mapq", F.col("mapq")).withColumn("mapq", new).drop("places", "rivals", "beaten", "sequence", "has_mate", "mate_score")


def rescore(ops: Column, seq: Column, qual: Column, ref_n: Column, mismatch_min: int = 2, mismatch_max: int = 6, n_penalty: int = 1, gap_open: int = 5, gap_extend: int = 3) -> Column:
    """Alignment score from =/X CIGAR items and base qualities; null where an M leaves matches unknown.

    ``ref_n``: offsets on the reference from the alignment's start that hold N.  A gap pays for opening unless an I or D came right before;
    H, P and N in between don't matter.  Every mismatch pays by its quality, one with an N on either side the N penalty, as does N = N.
    """
    state = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("q"), F.lit(0).alias("r"), F.lit("").alias("before"))
    quality = lambda k: F.least(F.ascii(F.substring(qual, (k + 1).cast("int"), F.lit(1))) - 33, F.lit(40))
    is_n = lambda k: ~F.substring(seq, (k + 1).cast("int"), F.lit(1)).isin("A", "C", "G", "T")

    def step(s: Column, x: Column) -> Column:
        n, op = x["n"], x["op"]
        gap = -n * F.lit(float(gap_extend)) - F.when(s["before"].isin("I", "D"), F.lit(0.0)).otherwise(F.lit(float(gap_open)))
        lost = F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.lit(0.0),
            lambda a, k: a
            - F.when(is_n(s["q"] + k) | F.array_contains(ref_n, (s["r"] + k).cast("bigint")), F.lit(float(n_penalty)))
            .otherwise(F.floor(quality(s["q"] + k) / 40.0 * (mismatch_max - mismatch_min) + mismatch_min).cast("double")),
        )
        held = -F.length(F.regexp_replace(F.substring(seq, (s["q"] + 1).cast("int"), n), "[ACGT]", "")) * F.lit(float(n_penalty))
        score = s["score"] + F.when(op.isin("I", "D"), gap).when(op == "X", lost).when(op == "=", held).otherwise(F.lit(0.0))
        moved = lambda ops: F.when(op.isin(*ops), n).otherwise(F.lit(0))
        return F.struct(score.alias("score"), (s["q"] + moved(("I", "S", "=", "X"))).alias("q"), (s["r"] + moved(("D", "N", "=", "X"))).alias("r"), F.when(op.isin("H", "P", "N"), s["before"]).otherwise(op).alias("before"))

    kept = F.filter(ops, lambda x: x["n"] > 0)
    return F.when(~F.exists(ops, lambda x: x["op"] == "M"), F.aggregate(kept, state, step, lambda s: s["score"]))


def rescored_tags(df: DataFrame, new_score: str = "new_score", old_tag: str = "XS", new_tag: str = "YS") -> DataFrame:
    """Tags after rescoring: AS holds the new score; where there was one, it moves to ``old_tag`` and the new one is in ``new_tag`` too."""
    from ..functions.text import with_tags

    old = F.try_element_at("tags", F.lit("AS"))
    value = F.col(new_score)
    had = old.isNotNull()
    return df.withColumn(
        "tags",
        with_tags(F.col("tags"), AS=F.concat(F.lit("i:"), F.floor(value).cast("long").cast("string")), **{old_tag: F.when(had, old), new_tag: F.when(had, F.concat(F.lit("f:"), value.cast("string")))}),
    )
