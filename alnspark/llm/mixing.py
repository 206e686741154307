"""Operator 9: mix sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

1. Every source gets a target of words: its share by weight of the whole mix, at most ``max_epochs`` times its own words,
   what is cut off being shared again among the others.
2. The mix is dealt in blocks of ``block`` words: sources get whole blocks by the highest quotients
   words / (2 k + 1); each source is cut into shards by a seeded hash of the id, which get the
   source's blocks by the highest quotients in turn.
3. Within a shard the documents stand in seeded order.  A quota of blocks is first spent on whole passes over the shard;
   the rest is a run of blocks from a seeded block on, around the end.

Only sources and shards meet in a window of one task; a source has at most ``MAX_SHARDS`` of them with about four quotients each, and documents
meet by shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

MAX_SHARDS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) with target: the level at which the capped shares fill the whole mix.

    Sources are met in the order of cap / weight; those before the level keep their cap, the others share
    by weight what is left.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    df = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fills = everything.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", level).withColumn("is_open", F.col("cap") > F.col("level") * F.col("weight"))
    at = F.min(F.when(F.col("is_open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return df.withColumn("target", F.when(at.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), at * F.col("weight")))).select("source", "source_size", "target")


def apportion(df: DataFrame, part: list[str], key: list[Column], size: str, seats: str) -> DataFrame:
    """Sainte-Lague: adds ``quota``; the ``seats`` of each ``part`` go to the highest quotients size / (2 k + 1).

    With m rows and e = m / (2 seats), a divisor of 1 + e times the proportional one deals at most the seats and one of
    1 - e times at least those, as m roundings lose or win half a seat each; so a row gets between (1 - e) and (1 + e) times its share, rounded.  Only
    the quotients between compete: about 4 a row however many seats there are.
    ``seats`` is a column that is equal within a part.  Ties go to the row first in ``key``.
    """
    group = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    fair = F.when(F.sum(size).over(group) > 0, F.col(size) / F.sum(size).over(group) * F.col(seats)).otherwise(F.lit(0.0))
    spare = F.when(F.col(seats) > 0, F.col("fair") * F.count(F.lit(1)).over(group) / (F.col(seats) * 2)).otherwise(F.lit(0.0))
    df = df.withColumn("fair", fair).withColumn("spare", spare).withColumn("sure", F.greatest(F.lit(0), F.round(F.col("fair") - F.col("spare")) - 1).cast("long"))
    df = df.withColumn("open", F.col(seats) - F.sum("sure").over(group))
    tries = F.explode(F.sequence(F.col("sure"), (F.round(F.col("fair") + F.col("spare")) + 1).cast("long")))
    bids = df.select(*[c for c in df.columns], tries.alias("k")).withColumn("quotient", F.col(size) / (2 * F.col("k") + 1))
    place = F.row_number().over(group.orderBy(F.col("quotient").desc(), *key, "k"))
    won = ((F.col("place") <= F.col("open")) & (F.col(size) > 0)).cast("long")
    bids = bids.withColumn("place", place)
    keep = [c for c in df.columns if c not in ("fair", "spare", "sure", "open")]
    return bids.groupBy(*keep).agg((F.first("sure") + F.sum(won)).alias("quota"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    block: int = 16,
    shard_words: int = 4096,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of ``docs``: id, source, size, source_size, target, taken (words the mix takes of it, repeats counted).

    The columns in ``keep`` come along.

    Sources in the order of code points, null as a source of its own and last, have the ``weights`` in turn.  A
    null or blank text has size 0 and takes 0; a source without words has target 0.  Equal rows count each.
    A source's taken words differ from its target by less than a block for each time its quota was rounded, no
    row takes more than ``max_epochs`` times its size (rounded up to whole passes), and the result depends only on the rows and ``seed``.
    """
    sized = materialise(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), *(docs[c] for c in keep)), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sources, weights, share, max_epochs)
    whole = Window.partitionBy(F.lit(0))
    goal = goal.withColumn("seats", F.round(F.sum("target").over(whole) / block).cast("long"))
    goal = apportion(goal, [], [F.col("source").asc_nulls_last()], "target", "seats").withColumnRenamed("quota", "source_blocks").drop("seats")
    goal = goal.withColumn("shards", F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("int"))
    goal = materialise(goal, "targets")  # a row a source
    on_source = F.col("d.source").eqNullSafe(F.col("g.source"))
    few = goal.count() <= 100_000
    dealt = sized.alias("d").join(F.broadcast(goal.alias("g")) if few else goal.alias("g"), on_source)
    shard = F.pmod(F.xxhash64(F.lit(seed), F.col("d.id")), F.col("shards")).cast("int")
    dealt = dealt.select("d.id", "d.source", "d.size", "g.source_size", "g.target", "g.source_blocks", shard.alias("shard"), *(f"d.{c}" for c in keep))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    quota = apportion(shards, ["source"], [F.col("shard")], "shard_size", "source_blocks").select("source", "shard", "quota")
    in_shard = Window.partitionBy("source", "shard")
    dealt = dealt.withColumn("shard_size", F.sum("size").over(in_shard))
    seeded = in_shard.orderBy(F.xxhash64(F.lit(seed + 1), F.col("id")), "id", "size", *keep)
    dealt = dealt.withColumn("stop", F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = dealt.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))).select("d.*", "q.quota")
    words = F.least(F.col("quota") * block, (F.col("shard_size") * max_epochs).cast("long"))
    passes = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(F.lit(0))
    dealt = dealt.withColumn("passes", passes.cast("long")).withColumn("rest", words - F.col("passes") * F.col("shard_size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block))
    dealt = dealt.withColumn("from", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("shard")), blocks) * block)

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("stop"), b) - F.greatest(F.col("stop") - F.col("size"), a))

    end = F.col("from") + F.col("rest")
    run = overlap(F.col("from"), F.least(end, F.col("shard_size"))) + overlap(F.lit(0), end - F.col("shard_size"))
    return dealt.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + run).cast("long").alias("taken"), *keep)


def whole_times(taken: DataFrame, key: list[str], seed: int = 7) -> DataFrame:
    """``key`` and source with ``times``, the whole copies for the words ``taken`` of rows of ``size``, none of 0.

    Rows equal in key and source count together.  What exceeds whole passes is carried along the rows of a source in the order of
    their size, from a seeded start: a row gets one more copy with a chance of its remainder, and a source's words differ from the
    words taken by less than its largest row.  A run ends within at most two rows of a shard, so few rows of a source have a remainder.
    """
    rows = taken.groupBy(*key, "source").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken")).where("taken > 0")
    rows = rows.withColumn("times", F.floor(F.col("taken") / F.col("size"))).withColumn("rest", F.col("taken") - F.col("times") * F.col("size"))
    part = F.floor(F.col("rest") / F.col("size") * float(1 << 32))  # whole numbers, so that sums are exact
    order = Window.partitionBy("source").orderBy("size", F.xxhash64(F.lit(seed + 3), *key), *key)
    stop = F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.pmod(F.xxhash64(F.lit(seed + 4), F.col("source")), F.lit(1 << 32))
    open_ = rows.where("rest > 0").withColumn("part", part).withColumn("stop", stop)
    more = F.shiftright("stop", 32) - F.shiftright(F.col("stop") - F.col("part"), 32)
    open_ = open_.withColumn("times", F.col("times") + more)
    names = [*key, "source", "times"]
    return rows.where("rest = 0").select(*names).unionByName(open_.select(*names)).where("times > 0")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", nearest: bool = True, **how) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as mix() takes it, in whole copies.

    ``nearest`` rounds each id by itself, which takes too few words where runs are shorter than documents; without it
    remainders are carried by whole_times(), and every source meets its target but for one document.
    """
    if nearest:
        dealt = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
        times = dealt.groupBy(F.col(id_col).alias("__mix_id")).agg(F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")))).cast("int").alias("__mix_times")).where("__mix_times > 0")
        met = docs.join(times, docs[id_col].eqNullSafe(F.col("__mix_id")))
    else:
        docs = docs.withColumn("__mix_text", F.xxhash64(text_col))  # rows may share an id
        dealt = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, keep=["__mix_text"], **how)
        dealt = materialise(dealt.select(F.col(id_col).alias("__mix_id"), F.col("__mix_text").alias("__mix_hash"), "source", "size", "taken"), "taken")
        times = whole_times(dealt, ["__mix_id", "__mix_hash"], how.get("seed", 7)).withColumnsRenamed({"source": "__mix_source", "times": "__mix_times"})
        same = docs[id_col].eqNullSafe(F.col("__mix_id")) & docs[source_col].eqNullSafe(F.col("__mix_source")) & (docs["__mix_text"] == F.col("__mix_hash"))
        met = docs.join(times, same).drop("__mix_text", "__mix_hash", "__mix_source")
    return met.withColumn("__mix_time", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).drop("__mix_id", "__mix_times", "__mix_time")
