"""Co-ordinates of aligned sequences: the block index and projection of positions between sequences.

A block is a run without gaps.  Lookups are equi-joins on bins of positions with a residual, which hold for whole
genomes and spread a sequence that most rows refer to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 13
#: Blocks in a bin of a lookup, about, where they are short.
A_BIN = 8


def build_msa_index(aligned: DataFrame) -> DataFrame:
    """Blocks (chr, seq_id, aln_start, seq_start, len) of gapped sequences (chr, seq_id, seq); gaps are ``-``.

    Sequences may come in pieces, with ``start`` the column where a piece begins: then no task holds a sequence.  Runs are found within a
    piece; over the pieces of a sequence, a row of numbers each, the bases before a piece are summed and the place where a run that is
    open at a piece's end began is handed on, so that a run over several pieces is one block.
    """
    whole = "start" not in aligned.columns
    pieces = aligned.withColumn("start", F.lit(0).cast("long")) if whole else aligned
    runs = pieces.select("chr", "seq_id", "start", F.posexplode(F.regexp_extract_all("seq", F.lit("(-+|[^-]+)"), F.lit(1))).alias("k", "run"))
    runs = runs.select("chr", "seq_id", "start", "k", F.length("run").cast("long").alias("len"), F.col("run").startswith("-").alias("gap"))
    before = Window.partitionBy("chr", "seq_id", "start").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("len").over(before), F.lit(0))
    seq_at = F.coalesce(F.sum(F.when(F.col("gap"), 0).otherwise(F.col("len"))).over(before), F.lit(0))
    runs = runs.withColumn("at", at).withColumn("seq_at", seq_at).where("NOT gap")
    if whole:
        return runs.select("chr", "seq_id", F.col("at").alias("aln_start"), F.col("seq_at").alias("seq_start"), "len")
    n, tail = F.length("seq"), F.length(F.regexp_extract("seq", "([^-]*)$", 1))
    ends = pieces.select("chr", "seq_id", "start", n.alias("n"), F.length(F.replace(F.col("seq"), F.lit("-"), F.lit(""))).alias("bases"), tail.alias("tail"), ((n > 0) & ~F.col("seq").startswith("-")).alias("begins"))
    over = Window.partitionBy("chr", "seq_id").orderBy("start")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    meets = (F.lag("tail").over(over) > 0) & (F.lag(F.col("start") + F.col("n")).over(over) == F.col("start"))
    ends = ends.withColumn("continues", F.coalesce(F.col("begins") & meets, F.lit(False))).withColumn("before", F.coalesce(F.sum("bases").over(past), F.lit(0)))
    open_ = F.when((F.col("tail") > 0) & ~(F.col("continues") & (F.col("tail") == F.col("n"))), F.col("start") + F.col("n") - F.col("tail"))
    carried = ends.withColumn("open", open_).withColumn("origin", F.last("open", True).over(past))
    carried = carried.select(F.col("chr").alias("c_chr"), F.col("seq_id").alias("c_seq"), F.col("start").alias("c_start"), "continues", "before", "origin")
    met = runs.join(carried, (F.col("chr") == F.col("c_chr")) & (F.col("seq_id") == F.col("c_seq")) & (F.col("start") == F.col("c_start")))
    first = F.when((F.col("k") == 0) & F.col("continues"), F.col("origin")).otherwise(F.col("start") + F.col("at"))
    return met.groupBy("chr", "seq_id", first.alias("aln_start")).agg(F.min(F.col("before") + F.col("seq_at")).alias("seq_start"), F.sum("len").alias("len"))


def aligned_lengths(aligned: DataFrame) -> DataFrame:
    return aligned.select("chr", "seq_id", F.length("seq").cast("long").alias("aligned_length"))


def list_index(lengths: DataFrame) -> DataFrame:
    """(chr, sequences, aligned_length); an error where the sequences of a chromosome differ in length."""
    found = lengths.groupBy("chr").agg(F.count(F.lit(1)).alias("sequences"), F.min("aligned_length").alias("least"), F.max("aligned_length").alias("aligned_length"))
    checked = F.when(F.col("least") == F.col("aligned_length"), F.col("aligned_length")).otherwise(F.raise_error(F.concat(F.lit("sequences of different lengths in "), F.col("chr"))))
    return found.select("chr", "sequences", checked.alias("aligned_length"))


def sequence_lengths(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("chr", "seq_id").agg(F.max(F.col("seq_start") + F.col("len")).alias("seq_length"))


def merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks of both; a sequence that both hold is an error."""
    both = old.select("chr", "seq_id").distinct().join(new.select("chr", "seq_id").distinct(), ["chr", "seq_id"])
    fails = F.raise_error(F.concat(F.lit("sequence in both indices: "), F.concat_ws("/", "chr", "seq_id"))).cast("string")
    none = F.lit(None).cast("long")
    twice = both.select(fails.alias("chr"), "seq_id", none.alias("aln_start"), none.alias("seq_start"), none.alias("len"))
    return old.unionByName(new).unionByName(twice).orderBy("chr", "seq_id", "aln_start")


def segments(blocks: DataFrame) -> DataFrame:
    """Blocks with ``aln_next``, where the next block of the sequence begins (null after the last)."""
    following = Window.partitionBy("chr", "seq_id").orderBy("aln_start")
    return blocks.withColumn("aln_next", F.lead("aln_start").over(following))


def bin_width(extent: Column, blocks: Column, width: int) -> Column:
    """Bins for a sequence of so many blocks over so many positions: as wide as A_BIN blocks of the mean length, but at most ``width``.

    So a position is compared with few blocks however short they are, and blocks are spread over hardly more rows than there are blocks.
    """
    return F.least(F.lit(width), F.greatest(F.lit(1), F.ceil(extent * A_BIN / blocks))).cast("long")


def aligned_position(df: DataFrame, blocks: DataFrame, chr_: str, seq: str, pos: str, out: str = "aln", width: int = BIN) -> DataFrame:
    """Adds the column of the alignment that holds base ``pos`` of the sequence; null beyond its end or without the sequence."""
    widths = blocks.groupBy(F.col("chr").alias("w_chr"), F.col("seq_id").alias("w_seq")).agg(bin_width(F.max(F.col("seq_start") + F.col("len")), F.count(F.lit(1)), width).alias("w_width"))
    b = blocks.join(widths, (F.col("chr") == F.col("w_chr")) & (F.col("seq_id") == F.col("w_seq")))
    b = b.select(F.col("chr").alias("b_chr"), F.col("seq_id").alias("b_seq"), F.col("aln_start").alias("b_aln"), F.col("seq_start").alias("b_start"), (F.col("seq_start") + F.col("len")).alias("b_end"), F.col("w_width").alias("b_width"))
    b = b.withColumn("b_bin", F.explode(F.sequence(F.floor(F.col("b_start") / F.col("b_width")), F.floor((F.col("b_end") - 1) / F.col("b_width")))))
    met = df.join(widths, (F.col(chr_) == F.col("w_chr")) & (F.col(seq) == F.col("w_seq")), "left")
    cond = (F.col(chr_) == F.col("b_chr")) & (F.col(seq) == F.col("b_seq")) & (F.floor(F.col(pos) / F.col("w_width")) == F.col("b_bin")) & (F.col(pos) >= F.col("b_start")) & (F.col(pos) < F.col("b_end"))
    return met.join(b, cond, "left").withColumn(out, F.col("b_aln") + F.col(pos) - F.col("b_start")).drop("b_chr", "b_seq", "b_aln", "b_start", "b_end", "b_width", "b_bin", "w_chr", "w_seq", "w_width")


def sequence_position(df: DataFrame, blocks: DataFrame, chr_: str, seq: str, aln: str, out: str = "dst_pos", gap: str = "dst_gap", end: int = 1 << 40, width: int = BIN) -> DataFrame:
    """Adds the number of bases of the sequence before column ``aln``, and whether it has a gap there.

    A sequence without blocks gives null.  After the last block every column is met up to its bin's end by that block, and beyond
    by the sequence's length.
    """
    ends = blocks.groupBy(F.col("chr").alias("e_chr"), F.col("seq_id").alias("e_seq")).agg(
        F.max(F.col("seq_start") + F.col("len")).alias("e_len"), F.min("aln_start").alias("e_first"), bin_width(F.max(F.col("aln_start") + F.col("len")), F.count(F.lit(1)), width).alias("e_width")
    )
    s = segments(blocks).join(ends.select(F.col("e_chr").alias("w_chr"), F.col("e_seq").alias("w_seq"), F.col("e_width").alias("s_width")), (F.col("chr") == F.col("w_chr")) & (F.col("seq_id") == F.col("w_seq")))
    s = s.select(F.col("chr").alias("s_chr"), F.col("seq_id").alias("s_seq"), F.col("aln_start").alias("s_aln"), F.col("seq_start").alias("s_start"), F.col("len").alias("s_len"), F.col("aln_next").alias("s_next"), "s_width")
    last = F.coalesce(F.col("s_next"), F.col("s_aln") + F.col("s_len"))
    s = s.withColumn("s_to", last).withColumn("s_bin", F.explode(F.sequence(F.floor(F.col("s_aln") / F.col("s_width")), F.floor((F.col("s_to") - 1) / F.col("s_width")))))
    cond = (F.col(chr_) == F.col("s_chr")) & (F.col(seq) == F.col("s_seq")) & (F.floor(F.col(aln) / F.col("e_width")) == F.col("s_bin")) & (F.col(aln) >= F.col("s_aln")) & (F.col(aln) < F.col("s_to"))
    met = df.join(ends, (F.col(chr_) == F.col("e_chr")) & (F.col(seq) == F.col("e_seq")), "left").join(s, cond, "left")
    offset = F.col(aln) - F.col("s_aln")
    found = F.col("s_start") + F.least(offset, F.col("s_len"))
    outside = F.when(F.col(aln) < F.col("e_first"), F.lit(0)).otherwise(F.col("e_len"))
    met = met.withColumn(out, F.when(F.col(aln).isNull() | F.col("e_len").isNull(), F.lit(None)).otherwise(F.coalesce(found, outside)).cast("long"))
    met = met.withColumn(gap, F.when(F.col(out).isNotNull(), F.coalesce(offset >= F.col("s_len"), F.lit(True))))
    return met.drop("s_chr", "s_seq", "s_aln", "s_start", "s_len", "s_next", "s_width", "s_to", "s_bin", "e_chr", "e_seq", "e_len", "e_first", "e_width")


def project_positions(df: DataFrame, blocks: DataFrame, chr_: str = "chr", src: str = "src", dst: str = "dst", pos: str = "pos", out: str = "dst_pos") -> DataFrame:
    """Adds ``aln``, ``dst_pos`` and ``dst_gap``: position ``pos`` of sequence ``src`` on ``dst``; where that has a gap, its next base."""
    met = aligned_position(df, blocks, chr_, src, pos)
    return sequence_position(met, blocks, chr_, dst, "aln", out)


def check_sequences(df: DataFrame, blocks: DataFrame, chr_: str = "chr", seq: str = "seq_id") -> DataFrame:
    """(chr, seq) of ``df`` that the index lacks."""
    known = blocks.select(F.col("chr").alias(chr_), F.col("seq_id").alias(seq)).distinct()
    return df.select(chr_, seq).distinct().join(known, [chr_, seq], "left_anti")


def positions_within(df: DataFrame, blocks: DataFrame, chr_: str, seq: str, pos: str, length: str | None = None, target: str | None = None) -> DataFrame:
    """``df`` as it is; running it fails, and names them, if the index lacks a row's sequence or, on its chromosome, ``target``, or if [pos, pos + length)
    (one base without ``length``) isn't within the sequence.  Rows without a chromosome pass.

    The check is a part of the position's own expression, so whatever works with the position comes after it.
    """
    ends = sequence_lengths(blocks)
    known = ends.select(F.col("chr").alias("k_chr"), F.col("seq_id").alias("k_seq"), F.col("seq_length").alias("k_end"))
    met = df.join(known, (F.col(chr_) == F.col("k_chr")) & (F.col(seq) == F.col("k_seq")), "left")
    name = F.concat_ws("", F.lit("sequence "), F.coalesce(F.col(seq), F.lit("null")), F.lit(" of "), F.col(chr_))
    checked = F.when(F.col(chr_).isNull(), F.col(pos)).when(F.col("k_end").isNull(), F.raise_error(F.concat(F.lit("the index lacks "), name)).cast("long"))
    if target is not None:
        met = met.join(ends.where(F.col("seq_id") == target).select(F.col("chr").alias("t_chr"), F.lit(True).alias("t_has")), F.col(chr_) == F.col("t_chr"), "left")
        checked = checked.when(F.col("t_has").isNull(), F.raise_error(F.concat(F.lit(f"the index lacks sequence {target} of "), F.col(chr_))).cast("long"))
    stop = F.col(pos) + (F.greatest(F.col(length), F.lit(1)) if length else 1)
    beyond = F.concat_ws("", F.lit("positions "), F.col(pos), F.lit(" to "), stop, F.lit(" aren't within the "), F.col("k_end"), F.lit(" bases of "), name)
    checked = checked.when((F.col(pos) < 0) | (stop > F.col("k_end")), F.raise_error(beyond).cast("long")).otherwise(F.col(pos))
    return met.withColumn(pos, checked).drop("k_chr", "k_seq", "k_end", "t_chr", "t_has")


def lift_regions(regions: DataFrame, blocks: DataFrame, src: str, dst: str, dst_chr: str | None = None) -> DataFrame:
    """Regions (chr, lb, rb) of sequence ``src`` on ``dst``: (chr, lb, rb).  An end at the source's length becomes the target's length."""
    two = regions.withColumn("region", F.monotonically_increasing_id())
    each = two.select("region", "chr", F.lit(src).alias("src"), F.lit(dst).alias("dst"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("lb").alias("pos")), F.struct(F.lit(1).alias("k"), F.col("rb").alias("pos")))).alias("x"))
    each = each.select("region", "chr", "src", "dst", F.col("x.k").alias("k"), F.col("x.pos").alias("pos"))
    lengths = sequence_lengths(blocks)
    at = lambda name: lengths.where(F.col("seq_id") == name).select("chr", F.col("seq_length"))
    met = project_positions(each, blocks).join(at(src).withColumnRenamed("seq_length", "src_length"), "chr", "left").join(at(dst).withColumnRenamed("seq_length", "dst_length"), "chr", "left")
    lifted = F.when(F.col("pos") == F.col("src_length"), F.col("dst_length")).otherwise(F.col("dst_pos"))
    out = met.groupBy("region", "chr").agg(F.max(F.when(F.col("k") == 0, lifted)).alias("lb"), F.max(F.when(F.col("k") == 1, lifted)).alias("rb"))
    return out.select(F.lit(dst_chr).alias("chr") if dst_chr else F.col("chr"), "lb", "rb")
