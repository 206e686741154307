"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import text as T
from ..operators import coordinates, filters, headers, mapq, order, overlap, project, stats, subset, support
from ..streaming import alignments as streaming
from .workload import alignments, cte, view, stored, view_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ALN = cte("alignments")
ITEMS = cte("alignments", "items")


# --------------------------------------------------------------------------- filters


@query(ALN + "SELECT mapq, count(*) AS n FROM alignments WHERE (flag & 3588) = 0 GROUP BY mapq")
def mapq_histogram(spark, d):
    return stats.mapq_histogram(filters.countable(view(spark, d, "alignments")))


@query(ALN + "SELECT CASE WHEN (flag & 1540) <> 0 THEN 'flags' WHEN rec_idx % 13 = 5 THEN 'no_reference' WHEN rec_idx % 17 IN (3, 8) THEN 'no_position' WHEN rec_idx % 19 IN (2, 7) THEN 'no_sequence' ELSE 'kept' END AS outcome, count(*) AS n FROM alignments GROUP BY 1")
def projection_counters(spark, d):
    """Over records of which some lack a reference, a position or a sequence."""
    df = view(spark, d, "alignments").withColumn("rname", F.expr("IF(rec_idx % 13 <> 5, rname, NULL)"))
    df = df.withColumn("pos", F.expr("CASE rec_idx % 17 WHEN 3 THEN NULL WHEN 8 THEN -1 ELSE pos END")).withColumn("seq", F.expr("CASE rec_idx % 19 WHEN 2 THEN NULL WHEN 7 THEN '' ELSE seq END"))
    return filters.projection_counters(df)


@query(ALN + "SELECT rec_idx, flag FROM alignments WHERE (flag & 3844) = 0")
def primary_only(spark, d):
    return filters.countable(view(spark, d, "alignments"), primary_only=True).select("rec_idx", "flag")


@query(ALN + "SELECT rec_idx, rname FROM alignments WHERE rname = 'chr1/s2'")
def on_contig(spark, d):
    return filters.on_contig(view(spark, d, "alignments"), "chr1/s2").select("rec_idx", "rname")


@query(ALN + "SELECT rec_idx, rname FROM alignments WHERE starts_with(rname, 'chr3')")
def on_contig_prefix(spark, d):
    return filters.on_contig(view(spark, d, "alignments"), prefix="chr3").select("rec_idx", "rname")


_CLASS = "CASE WHEN starts_with({0}, 'chr1') THEN 1 WHEN starts_with({0}, 'chr') AND NOT starts_with({0}, 'chr4') THEN 0 WHEN starts_with({0}, 'chr4') THEN 2 END"


@query(ALN + "SELECT rec_idx FROM alignments WHERE starts_with(rname, 'chr3') AND starts_with(rnext, 'chr3')")
def mate_on_contig(spark, d):
    return filters.mate_on(filters.on_contig(view(spark, d, "alignments"), prefix="chr3"), prefix="chr3").select("rec_idx")


@query(ALN + f"SELECT rec_idx, CAST({_CLASS.format('rname')} AS INT) AS ref_class FROM alignments WHERE (flag & 3844) = 0 AND {_CLASS.format('rname')} = {_CLASS.format('rnext')}")
def same_reference_class(spark, d):
    df = filters.countable(view(spark, d, "alignments"), primary_only=True)
    return filters.in_classes(df, ["chr", "chr1", "chr4"], prefix=True, same_ref=True).select("rec_idx", "ref_class")


@query(ALN + "SELECT rec_idx FROM alignments WHERE rec_idx % 2 = 0 ")
def kept_tags(spark, d):
    return filters.keep_tags(alignments(spark, d), ["XX"]).where(F.size("tags") == 2).select("rec_idx")


@query(ALN + "SELECT 'XM' AS tag, count(*) AS n FROM alignments UNION ALL SELECT 'ZZ', count(*) FROM alignments WHERE rec_idx % 2 = 1")
def removed_tags(spark, d):
    return filters.removed_tags(alignments(spark, d))


@query(cte("variants") + "SELECT var_id, zygosity FROM variants WHERE zygosity = 1")
def zygosity_filter(spark, d):
    df = view(spark, d, "variants").withColumn("gt", F.array((F.col("var_id") % 2).cast("int"), (F.col("var_id") % 3 == 0).cast("int")))
    return filters.with_zygosity(df, 1).select("var_id", "zygosity")


@query(cte("variants", "regions") + "SELECT var_id FROM variants v WHERE EXISTS (SELECT 1 FROM regions r WHERE r.chr = v.chrom AND v.pos < r.rb AND r.lb < v.pos + v.ref_len)")
def variants_in_regions(spark, d):
    return support.in_regions(view(spark, d, "variants"), view(spark, d, "regions")).select("var_id")


@query(cte("refs") + "SELECT name, length FROM refs WHERE ref_idx % 3 <> 0")
def exclude_contigs(spark, d):
    refs = view(spark, d, "refs")
    return filters.exclude_contigs(refs, refs.where("ref_idx % 3 = 0")).select("name", "length")


# --------------------------------------------------------------------------- CIGAR


@query(ALN + "SELECT rec_idx, cigar_text AS cigar FROM alignments")
def cigar_text(spark, d):
    return alignments(spark, d).select("rec_idx", C.render(F.col("cigar")).alias("cigar"))


@query(
    ITEMS
    + """SELECT rec_idx, CAST(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) AS BIGINT) AS ref_length, CAST(sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) AS BIGINT) AS read_length,
    CAST(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') AND k <= last THEN n ELSE 0 END) AS BIGINT) AS anchored, CAST(sum(CASE WHEN op NOT IN ('H', 'P') THEN n ELSE 0 END) AS BIGINT) AS clipped
    FROM (SELECT *, max(CASE WHEN op IN ('M', '=', 'X') THEN k END) OVER (PARTITION BY rec_idx) AS last FROM items) GROUP BY rec_idx"""
)
def cigar_lengths(spark, d):
    c = F.col("cigar")
    return alignments(spark, d).select("rec_idx", C.reference_length(c).alias("ref_length"), C.query_length(c).alias("read_length"), C.right_anchored_length(c).alias("anchored"), C.record_length(c, True).alias("clipped"))


_SHRUNK = """, marked AS (SELECT rec_idx, k, n, CASE WHEN op IN ('I', 'D') AND rec_idx % 2 = 0 THEN 'M' ELSE op END AS op FROM items),
    islands AS (SELECT *, sum(starts) OVER (PARTITION BY rec_idx ORDER BY k) AS island FROM (
        SELECT *, CASE WHEN lag(op) OVER (PARTITION BY rec_idx ORDER BY k) = op THEN 0 ELSE 1 END AS starts FROM marked)),
    joined AS (SELECT rec_idx, island, sum(n) AS n, min(op) AS op FROM islands GROUP BY rec_idx, island) """


@query(ITEMS + _SHRUNK + "SELECT rec_idx, string_agg(concat(CAST(CAST(n AS BIGINT) AS STRING), op), '' ORDER BY island) AS cigar FROM joined GROUP BY rec_idx")
def cigar_collapse(spark, d):
    changed = F.transform("cigar", lambda x: C.item(x["n"], F.when(x["op"].isin("I", "D") & (F.col("rec_idx") % 2 == 0), "M").otherwise(x["op"])))
    return alignments(spark, d).select("rec_idx", C.render(C.collapse(changed)).alias("cigar"))


@query(ITEMS + "SELECT rec_idx, translate(cigar_text, '=X', 'MM') AS cigar FROM alignments")
def cigar_alignment_match(spark, d):
    changed = F.transform("cigar", lambda x: C.item(x["n"], F.when(x["op"] == "M", F.when(x["n"] % 2 == 0, "=").otherwise("X")).otherwise(x["op"])))
    return alignments(spark, d).select("rec_idx", C.render(C.to_alignment_match(changed)).alias("cigar"))


@query(ALN + "SELECT rec_idx, rec_idx % 5 = 0 AS same FROM alignments")
def cigar_equivalence(spark, d):
    """I and D swapped within a run are the same, another count is not."""
    one = F.concat("cigar", F.array(C.item(F.lit(2), "I"), C.item(F.lit(3), "D"), C.item(F.lit(1), "M")))
    two = F.concat("cigar", F.array(C.item(F.lit(3), "D"), C.item(F.when(F.col("rec_idx") % 5 == 0, 2).otherwise(4), "I"), C.item(F.lit(1), "M")))
    return alignments(spark, d).select("rec_idx", C.equivalent(one, two).alias("same"))


@query(
    ITEMS
    + """, with_run AS (SELECT rec_idx, pos, k, n, op FROM items UNION ALL SELECT rec_idx, pos, 100, 1 + rec_idx % 3, 'I' FROM alignments UNION ALL SELECT rec_idx, pos, 101, 2, 'D' FROM alignments UNION ALL SELECT rec_idx, pos, 102, 1, 'M' FROM alignments),
    placed AS (SELECT *, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER w, 0) AS BIGINT) AS r, CAST(coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS BIGINT) AS q
        FROM with_run WINDOW w AS (PARTITION BY rec_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT a.rec_idx, a.r AS ref_start, a.r + 2 AS ref_end, a.q AS query_start, CAST(a.q + a.n AS BIGINT) AS query_end FROM placed a WHERE a.k = 100"""
)
def indel_runs(spark, d):
    df = alignments(spark, d)
    ops = F.concat("cigar", F.array(C.item(1 + F.col("rec_idx") % 3, "I"), C.item(F.lit(2), "D"), C.item(F.lit(1), "M")))
    each = df.select("rec_idx", F.explode(C.indel_runs(ops, F.col("pos").cast("long"))).alias("x"))
    return each.select("rec_idx", "x.ref_start", "x.ref_end", "x.query_start", "x.query_end")


_BASES = """, placed AS (SELECT i.*, a.seq, 1 + i.pos + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER w, 0) AS r, 1 + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS q
        FROM items i JOIN alignments a USING (rec_idx) WHERE rec_idx % 1 = 0 WINDOW w AS (PARTITION BY i.rec_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    reference AS (SELECT repeat('ACGTNACCA', 600) AS ref),
    bases AS (SELECT rec_idx, k, j, CASE WHEN substr(seq, CAST(q + j AS INT), 1) = substr(ref, CAST(r + j AS INT), 1) THEN '=' ELSE 'X' END AS op
        FROM placed, reference, LATERAL (SELECT unnest(range(CAST(n AS INT))) AS j) WHERE op = 'M'),
    islands AS (SELECT *, sum(starts) OVER (PARTITION BY rec_idx, k ORDER BY j) AS island FROM (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY rec_idx, k ORDER BY j) = op THEN 0 ELSE 1 END AS starts FROM bases)),
    parts AS (SELECT rec_idx, k, island, count(*) AS n, min(op) AS op FROM islands GROUP BY rec_idx, k, island UNION ALL SELECT rec_idx, k, 0, n, op FROM items WHERE op <> 'M') """


@query(ITEMS + _BASES + "SELECT rec_idx, string_agg(concat(CAST(n AS STRING), op), '' ORDER BY k, island) AS cigar FROM parts GROUP BY rec_idx")
def cigar_sequence_match(spark, d):
    ref = F.repeat(F.lit("ACGTNACCA"), F.lit(600))
    return alignments(spark, d).select("rec_idx", C.render(C.to_sequence_match(F.col("cigar"), F.col("seq"), ref, F.col("pos").cast("long"))).alias("cigar"))


@query(
    ITEMS
    + """, span AS (SELECT rec_idx, pos, sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) AS len FROM items GROUP BY rec_idx, pos)
    SELECT rec_idx, count(*) FILTER (WHERE (pos + j) % 9 = 4) AS n_bases, CAST(coalesce(sum(j) FILTER (WHERE (pos + j) % 9 = 4), 0) AS BIGINT) AS offsets
    FROM span, LATERAL (SELECT unnest(range(CAST(len AS INT))) AS j) GROUP BY rec_idx"""
)
def reference_n_positions(spark, d):
    ref = F.repeat(F.lit("ACGTNACCA"), F.lit(600))
    found = C.reference_n_positions(F.col("cigar"), ref, F.col("pos").cast("long"))
    df = alignments(spark, d).select("rec_idx", found.alias("at"))
    return df.select("rec_idx", F.size("at").cast("long").alias("n_bases"), F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x).alias("offsets"))


# --------------------------------------------------------------------------- statistics


@query(cte("alignments", "refs") + "SELECT ref_idx, name, count(rec_idx) AS n FROM refs LEFT JOIN alignments ON rname = name GROUP BY ref_idx, name")
def count_by_contig(spark, d):
    return stats.count_by_contig(view(spark, d, "alignments"), view(spark, d, "refs"))


@query(
    ALN
    + """SELECT CAST(floor(pos / 500) AS BIGINT) AS bin, min(mapq) AS min, quantile_cont(mapq, 0.1) AS q10, quantile_cont(mapq, 0.25) AS q25, quantile_cont(mapq, 0.5) AS med, quantile_cont(mapq, 0.75) AS q75,
    quantile_cont(mapq, 0.9) AS q90, max(mapq) AS max, count(*) AS n FROM alignments WHERE mapq <> 255 GROUP BY 1"""
)
def mapq_box_plot(spark, d):
    return stats.mapq_box_plot(view(spark, d, "alignments"), 500)


_COVER = """, span AS (SELECT a.rname, a.pos AS s, a.pos + sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) AS e, a.mapq, a.rec_idx FROM alignments a JOIN items i USING (rec_idx) WHERE (flag & 3588) = 0 GROUP BY a.rec_idx, a.rname, a.pos, a.mapq),
    coverage AS (SELECT rname, CAST(position AS BIGINT) AS position, count(*) AS coverage FROM span, LATERAL (SELECT unnest(range(s, CAST(e AS INT))) AS position) GROUP BY rname, position) """
COVER = ITEMS + _COVER


def _coverage(spark, d, **how):
    return stats.coverage(filters.countable(alignments(spark, d)), **how)


@query(COVER + "SELECT rname, position, coverage FROM coverage")
def coverage(spark, d):
    return _coverage(spark, d, width=1024)


@query(COVER + "SELECT rname, position, coverage FROM coverage UNION ALL SELECT rname, position + 1, 0 FROM coverage c WHERE NOT EXISTS (SELECT 1 FROM coverage x WHERE x.rname = c.rname AND x.position = c.position + 1)")
def coverage_with_ends(spark, d):
    return _coverage(spark, d, explicit_ends=True)


@query(COVER + ", top AS (SELECT max(coverage) AS m, count(*) AS n FROM coverage) SELECT v AS coverage, CASE WHEN v = 0 THEN 150000 - n ELSE (SELECT count(*) FROM coverage WHERE coverage = v) END AS n FROM top, LATERAL (SELECT unnest(range(m + 1)) AS v)")
def coverage_histogram(spark, d):
    return stats.coverage_histogram(_coverage(spark, d), length=150_000)


@query(COVER + "SELECT rname, position, CAST(sum(coverage) AS BIGINT) AS coverage FROM (SELECT * FROM coverage UNION ALL SELECT rname, position + 7, coverage FROM coverage) GROUP BY rname, position")
def merge_coverages(spark, d):
    one = _coverage(spark, d)
    return stats.merge_coverages(one, one.withColumn("position", F.col("position") + 7))


@query(
    cte("alignments", "items", "variants")
    + _COVER
    + """, flat AS (SELECT split_part(rname, '/', 1) AS chrom, position, CAST(sum(coverage) AS BIGINT) AS coverage FROM coverage GROUP BY 1, 2),
    bases AS (SELECT chrom, pos + j AS position FROM variants, LATERAL (SELECT unnest(range(ref_len)) AS j))
    SELECT b.chrom, b.position, coalesce(f.coverage, 0) AS coverage FROM bases b LEFT JOIN flat f ON b.chrom = f.chrom AND b.position = f.position"""
)
def coverage_at_variants(spark, d):
    flat = _coverage(spark, d).groupBy(F.substring_index("rname", "/", 1).alias("rname"), "position").agg(F.sum("coverage").alias("coverage"))
    return stats.coverage_at(view(spark, d, "variants"), flat)


# --------------------------------------------------------------------------- subset and split


@query(
    ALN
    + """, best AS (SELECT *, coalesce(max(CASE WHEN mapq <> 255 THEN mapq END) OVER (PARTITION BY qname), 0) AS top FROM alignments),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY CASE WHEN mapq = top THEN 0 ELSE 1 END, rec_idx) AS place FROM best) WHERE place = 1),
    mates AS (SELECT b.*, coalesce(max(CASE WHEN b.mapq <> 255 THEN b.mapq END) OVER (PARTITION BY b.qname), 0) AS m_top FROM best b JOIN chosen c ON b.qname = c.qname AND b.rname = c.rnext AND b.pos = c.pnext AND b.rec_idx <> c.rec_idx),
    mate AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY rec_idx) AS m_place FROM mates WHERE mapq = m_top)
    SELECT rec_idx, qname, mapq, 'best' AS role FROM chosen UNION ALL SELECT rec_idx, qname, mapq, 'mate' FROM mate WHERE m_place = 1"""
)
def best_mapq(spark, d):
    return subset.best_mapq(view(spark, d, "alignments")).select("rec_idx", "qname", "mapq", "role")


@query(ALN + "SELECT rec_idx, qname FROM alignments WHERE CAST(substr(qname, 2) AS BIGINT) IN (SELECT user_id * 3 FROM events)")
def by_read_id(spark, d):
    names = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("r"), (F.col("user_id") * 3).cast("string")).alias("qname"))
    return subset.by_read_id(view(spark, d, "alignments"), names).select("rec_idx", "qname")


@query(ALN + "SELECT DISTINCT rname AS name FROM alignments")
def reference_names(spark, d):
    return subset.reference_names(view(spark, d, "alignments"))


def _wanted(spark):
    return spark.createDataFrame([("chr0", "zero"), ("chr2/s1", "two-one"), ("chr9", "nine")], "name string, new_name string")


_SPLIT = "SELECT rec_idx, CASE WHEN starts_with(rname, 'chr0') THEN 'zero' WHEN starts_with(rname, 'chr2/s1') THEN 'two-one' ELSE rname END AS rname, CASE WHEN starts_with(rname, 'chr0') THEN 'chr0' WHEN starts_with(rname, 'chr2/s1') THEN 'chr2/s1' END AS target FROM alignments"


@query(ALN + _SPLIT)
def split_by_reference(spark, d):
    return subset.split_by_reference(view(spark, d, "alignments"), _wanted(spark), prefix=True).select("rec_idx", "rname", "target")


@query(ALN + f", parts AS ({_SPLIT}) SELECT t.target, count(p.rec_idx) AS n FROM (VALUES ('chr0'), ('chr2/s1'), ('chr9')) t(target) LEFT JOIN parts p ON p.target = t.target GROUP BY t.target")
def target_counts(spark, d):
    wanted = _wanted(spark)
    return subset.target_counts(subset.split_by_reference(view(spark, d, "alignments"), wanted, prefix=True), wanted)


# --------------------------------------------------------------------------- order and sets


@query(ALN + "SELECT row_number() OVER (ORDER BY rname NULLS LAST, pos, rec_idx) AS place, rname, rec_idx FROM alignments")
def coordinate_sort(spark, d):
    return order.coordinate_sort(order.coordinate_places(view(spark, d, "alignments"))).select("place", "rname", "rec_idx")


@query(ALN + "SELECT row_number() OVER (ORDER BY rname NULLS LAST, pos, rec_idx) AS place, rec_idx FROM alignments")
def coordinate_places(spark, d):
    return order.coordinate_places(view(spark, d, "alignments")).select("place", "rec_idx")


@query(ALN + "SELECT rec_idx, CAST(sum(starts) OVER (ORDER BY rec_idx) AS BIGINT) AS run FROM (SELECT rec_idx, CASE WHEN lag(qname) OVER (ORDER BY rec_idx) = qname THEN 0 ELSE 1 END AS starts FROM alignments)")
def consecutive_reads(spark, d):
    return order.consecutive_runs(view(spark, d, "alignments")).select("rec_idx", "run")


@query(ALN + "SELECT rname, rec_idx FROM (SELECT rname, rec_idx, pos, lag(pos) OVER (PARTITION BY rname ORDER BY rec_idx) AS before FROM alignments) WHERE pos < before")
def unsorted_records(spark, d):
    return order.unsorted(view(spark, d, "alignments")).select("rname", "rec_idx")


@query(ALN + "SELECT rname, CAST(pos AS BIGINT) AS location, CAST(seq_length AS BIGINT) AS length FROM alignments UNION SELECT rname, pos + 1, seq_length FROM alignments")
def range_union(spark, d):
    one = view(spark, d, "alignments").select("rname", F.col("pos").cast("long").alias("location"), F.col("seq_length").alias("length"))
    return order.distinct_union(one, one.withColumn("location", F.col("location") + 1))


@query(cte("alignments", "variants") + "SELECT rname AS name, CAST(pos AS BIGINT) AS at, 0 AS part FROM alignments UNION ALL SELECT chrom, pos, 1 FROM variants")
def concatenation(spark, d):
    """Places of reads and of variants, two tables of the same columns."""
    reads = view(spark, d, "alignments").select(F.col("rname").alias("name"), F.col("pos").cast("long").alias("at"))
    return order.concatenate(reads, view(spark, d, "variants").select(F.col("chrom").alias("name"), F.col("pos").alias("at")))


@query(ALN + "SELECT rec_idx, 0 AS part FROM alignments UNION ALL SELECT rec_idx, 1 FROM alignments")
def concatenation_whole(spark, d):
    df = view(spark, d, "alignments")
    return order.concatenate(df, df).select("rec_idx", "part")


# --------------------------------------------------------------------------- headers


@query(
    cte("refs")
    + """, parts AS (SELECT ref_idx, length, split_part(name, '/', 1) AS name, split_part(name, '/', 2) AS seq FROM refs),
    found AS (SELECT name, min(ref_idx) AS f, max(CASE WHEN seq = 's2' THEN length END) AS length, CASE name WHEN 'chr3' THEN 0 WHEN 'chr1' THEN 2 ELSE 9 END AS place FROM parts GROUP BY name)
    SELECT CAST(row_number() OVER (ORDER BY place, f) - 1 AS INT) AS out_idx, name, length FROM found"""
)
def output_references(spark, d):
    order = spark.createDataFrame([(0, "chr3"), (1, "chr8"), (2, "chr1"), (3, "chr3")], "place long, name string")
    return headers.output_references(view(spark, d, "refs"), "s2", order)


@query(cte("refs") + "SELECT 25 AS place, 'p.26' AS id, 'p' AS name, 'p --x' AS command, '1' AS version, 'p.25' AS previous UNION ALL SELECT ref_idx, concat('p.', CAST(ref_idx + 1 AS STRING)), 'p', 'c', '1', NULL FROM refs")
def append_program(spark, d):
    old = view(spark, d, "refs").select(F.col("ref_idx").alias("place"), F.concat(F.lit("p."), (F.col("ref_idx") + 1).cast("string")).alias("id"), F.lit("p").alias("name"), F.lit("c").alias("command"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("previous"))
    return headers.append_program(old, "p.", "p", "p --x", "1")



# --------------------------------------------------------------------------- co-ordinates


def _blocks(spark, d):
    return stored(coordinates.build_msa_index(view(spark, d, "aligned")))


ALIGNED = cte("aligned", "blocks")


@query(ALIGNED + "SELECT chr, seq_id, CAST(aln_start AS BIGINT) AS aln_start, CAST(seq_start AS BIGINT) AS seq_start, len FROM blocks")
def msa_blocks(spark, d):
    return _blocks(spark, d)


@query(cte("aligned") + "SELECT chr, count(*) AS sequences, CAST(max(length(seq)) AS BIGINT) AS aligned_length FROM aligned GROUP BY chr")
def list_index(spark, d):
    return coordinates.list_index(coordinates.aligned_lengths(view(spark, d, "aligned")))


@query(cte("aligned") + "SELECT chr, seq_id, CAST(length(replace(seq, '-', '')) AS BIGINT) AS seq_length FROM aligned")
def sequence_lengths(spark, d):
    return coordinates.sequence_lengths(_blocks(spark, d))


@query(ALIGNED + "SELECT chr, seq_id, CAST(aln_start AS BIGINT) AS aln_start, CAST(seq_start AS BIGINT) AS seq_start, len FROM blocks")
def merge_index(spark, d):
    blocks = _blocks(spark, d)
    return coordinates.merge_index(blocks.where("seq_id < 's2'"), blocks.where("seq_id >= 's2'"))


_PROJECT = """, p AS (SELECT {rows}),
    up AS (SELECT p.*, b.aln_start + p.pos - b.seq_start AS aln FROM p JOIN blocks b ON b.chr = p.chr AND b.seq_id = p.src AND p.pos >= b.seq_start AND p.pos < b.seq_start + b.len),
    down AS (SELECT up.*, row_number() OVER (PARTITION BY key ORDER BY b.aln_start DESC) AS place, b.seq_start AS s, b.aln_start AS a, b.len AS n FROM up LEFT JOIN blocks b ON b.chr = up.chr AND b.seq_id = 's0' AND b.aln_start <= up.aln),
    done AS (SELECT key, CAST(aln AS BIGINT) AS aln, CAST(coalesce(s + least(aln - a, n), 0) AS BIGINT) AS dst_pos, coalesce(aln - a >= n, true) AS dst_gap FROM down WHERE place = 1) """


@query(cte("aligned", "blocks", "variants") + _PROJECT.format(rows="var_id AS key, chrom AS chr, 's3' AS src, pos FROM variants") + "SELECT key AS var_id, aln, dst_pos, dst_gap FROM done")
def project_positions(spark, d):
    df = view(spark, d, "variants").withColumn("src", F.lit("s3")).withColumn("dst", F.lit("s0"))
    return coordinates.project_positions(df, _blocks(spark, d), chr_="chrom").select("var_id", "aln", "dst_pos", "dst_gap")


@query(
    cte("aligned", "blocks", "regions")
    + ", numbered AS (SELECT *, row_number() OVER () AS k FROM regions)"
    + _PROJECT.format(rows="k * 2 AS key, chr, 's3' AS src, lb AS pos FROM numbered UNION ALL SELECT k * 2 + 1, chr, 's3', rb FROM numbered")
    + "SELECT n.chr, a.dst_pos AS lb, b.dst_pos AS rb FROM numbered n JOIN done a ON a.key = n.k * 2 JOIN done b ON b.key = n.k * 2 + 1"
)
def lift_regions(spark, d):
    return coordinates.lift_regions(view(spark, d, "regions"), _blocks(spark, d), "s3", "s0")


@query(
    cte("aligned", "blocks", "alignments")
    + _PROJECT.format(rows="rec_idx AS key, split_part(rnext, '/', 1) AS chr, split_part(rnext, '/', 2) AS src, pnext AS pos FROM alignments WHERE rnext IS NOT NULL")
    + "SELECT rec_idx, CASE WHEN rnext IS NOT NULL THEN split_part(rnext, '/', 1) END AS mate_chr, dst_pos AS mate_pos FROM alignments LEFT JOIN done ON key = rec_idx"
)
def project_mates(spark, d):
    return project.project_mates(view(spark, d, "alignments"), _blocks(spark, d), "s0").select("rec_idx", "mate_chr", "mate_pos")


@query(cte("aligned") + "SELECT concat('>', chr, '/', seq_id, chr(10), regexp_replace(replace(seq, '-', ''), '(.{60})', '\\1' || chr(10), 'g')) AS fasta FROM aligned")
def unaligned_fasta(spark, d):
    from ..sources.sinks import fasta_records

    return fasta_records(view(spark, d, "aligned"), 60)


# --------------------------------------------------------------------------- projection


def _projected(spark, d, **how):
    reference = view(spark, d, "aligned").where("seq_id = 's0'").select(F.col("chr").alias("name"), T.ungapped(F.col("seq")).alias("seq"))
    return project.project_alignments(alignments(spark, d), _blocks(spark, d), stored(reference), "s0", **how)


#: The rules of projection base by base, before runs of indels are aligned anew: ``plain`` has the items of each CIGAR on s0.
_REWRITTEN = cte("aligned", "alignments", "items") + """,
    letters AS (SELECT chr, seq_id, i, substr(seq, CAST(i + 1 AS INT), 1) AS b FROM aligned, (SELECT unnest(range(6000)) AS i)),
    src AS (SELECT chr, seq_id, i, row_number() OVER (PARTITION BY chr, seq_id ORDER BY i) - 1 AS p FROM letters WHERE b <> '-'),
    dst AS (SELECT chr, i, b, coalesce(sum(CASE WHEN b <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rank FROM letters WHERE seq_id = 's0'),
    each AS (SELECT rec_idx, pos, k, j, op, op IN ('M', '=', 'X', 'D', 'N') AS on_ref, op IN ('M', '=', 'X', 'I', 'S') AS on_read FROM (
        SELECT *, unnest(range(n)) AS j FROM items SEMI JOIN (SELECT rec_idx FROM alignments WHERE (flag & 1540) = 0) USING (rec_idx))),
    walked AS (SELECT *, coalesce(sum(CAST(on_ref AS INT)) OVER w, 0) AS r, coalesce(sum(CAST(on_read AS INT)) OVER w, 0) AS q FROM each
        WINDOW w AS (PARTITION BY rec_idx ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    met AS (SELECT w.*, dst.rank, dst.b, substr(a.seq, CAST(w.q + 1 AS INT), 1) AS base FROM walked w JOIN alignments a USING (rec_idx)
        LEFT JOIN src ON w.on_ref AND src.chr = split_part(a.rname, '/', 1) AND src.seq_id = split_part(a.rname, '/', 2) AND src.p = w.pos + w.r
        LEFT JOIN dst ON dst.chr = src.chr AND dst.i = src.i),
    jumps AS (SELECT *, coalesce(rank - lag(rank + CASE WHEN b = '-' THEN 0 ELSE 1 END) OVER (PARTITION BY rec_idx, on_ref ORDER BY k, j), 0) AS jump FROM met),
    written AS (SELECT rec_idx, k, j, 0 AS turn, jump AS n, 'D' AS op FROM jumps WHERE on_ref UNION ALL
        SELECT rec_idx, k, j, 1, CASE WHEN on_ref AND NOT on_read AND b = '-' THEN 0 ELSE 1 END,
            CASE WHEN NOT on_ref THEN op WHEN NOT on_read THEN 'D' WHEN b = '-' THEN 'I' WHEN b = base THEN '=' ELSE 'X' END FROM jumps),
    changes AS (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY rec_idx ORDER BY k, j, turn) = op THEN 0 ELSE 1 END AS starts FROM written WHERE n > 0),
    places AS (SELECT rec_idx, min(rank) AS dst_pos FROM met WHERE on_ref GROUP BY rec_idx),
    plain AS (SELECT rec_idx, item, CAST(sum(n) AS BIGINT) AS n, min(op) AS op FROM (
        SELECT *, sum(starts) OVER (PARTITION BY rec_idx ORDER BY k, j, turn) AS item FROM changes) GROUP BY rec_idx, item)"""

#: Runs of indels of both kinds, where they lie on s0 and on the read.
_RANGES = """,
    lain AS (SELECT *, op IN ('I', 'D') AS indel, coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER w, 0) AS r, coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS q,
        item - row_number() OVER (PARTITION BY rec_idx, op IN ('I', 'D') ORDER BY item) AS run FROM plain WINDOW w AS (PARTITION BY rec_idx ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    runs AS (SELECT rec_idx, CAST(dst_pos + min(r) AS BIGINT) AS location, CAST(sum(CASE WHEN op = 'D' THEN n ELSE 0 END) AS BIGINT) AS length, CAST(min(q) AS BIGINT) AS read_at, CAST(sum(CASE WHEN op = 'I' THEN n ELSE 0 END) AS BIGINT) AS added
        FROM lain JOIN places USING (rec_idx) WHERE indel GROUP BY rec_idx, run, dst_pos HAVING count(DISTINCT op) = 2)"""


@query(_REWRITTEN + "SELECT rec_idx, CAST(dst_pos AS BIGINT) AS pos, string_agg(CAST(n AS STRING) || op, '' ORDER BY item) AS cigar FROM plain JOIN places USING (rec_idx) GROUP BY rec_idx, dst_pos")
def rewritten_alignments(spark, d):
    return _projected(spark, d, anew=False, columns=("rec_idx", "pos", "cigar")).select("rec_idx", "pos", C.render(F.col("cigar")).alias("cigar"))


@query(_REWRITTEN + _RANGES + """SELECT rec_idx, string_agg(CAST(read_at AS STRING) || ',' || CAST(read_at + added AS STRING), ',' ORDER BY read_at) AS xb, string_agg(CAST(location AS STRING) || ',' || CAST(location + length AS STRING), ',' ORDER BY read_at) AS yb
    FROM runs GROUP BY rec_idx""")
def realigned_parts(spark, d):
    """The tags XB and YB as text."""
    tagged = project.provenance_tags(_projected(spark, d, columns=project.PROVENANCE).where(F.size("xb") > 0))
    return tagged.select("rec_idx", *(F.regexp_replace(T.tag(F.col("tags"), n.upper()), "^I,", "").alias(n) for n in ("xb", "yb")))


@query()
def project_alignments(spark, d):
    df = _projected(spark, d, columns=("rec_idx", "qname", "rname", "pos", "cigar", "rnext", "pnext", "oa", "xb", "yb"))
    return df.select("rec_idx", "qname", "rname", "pos", C.render(F.col("cigar")).alias("cigar"), "rnext", "pnext", "oa", F.array_join("xb", ",").alias("xb"), F.array_join("yb", ",").alias("yb"))


@query(
    cte("aligned", "blocks", "alignments")
    + _PROJECT.format(rows="rec_idx AS key, split_part(rname, '/', 1) AS chr, split_part(rname, '/', 2) AS src, pos FROM alignments WHERE (flag & 1540) = 0")
    + """SELECT rec_idx, dst_pos AS pos, concat(rname, ',', CAST(a.pos + 1 AS STRING), ',', CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END, ',', cigar_text, ',', CAST(mapq AS STRING), ',;') AS oa FROM alignments a JOIN done ON key = rec_idx"""
)
def projected_places(spark, d):
    return _projected(spark, d, columns=("rec_idx", "pos", "oa"))


@query(ALN + "SELECT rec_idx, rname AS xr, CAST(pos AS STRING) AS xp, rnext AS yr, CAST(pnext AS STRING) AS yp, CAST(rec_idx AS STRING) AS xi FROM alignments WHERE (flag & 1540) = 0")
def provenance_tags(spark, d):
    tagged = project.provenance_tags(_projected(spark, d, columns=project.PROVENANCE))
    return tagged.select("rec_idx", *(T.tag(F.col("tags"), n.upper()).alias(n) for n in ("xr", "xp", "yr", "yp", "xi")))


@query(_REWRITTEN + _RANGES + "SELECT DISTINCT split_part(rname, '/', 1) AS rname, location, length FROM runs JOIN alignments USING (rec_idx)")
def realigned_ranges(spark, d):
    return project.realigned_ranges(_projected(spark, d, columns=("rname", "yb")))


# --------------------------------------------------------------------------- mapping quality


def _scored(df):
    return df.withColumn("o_rname", F.col("rname")).withColumn("o_pos", F.col("pos") + 1000).withColumn("o_rnext", F.col("rnext")).withColumn("o_pnext", F.col("pnext") + 1000)


_CASE = "CASE " + " ".join(f"WHEN apart >= {t} THEN CASE " + " ".join(f"WHEN share >= {s} THEN {q}" for s, q in sorted(row, reverse=True)) + " END" for t, row in sorted(mapq.DIFFERENCE_TABLE.items(), reverse=True)) + " END"
MAPQ_SQL = (
    ALN
    + f""", u AS (SELECT * FROM (SELECT *, rnext IS NOT NULL AS has_mate, min(CASE WHEN rnext IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY qname) AS lo, max(CASE WHEN rnext IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY qname) AS hi FROM alignments WHERE (flag & 4) = 0) WHERE lo = hi AND as_score IS NOT NULL),
    best AS (SELECT qname, rname, pos, max(as_score) AS s FROM u GROUP BY 1, 2, 3),
    lens AS (SELECT b.qname, b.rname, b.pos, b.s, max(u.seq_length) AS l FROM best b JOIN u ON u.qname = b.qname AND u.rname = b.rname AND u.pos = b.pos AND u.as_score = b.s GROUP BY 1, 2, 3, 4),
    p AS (SELECT u.*, as_score + coalesce(m.s, 0) AS total, coalesce(m.l, 0) AS mate_length, CASE WHEN has_mate THEN '' ELSE seq END AS own_seq,
        CASE WHEN has_mate AND (rnext < u.rname OR (rnext = u.rname AND pnext < u.pos)) THEN concat(rnext, ':', pnext, ' ', u.rname, ':', u.pos) ELSE concat(u.rname, ':', u.pos, ' ', coalesce(rnext, ''), ':', coalesce(CAST(pnext AS STRING), '')) END AS places
        FROM u LEFT JOIN lens m ON m.qname = u.qname AND m.rname = u.rnext AND m.pos = u.pnext),
    rivals AS (SELECT qname, own_seq, places, max(total) AS total FROM p GROUP BY 1, 2, 3),
    n AS (SELECT p.rec_idx, max(CASE WHEN r.places <> p.places AND r.total <= p.total THEN r.total END) AS next_score, max(CASE WHEN r.total > p.total THEN 1 ELSE 0 END) AS beaten
        FROM p JOIN rivals r ON r.qname = p.qname AND r.own_seq = p.own_seq GROUP BY p.rec_idx),
    v AS (SELECT p.rec_idx, p.mapq AS old_mapq, CAST(p.total AS DOUBLE) AS total, n.next_score, n.beaten, (CAST(-0.6 AS DOUBLE) + CAST(-0.6 AS DOUBLE) * seq_length) + CASE WHEN mate_length = 0 THEN 0 ELSE CAST(-0.6 AS DOUBLE) + CAST(-0.6 AS DOUBLE) * mate_length END AS least FROM p JOIN n USING (rec_idx)),
    w AS (SELECT *, greatest(coalesce(next_score, least), least) AS following, greatest(1.0, -least) AS span FROM v),
    x AS (SELECT *, (total - least) / span AS share, (total - following) / span AS apart FROM w)
    SELECT rec_idx, old_mapq, CAST(CASE WHEN next_score IS NULL AND beaten = 1 THEN 255 WHEN total < least THEN 0 WHEN total = following THEN CASE WHEN share >= 0.67 THEN 1 ELSE 0 END ELSE {_CASE} END AS INT) AS mapq, total AS pair_score FROM x"""
)


@query(MAPQ_SQL)
def recalculate_mapq(spark, d):
    return mapq.recalculate_mapq(_scored(alignments(spark, d))).select("rec_idx", "old_mapq", "mapq", "pair_score")


@query(
    ITEMS
    + _BASES
    + """, spans AS (SELECT rec_idx, k, op, r + j AS r, q + j AS q, seq, n, 1 AS each FROM (SELECT b.rec_idx, b.k, b.op, p.r, p.q, p.seq, b.j, 1 AS n FROM bases b JOIN placed p ON p.rec_idx = b.rec_idx AND p.k = b.k UNION ALL
            SELECT rec_idx, k, op, r, q, seq, j, 1 FROM placed, LATERAL (SELECT unnest(range(CAST(n AS INT))) AS j) WHERE op IN ('=', 'X'))),
    costs AS (SELECT s.rec_idx, CASE WHEN op = '=' THEN CASE WHEN substr(s.seq, CAST(q AS INT), 1) IN ('A', 'C', 'G', 'T') THEN 0 ELSE 1 END
            WHEN substr(s.seq, CAST(q AS INT), 1) NOT IN ('A', 'C', 'G', 'T') OR substr(ref, CAST(r AS INT), 1) = 'N' THEN 1
            ELSE floor(least(ascii(substr(a.qual, CAST(q AS INT), 1)) - 33, 40) / 40.0 * 4 + 2) END AS cost FROM spans s JOIN alignments a USING (rec_idx), reference
        UNION ALL SELECT rec_idx, CASE WHEN coalesce(lag(op) OVER (PARTITION BY rec_idx ORDER BY k), '') IN ('I', 'D') THEN 0 ELSE 5 END + 3 * n FROM items WHERE op NOT IN ('H', 'P', 'N') QUALIFY op IN ('I', 'D')),
    summed AS (SELECT rec_idx, -CAST(sum(cost) AS DOUBLE) AS new_score FROM costs GROUP BY rec_idx)
    SELECT rec_idx, new_score, CASE WHEN as_score IS NOT NULL THEN CAST(as_score AS STRING) END AS old_score, CAST(CAST(floor(new_score) AS BIGINT) AS STRING) AS as_tag FROM alignments JOIN summed USING (rec_idx)"""
)
def rescore(spark, d):
    ref = F.repeat(F.lit("ACGTNACCA"), F.lit(600))
    df = alignments(spark, d)
    at = F.col("pos").cast("long")
    df = df.withColumn("ref_n", C.reference_n_positions(F.col("cigar"), ref, at)).withColumn("cigar", C.to_sequence_match(F.col("cigar"), F.col("seq"), ref, at))
    df = df.withColumn("new_score", mapq.rescore(F.col("cigar"), F.col("seq"), F.col("qual"), F.col("ref_n")))
    tags = mapq.rescored_tags(df)
    return tags.select("rec_idx", "new_score", T.tag(F.col("tags"), "XS").alias("old_score"), T.tag(F.col("tags"), "AS").alias("as_tag"))


# --------------------------------------------------------------------------- support

_READS = """, reads AS (SELECT rec_idx, split_part(rname, '/', 1) AS chrom, pos, seq, any_value(pos) + sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) AS e, any_value(pos) + sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') AND k <= last THEN n ELSE 0 END) AS anchor
    FROM (SELECT a.rec_idx, rname, flag, a.pos, seq, k, n, op, max(CASE WHEN op IN ('M', '=', 'X') THEN k END) OVER (PARTITION BY rec_idx) AS last FROM alignments a JOIN items i USING (rec_idx)) WHERE (flag & 3588) = 0 GROUP BY rec_idx, rname, pos, seq) """


def _reads(spark, d):
    return filters.countable(alignments(spark, d))


@query(cte("alignments", "items", "variants") + _READS + "SELECT var_id, rec_idx AS r_idx FROM variants v JOIN reads r ON r.chrom = v.chrom AND r.pos <= v.pos AND v.pos < r.e AND v.pos + v.ref_len < r.anchor")
def support_join(spark, d):
    return support.supported_pairs(view(spark, d, "variants"), _reads(spark, d), contig_prefix=True)


@query(cte("alignments", "items", "variants") + _READS + "SELECT var_id, rec_idx AS r_idx FROM variants v JOIN reads r ON r.chrom = v.chrom AND r.pos <= v.pos AND v.pos < r.e AND v.pos + v.ref_len <= r.e")
def support_join_left_anchored(spark, d):
    return support.supported_pairs(view(spark, d, "variants"), _reads(spark, d), left_anchored=True, contig_prefix=True)


#: The allele that a read shows, item by item: phase 0 reads up to the end of the allele, 1 what goes on with the item that ended there, 2 is past it.
_SHOWN = """, cigars AS (SELECT rec_idx, list(struct_pack(n := n, op := op) ORDER BY k) AS ops FROM items GROUP BY rec_idx),
    walk(var_id, rec_idx, k, pos, seq, ops, here, q, r, a, shown, phase, kind) AS (
        SELECT v.var_id, r.rec_idx, 1, v.pos, r.seq, c.ops, CAST(r.pos AS BIGINT), CAST(0 AS BIGINT), v.ref_len, v.alt_len, '', 0, ''
        FROM variants v JOIN reads r ON r.chrom = v.chrom AND r.pos <= v.pos AND v.pos < r.e AND v.pos + v.ref_len < r.anchor JOIN cigars c USING (rec_idx)
        UNION ALL
        SELECT var_id, rec_idx, k + 1, pos, seq, ops, here2, q2 + CASE WHEN phase = 0 AND m = 0 THEN 0 WHEN phase = 0 AND op IN ('M', '=', 'X') THEN take WHEN phase = 0 AND op IN ('I', 'S') THEN m WHEN phase = 1 AND goes AND op IN ('I', 'S') THEN n ELSE 0 END,
            r2, CASE WHEN phase = 0 AND m > take AND r2 = 0 AND op IN ('M', '=', 'X') THEN 0 ELSE a2 END,
            shown || CASE WHEN phase = 0 AND m = 0 THEN '' WHEN phase = 0 AND op IN ('M', '=', 'X') THEN substr(seq, q2 + 1, take) WHEN phase = 0 AND op = 'I' OR phase = 1 AND goes AND op = 'I' THEN substr(seq, q2 + 1, n)
                WHEN phase = 0 AND op IN ('D', 'N') AND r < m AND shown NOT LIKE '%~' OR phase = 1 AND goes AND op IN ('D', 'N') AND shown NOT LIKE '%~' THEN '~' ELSE '' END,
            CASE WHEN phase = 0 AND m > 0 AND r2 = 0 AND (a2 = 0 OR m > take AND op IN ('M', '=', 'X')) THEN CASE WHEN m > take AND op IN ('M', '=', 'X') THEN 2 ELSE 1 END WHEN phase = 1 AND NOT goes THEN 2 ELSE phase END,
            CASE WHEN phase = 0 THEN kin ELSE kind END
        FROM (SELECT *, CASE WHEN m = 0 OR phase > 0 THEN a WHEN op IN ('M', '=', 'X') THEN greatest(0, a - take) WHEN op IN ('I', 'S') THEN greatest(0, a - m) ELSE a END AS a2,
                CASE WHEN m = 0 OR phase > 0 THEN r WHEN op IN ('M', '=', 'X') THEN r - take WHEN op IN ('D', 'N') THEN greatest(0, r - m) ELSE r END AS r2
            FROM (SELECT *, least(m, r) AS take, here + CASE WHEN phase = 0 AND op IN ('M', '=', 'X', 'D', 'N') THEN n - m ELSE 0 END AS here2, q + CASE WHEN phase = 0 AND op IN ('M', '=', 'X', 'I', 'S') THEN n - m ELSE 0 END AS q2, op = 'S' OR kin = kind AND op NOT IN ('M', '=', 'X') AS goes
                FROM (SELECT w.*, ops[k].n AS n, ops[k].op AS op, CASE ops[k].op WHEN 'N' THEN 'D' WHEN 'P' THEN 'H' ELSE ops[k].op END AS kin,
                    CASE WHEN here >= pos THEN ops[k].n WHEN ops[k].op IN ('M', '=', 'X', 'D', 'N') THEN greatest(0, ops[k].n - (pos - here)) ELSE 0 END AS m FROM walk w WHERE k <= len(ops) AND phase < 2)))),
    shown AS (SELECT var_id, rec_idx, arg_max(shown, k) AS allele FROM walk GROUP BY var_id, rec_idx HAVING arg_max(phase, k) > 0),
    support AS (SELECT var_id, allele, count(*) AS n FROM shown GROUP BY var_id, allele) """
_SUPPORT_SQL = cte("alignments", "items", "variants").replace("WITH ", "WITH RECURSIVE ", 1) + _READS + _SHOWN


@query(_SUPPORT_SQL + "SELECT var_id, allele, n FROM support")
def supporting_reads(spark, d):
    return support.supporting_reads(view(spark, d, "variants"), _reads(spark, d), contig_prefix=True)


_BIAS = """, bias AS (SELECT var_id, CAST(sum(CASE WHEN allele = ref THEN n ELSE 0 END) AS BIGINT) AS ref_n, CAST(sum(CASE WHEN allele = alt AND alt <> ref THEN n ELSE 0 END) AS BIGINT) AS alt_n FROM support JOIN variants USING (var_id) GROUP BY var_id) """


def _bias(spark, d):
    return support.allele_bias(view(spark, d, "variants"), _reads(spark, d), 2, contig_prefix=True)


@query(_SUPPORT_SQL + _BIAS + "SELECT var_id, ref_n, alt_n, ref_n / (ref_n + alt_n) AS ratio FROM bias WHERE ref_n + alt_n >= 2")
def reference_bias(spark, d):
    return _bias(spark, d)


@query(_SUPPORT_SQL + _BIAS + "SELECT CAST(sum(ref_n) AS BIGINT) AS ref_n, CAST(sum(alt_n) AS BIGINT) AS alt_n, sum(ref_n) / (sum(ref_n) + sum(alt_n)) AS ratio FROM bias WHERE ref_n + alt_n >= 2")
def overall_bias(spark, d):
    return support.overall_bias(_bias(spark, d))


@query(
    cte("alignments", "items", "variants")
    + _READS
    + """, why AS (SELECT CASE WHEN chrom <> 'chr1' THEN 'chromosome mismatches' WHEN zygosity <> 1 THEN 'zygosity mismatches' WHEN EXISTS (SELECT 1 FROM reads r WHERE r.chrom = v.chrom AND r.pos <= v.pos AND v.pos < r.e AND v.pos + v.ref_len < r.anchor) THEN 'counted' ELSE 'zero coverage' END AS metric FROM variants v)
    SELECT metric, count(*) AS n FROM why GROUP BY metric UNION ALL SELECT 'total variants', count(*) FROM variants UNION ALL SELECT 'reads processed', count(*) FROM alignments UNION ALL SELECT 'flags not matched', count(*) FROM alignments WHERE (flag & 3588) <> 0"""
)
def support_metrics(spark, d):
    return support.support_metrics(view(spark, d, "variants"), alignments(spark, d), "chr1", 1, contig_prefix=True)


_COUNTED = """, why AS (SELECT v.*, CASE WHEN chrom <> 'chr1' THEN 'chromosome mismatches' WHEN NOT EXISTS (SELECT 1 FROM regions r WHERE r.chr = v.chrom AND v.pos < r.rb AND r.lb < v.pos + length(v.ref)) THEN 'position mismatches'
        WHEN zygosity <> 1 THEN 'zygosity mismatches' END AS metric FROM variants v),
    outcomes AS (SELECT a.rec_idx, CASE WHEN (flag & 3844) <> 0 THEN 'flags not matched' WHEN rname IS NULL OR NOT starts_with(rname, 'chr1') THEN 'reference mismatches' WHEN rnext IS NULL OR NOT starts_with(rnext, 'chr1') THEN 'mate reference mismatches'
        WHEN NOT EXISTS (SELECT 1 FROM why w WHERE w.metric IS NULL AND w.chrom = split_part(a.rname, '/', 1) AND a.pos <= w.pos AND w.pos < r.e) THEN 'position mismatches' ELSE 'matched alignments' END AS metric
        FROM alignments a JOIN all_ends r USING (rec_idx)),
    done AS (SELECT var_id, coalesce(metric, CASE WHEN NOT EXISTS (SELECT 1 FROM all_ends r JOIN outcomes o USING (rec_idx) JOIN alignments a USING (rec_idx)
        WHERE o.metric = 'matched alignments' AND split_part(a.rname, '/', 1) = w.chrom AND r.pos <= w.pos AND w.pos < r.e AND w.pos + w.ref_len < r.anchor) THEN 'zero coverage' END) AS metric FROM why w),
    names(line, metric) AS (VALUES ('S', 'chromosome mismatches'), ('S', 'position mismatches'), ('S', 'zygosity mismatches'), ('S', 'zero coverage'), ('T', 'flags not matched'), ('T', 'reference mismatches'), ('T', 'mate reference mismatches'), ('T', 'position mismatches'), ('T', 'matched alignments')),
    found AS (SELECT 'S' AS line, metric FROM done UNION ALL SELECT 'T', metric FROM outcomes)
    SELECT n.line, n.metric, count(f.metric) AS n FROM names n LEFT JOIN found f ON f.line = n.line AND f.metric = n.metric GROUP BY ALL
    UNION ALL SELECT 'S', 'total variants', count(*) FROM variants UNION ALL SELECT 'T', 'reads processed', count(*) FROM alignments"""
_ALL_ENDS = """, all_ends AS (SELECT rec_idx, pos, pos + sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) AS e, pos + sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') AND k <= last THEN n ELSE 0 END) AS anchor
    FROM (SELECT *, max(CASE WHEN op IN ('M', '=', 'X') THEN k END) OVER (PARTITION BY rec_idx) AS last FROM items) GROUP BY rec_idx, pos)"""


@query(cte("alignments", "items", "variants", "regions") + _ALL_ENDS + _COUNTED)
def report_counters(spark, d):
    return support.report_counters(view(spark, d, "variants"), alignments(spark, d), view(spark, d, "regions"), "chr1", 1, prefix="chr1", primary_only=True, same_ref=True, contig_prefix=True)


@query(cte("variants") + "SELECT var_id, pos, CASE WHEN var_id % 5 <> 0 THEN ref END AS left_alleles, CASE WHEN var_id % 7 <> 0 THEN CASE WHEN var_id % 11 = 0 THEN 'X' ELSE ref END END AS right_alleles FROM variants WHERE ((var_id % 5 = 0) <> (var_id % 7 = 0)) OR (var_id % 11 = 0 AND var_id % 5 <> 0 AND var_id % 7 <> 0)")
def support_diff(spark, d):
    v = view(spark, d, "variants")
    left = v.where("var_id % 5 <> 0").select("var_id", "pos", F.col("ref").alias("alleles"))
    right = v.where("var_id % 7 <> 0").select("var_id", "pos", F.when(F.col("var_id") % 11 == 0, "X").otherwise(F.col("ref")).alias("alleles"))
    return support.support_diff(left, right)


@query(cte("alignments") + "SELECT rec_idx, rname, pos FROM (SELECT *, row_number() OVER (PARTITION BY rname, pos ORDER BY rec_idx) AS k FROM alignments) WHERE k = 1")
def first_per_position(spark, d):
    return support.first_per_position(view(spark, d, "alignments")).select("rec_idx", "rname", "pos")


@query(cte("variants", "regions") + "SELECT var_id, lb, rb FROM variants JOIN regions ON chr = chrom AND lb <= pos AND pos < rb")
def interval_join(spark, d):
    return overlap.containing_by_place(view(spark, d, "variants"), "var_id", "pos", view(spark, d, "regions"), "lb", "rb", ("chrom", "chr"), width=256)


# --------------------------------------------------------------------------- streams


def _streamed(spark, d, table: str, make, name: str) -> DataFrame:
    """Drains the table as a stream through ``make`` and gives the final state."""
    file = f"{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/{file}").schema).option("pathGlobFilter", file).parquet(d)
    q = make(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query(ORACLES["mapq_histogram"])
def stream_mapq_histogram(spark, d):
    return _streamed(spark, d, "events", lambda s: streaming.running_histogram(view_of(spark, s, "alignments")), "stream_mapq_histogram")


@query(ALN + "SELECT rname, count(*) AS n FROM alignments GROUP BY rname")
def stream_contig_counts(spark, d):
    return _streamed(spark, d, "events", lambda s: streaming.running_contig_counts(view_of(spark, s, "alignments")), "stream_contig_counts")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapq_histogram(spark, sf_dir)
