"""Readers of text formats: SAM, VCF, BED, FASTA and their indices, aligned sequences, name lists.

All return DataFrames; compressed files are read by Spark's codecs.  Lines of one file are split over tasks where the
format allows it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..schema import ALIGNMENTS, REGIONS
from .bgzf import indexed, read_indexed_fasta

GZI_ENTRY = "<QQ"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(rec_idx, value): lines with numbers that grow within each file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("rec_idx"), "value")


def _field(k: int) -> Column:
    return F.get(F.split("value", "\t"), F.lit(k))


def _or_null(c: Column, mark: str = "*") -> Column:
    return F.when(c != mark, c)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text (also ``.sam.gz``); rec_idx grows in the order of the file."""
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    rname = _or_null(_field(2))
    rnext = F.when(_field(6) == "=", rname).otherwise(_or_null(_field(6)))
    place = lambda k: F.when(_field(k).cast("int") > 0, _field(k).cast("int") - 1)
    tags = F.slice(F.split("value", "\t"), 12, F.greatest(F.size(F.split("value", "\t")) - 11, F.lit(0)))
    columns = {
        "rec_idx": F.col("rec_idx"), "qname": _or_null(_field(0)), "flag": _field(1).cast("int"), "rname": rname, "pos": place(3), "mapq": _field(4).cast("int"), "cigar": C.parse(_field(5)),
        "rnext": rnext, "pnext": place(7), "tlen": _field(8).cast("int"), "seq": _or_null(_field(9)), "qual": _or_null(_field(10)),
        "tags": F.map_from_entries(F.transform(tags, lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(4), F.length(t))))),
    }
    return lines.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in ALIGNMENTS])


def read_sam_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """References (ref_idx, name, length), programs (place, id, name, command, version, previous), read groups (place, id, fields), comments (place, text)."""
    lines = numbered_lines(spark, path).where(F.col("value").startswith("@"))
    place = (F.row_number().over(Window.partitionBy("kind").orderBy("rec_idx")) - 1).alias("place")
    lines = lines.withColumn("kind", F.substring("value", 2, 2)).withColumn("text", F.substring(F.col("value"), F.lit(5), F.length("value")))
    fields = F.map_from_entries(F.transform(F.filter(F.split("text", "\t"), lambda t: F.substring(t, 3, 1) == ":"), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(4), F.length(t)))))
    lines = lines.select("kind", place, "text", F.when(F.col("kind") != "CO", fields).alias("f"))
    of = lambda kind: lines.where(F.col("kind") == kind)
    get = lambda k: F.try_element_at("f", F.lit(k))
    refs = of("SQ").select(F.col("place").alias("ref_idx"), get("SN").alias("name"), get("LN").cast("long").alias("length"))
    programs = of("PG").select("place", get("ID").alias("id"), get("PN").alias("name"), get("CL").alias("command"), get("VN").alias("version"), get("PP").alias("previous"))
    return refs, programs, of("RG").select("place", get("ID").alias("id"), F.col("f").alias("fields")), of("CO").select("place", "text")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants of one sample; POS becomes 0-based, ``info`` maps keys to values (null for flags), ``gt`` holds the alleles, null where missing."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    info = F.map_from_entries(F.transform(F.split(_field(7), ";"), lambda t: F.struct(F.substring_index(t, "=", 1), F.when(F.instr(t, "=") > 0, F.substring(t, F.instr(t, "=") + 1, F.length(t))))))
    at = F.array_position(F.split(_field(8), ":"), "GT")
    sample = F.when(at > 0, F.get(F.split(_field(9), ":"), (at - 1).cast("int")))
    gt = F.transform(F.split(sample, "[/|]"), lambda a: F.when(a != ".", a.cast("int")))
    return lines.select(
        _field(0).alias("chrom"), (_field(1).cast("long") - 1).alias("pos"), F.when(_field(2) == ".", F.array().cast("array<string>")).otherwise(F.split(_field(2), ";")).alias("ids"), _field(3).alias("ref"),
        F.split(_field(4), ",").alias("alts"), _or_null(_field(5), ".").alias("qual"), _field(6).alias("filter"), F.when(_field(7) == ".", F.create_map().cast("map<string,string>")).otherwise(info).alias("info"), gt.alias("gt"),
    )


def variant_alleles(variants: DataFrame) -> DataFrame:
    """Adds alt, ref_len (to INFO END where given) and alt_len (0 for <DEL>); an error for several ALTs or other symbols."""
    from ..operators.support import variant_end

    alt = F.get("alts", F.lit(0))
    wrong = (F.size("alts") != 1) | (alt.startswith("<") & ~alt.startswith("<DEL"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("one plain ALT or <DEL> is needed at "), "chrom", F.lit(":"), F.col("pos").cast("string")))).otherwise(alt)
    end = variant_end(F.col("pos"), F.col("ref"), F.col("info"))
    return variants.withColumn("alt", checked).withColumn("ref_len", end - F.col("pos")).withColumn("alt_len", F.when(F.col("alt").startswith("<DEL"), F.lit(0)).otherwise(F.length("alt")).cast("long"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.length("value") > 0))
    return lines.select(*[_field(k).cast(f.dataType).alias(f.name) for k, f in enumerate(REGIONS)])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq): records are cut where a line begins with ``>``, so one is read by one task and many are spread; a header may hold others."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.length(F.regexp_replace("value", "\\s", "")) > 0)
    head = F.regexp_extract("value", "^([^\n\r]*)", 1)
    body = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), "\\s", "")
    return records.select(F.regexp_extract(head, "^(\\S*)", 1).alias("name"), F.regexp_extract(head, "^\\S*\\s*(.*)$", 1).alias("description"), body.alias("seq"))


def read_fasta_pieces(spark: SparkSession, path: str, width: int = 1 << 20) -> DataFrame:
    """(name, description, start, seq): records in pieces of whole lines, about ``width`` bases each, from base ``start``.

    A file is split anywhere, as text is.  Lines of a split are numbered and summed within it; of each split only its last record's header and
    bases meet those of the file's other splits, which gives the record and the offset of the lines before a split's first header.
    Records without bases have no piece.  A line is never cut, so no row holds a record whose lines are folded.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    head = F.col("value").startswith(">")
    split = Window.partitionBy("file", "block").orderBy("line")
    lines = lines.withColumn("rec", F.sum(head.cast("long")).over(split)).withColumn("bases", F.when(head, "").otherwise(F.regexp_replace("value", r"\s", ""))).withColumn("n", F.length("bases").cast("long"))
    record = Window.partitionBy("file", "block", "rec").orderBy("line")
    lines = lines.withColumn("header", F.first(F.when(head, F.col("value"))).over(record.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("at", F.coalesce(F.sum("n").over(record.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    tails = lines.groupBy("file", "block", "rec").agg(F.max("header").alias("header"), F.sum("n").alias("n"))
    tails = tails.groupBy("file", "block").agg(F.max_by(F.struct("rec", "header", "n"), "rec").alias("tail")).select("file", "block", "tail.*")
    order = Window.partitionBy("file").orderBy("block")
    chain = Window.partitionBy("file", "chain").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("chain", F.sum(F.col("header").isNotNull().cast("long")).over(order))
    tails = tails.withColumn("c_head", F.first("header").over(chain)).withColumn("c_record", F.first(F.concat_ws(":", "block", "rec")).over(chain)).withColumn("c_n", F.sum("n").over(chain))
    carried = tails.select(F.col("file").alias("c_file"), F.col("block").alias("c_block"), *(F.lag(x).over(order).alias(x) for x in ("c_head", "c_record", "c_n")))

    met = lines.where(~head & (F.col("n") > 0)).join(carried, (F.col("file") == F.col("c_file")) & (F.col("block") == F.col("c_block")))
    own = F.col("rec") > 0
    placed = met.select(
        "file", "bases", F.when(own, F.col("header")).otherwise(F.col("c_head")).alias("header"), F.when(own, F.concat_ws(":", "block", "rec")).otherwise(F.col("c_record")).alias("record"),
        F.when(own, F.col("at")).otherwise(F.col("at") + F.coalesce("c_n", F.lit(0))).alias("at"),
    )
    pieces = placed.where("header IS NOT NULL").groupBy("file", "record", "header", F.floor(F.col("at") / width).alias("piece")).agg(F.min("at").alias("start"), F.sort_array(F.collect_list(F.struct("at", "bases"))).alias("parts"))
    title = F.expr("substring(header, 2)")
    return pieces.select(F.regexp_extract(title, r"^(\S*)", 1).alias("name"), F.regexp_extract(title, r"^\S*\s*(.*)$", 1).alias("description"), "start", F.array_join(F.transform("parts", lambda x: x["bases"]), "").alias("seq"))


def read_a2m_pieces(spark: SparkSession, path: str, width: int = 1 << 20) -> DataFrame:
    """Aligned sequences as read_a2m() gives them, in pieces (chr, seq_id, start, seq) from column ``start``."""
    records = read_fasta_pieces(spark, path, width)
    return records.select(F.col("name").alias("chr"), F.get(F.split("description", "\t"), F.lit(0)).alias("seq_id"), "start", "seq")


def read_a2m(spark: SparkSession, path: str) -> DataFrame:
    """Aligned sequences (chr, seq_id, seq) of gapped FASTA whose header is chromosome, tab, sequence."""
    records = read_fasta(spark, path)
    return records.select(F.col("name").alias("chr"), F.get(F.split("description", "\t"), F.lit(0)).alias("seq_id"), "seq")


def read_sequence_list(spark: SparkSession, path: str) -> DataFrame:
    """(chr, seq_id, path) of a tab-separated list; an error names the line that lacks a field."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    bad = F.raise_error(F.concat(F.lit("three tab-separated fields are needed: "), "value"))
    return lines.select(F.when(F.size(F.split("value", "\t")) == 3, _field(0)).otherwise(bad).alias("chr"), _field(1).alias("seq_id"), _field(2).alias("path"))


def read_raw_sequences(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """Aligned sequences (chr, seq_id, seq) of a list: every file is a sequence, final line ends aside; gz and bz2 are unpacked."""
    paths = [r["path"] for r in listed.select("path").distinct().collect()]  # a list written by hand names few files
    texts = spark.read.text(paths, wholetext=True).select(F.regexp_replace("value", "[\r\n]+$", "").alias("seq"), F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"))
    return listed.join(texts, "path").select("chr", "seq_id", "seq")


def read_names(spark: SparkSession, path: str, column: str = "qname") -> DataFrame:
    return spark.read.text(path).where(F.length("value") > 0).select(F.col("value").alias(column))


def read_reference_order(spark: SparkSession, path: str) -> DataFrame:
    """(place, name): first fields of the lines, so a .fai does as well."""
    return numbered_lines(spark, path).where(F.length("value") > 0).select(F.col("rec_idx").alias("place"), _field(0).alias("name"))


def read_reference_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, new_name): the second field, if there is one, is the new name."""
    return spark.read.text(path).where(F.length("value") > 0).select(_field(0).alias("name"), _field(1).alias("new_name"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases long, line_width long")


def read_gzi(spark: SparkSession, path: str) -> DataFrame:
    """(compressed, uncompressed) block starts of a bgzip index, the first block's (0, 0) included."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                (n,) = struct.unpack_from("<Q", content)
                if len(content) < 8 + 16 * n:
                    raise ValueError("the index is shorter than its count says")
                pairs = [*struct.iter_unpack(GZI_ENTRY, content[8 : 8 + 16 * n])]
                if not pairs or pairs[0] != (0, 0):
                    pairs.insert(0, (0, 0))
                if pairs != sorted(pairs):
                    raise ValueError("the index isn't sorted")
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["compressed", "uncompressed"])

    return files.mapInArrow(run, "compressed long, uncompressed long")


def read_reference(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(name, seq) of FASTA, plain or compressed, for all or the named sequences.

    Named sequences of a bgzip file with .fai and .gzi beside it, on a store that executors open, are read by seeking; a
    name that the index lacks is an error then.
    """
    if names is not None and path.endswith((".gz", ".bgz")) and indexed(path):
        pieces = read_indexed_fasta(spark, path, names).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("p"))  # a sequence is a row here in any case
        return pieces.select("name", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))
    df = read_fasta(spark, path).select("name", "seq")
    return df if names is None else df.where(F.col("name").isin(*names))


def read_coverage(spark: SparkSession, path: str, rname: str) -> DataFrame:
    """A written coverage table (POSITION, COVERAGE) of one reference."""
    df = spark.read.csv(path, sep="\t", header=True, schema="POSITION long, COVERAGE long")
    return df.select(F.lit(rname).alias("rname"), F.col("POSITION").alias("position"), F.col("COVERAGE").alias("coverage"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(var_id, chrom, pos, ids, ref, alts, alleles): V lines of a support report with their R lines as ``n allele`` texts in one ordered string.

    Lines are numbered within the splits of a file; R lines before a split's first V line belong to the last one of the splits before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.where(F.substring("value", 1, 2).isin("V\t", "R\t")).withColumn("is_v", F.col("value").startswith("V"))
    lines = lines.withColumn("rec", F.sum(F.col("is_v").cast("long")).over(Window.partitionBy("file", "block").orderBy("line")))
    last = lines.groupBy("file", "block").agg(F.max("rec").alias("most"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(F.col("file").alias("l_file"), F.col("block").alias("l_block"), F.last(F.when(F.col("most") > 0, F.concat_ws(":", "block", "most")), True).over(past).alias("carried"))
    lines = lines.join(last, (F.col("file") == F.col("l_file")) & (F.col("block") == F.col("l_block")))
    lines = lines.withColumn("g", F.struct("file", F.when(F.col("rec") > 0, F.concat_ws(":", "block", "rec")).otherwise(F.col("carried")).alias("of")))
    v = lines.where("is_v").select("g", _field(1).alias("chrom"), _field(2).cast("long").alias("pos"), _field(3).alias("ids"), _field(4).alias("ref"), _field(5).alias("alts"))
    r = lines.where("NOT is_v").select("g", F.concat_ws(" ", _field(1), _field(2)).alias("line")).groupBy("g").agg(F.array_join(F.sort_array(F.collect_list("line")), ";").alias("alleles"))
    return v.join(r, "g", "left").select(F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ids", "ref", "alts").alias("var_id"), "chrom", "pos", "ids", "ref", "alts", F.coalesce("alleles", F.lit("")).alias("alleles"))
