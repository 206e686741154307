"""Column types of the tables that the operators take and give."""

from __future__ import annotations

from pyspark.sql import types as T

CIGAR = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("op", T.StringType())]))
CIGAR_DDL = "array<struct<n:int,op:string>>"

#: An alignment; positions are 0-based, tags map a two-character name to "type:value".
ALIGNMENTS = T.StructType(
    [
        T.StructField("rec_idx", T.LongType()),
        T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("rname", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", CIGAR),
        T.StructField("rnext", T.StringType()),
        T.StructField("pnext", T.IntegerType()),
        T.StructField("tlen", T.IntegerType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: A run of an aligned sequence without gaps: columns aln_start.. of the alignment hold positions seq_start.. of the sequence.
MSA_BLOCKS = T.StructType(
    [
        T.StructField("chr", T.StringType()),
        T.StructField("seq_id", T.StringType()),
        T.StructField("aln_start", T.LongType()),
        T.StructField("seq_start", T.LongType()),
        T.StructField("len", T.LongType()),
    ]
)

REGIONS = T.StructType([T.StructField("chr", T.StringType()), T.StructField("lb", T.LongType()), T.StructField("rb", T.LongType())])

VARIANTS = T.StructType(
    [
        T.StructField("chrom", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("ids", T.ArrayType(T.StringType())),
        T.StructField("ref", T.StringType()),
        T.StructField("alts", T.ArrayType(T.StringType())),
        T.StructField("qual", T.StringType()),
        T.StructField("filter", T.StringType()),
        T.StructField("info", T.MapType(T.StringType(), T.StringType())),
        T.StructField("gt", T.ArrayType(T.IntegerType())),
    ]
)

REF_SEQ = T.StructType([T.StructField("name", T.StringType()), T.StructField("seq", T.StringType())])
