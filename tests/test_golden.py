"""Values from FIXTURES.md: rewriting, indel runs, projection, equivalence, support, mapping quality."""

import pytest
from pyspark.sql import functions as F

from alnspark.functions import cigar as C
from alnspark.operators import coordinates, mapq, project, support


G1, G2 = ("GAT-ACA", "GATTACA"), ("TTTTTACGACG---TTTACGTTTTT", "TTTTTACGACGACG---ACGTTTTT")
REWRITE = [
    (*G1, "TA", 2, 2, "2M", "1=1D1="), (*G1, "TA", 2, 2, "1H2M1P", "1H1=1D1=1P"), (*G1, "CC", 1, 1, "2I", "2I"), (*G1, "GG", 4, 5, "2I", "2I"),
    (*G1, "CTAC", 2, 2, "1S2M1S", "1S1=1D1=1S"), (*G1, "TC", 2, 2, "1M1S", "1=1S"), (*G1, "CA", 3, 4, "1S1M", "1S1="), (*G1, "T", 1, 1, "1D1M", "1D1="),
    ("GATTACA", "GAT-ACA", "TTA", 2, 2, "3M", "1=1I1="), ("GATTACA", "GAT-ACA", "TA", 2, 2, "1M1D1M", "2="),
    ("GATTACAGATTACA", "GAT-ACAG--T-CA", "TTACAGATTAC", 2, 2, "11M", "1=1I4=2I1=1I1="), ("GATTACAGATTACA", "GAT-ACAG--T-CA", "CA", 12, 8, "2M", "2="),
    ("A-C-G-T-A-C-G-T-", "-G-T-A-C-G-T-A-C", "ACG", 4, 4, "3M", "1I1D1I1D1I"), ("A-C", "ATC", "AC", 0, 0, "1M1P1M", "1=1D1P1="), (*G2, "ACGTTT", 8, 8, "6=", "3=3D3I"),
]
G3 = ("TTTTTACGACG---TTTACGTTTTT", "TTTTTACGACGATG---ACGTTTTT")
PROJECT = [
    ("TTT---TTT", "TTTACGTTT", "TTTACGTTT", 0, 0, "3=3I3=", "9="), (*G2, "TTT", 11, 14, "3=", "3I"), (*G2, "ACGTTT", 8, 8, "6=", "3=3D3I"), (*G2, "ACGTTTACG", 8, 8, "9=", "3=3D3I3="),
    (*G2, "GTTTA", 10, 10, "5=", "1=3D3I1="), (*G3, "ACGTTT", 8, 8, "3=3X", "3=1D1=1D2I"),
]
#: Aligns the same TTT with the same ATG as the case before; only the scores without qualities prefer mismatches here.
PLAIN = [(*G3, "GTTTA", 10, 10, "5=", "1=1X1=1X1=")]


def case_frames(spark, cases):
    aligned, reads, refs, expected = [], [], [], {}
    for k, (src, dst, query, pos, dst_pos, cigar, want) in enumerate(cases):
        aligned += [(f"c{k}", "src", src), (f"c{k}", "dst", dst)]
        refs.append((f"c{k}", dst.replace("-", "")))
        reads.append((k, f"c{k}", "src", pos, cigar, query, "J" * len(query)))
        expected[k] = (dst_pos, want)
    blocks = coordinates.build_msa_index(spark.createDataFrame(aligned, "chr string, seq_id string, seq string"))
    df = spark.createDataFrame(reads, "rec_idx long, chr string, seq_id string, pos int, text string, seq string, qual string").withColumn("cigar", C.parse(F.col("text")))
    return df, blocks, spark.createDataFrame(refs, "name string, seq string"), expected


def check(spark, df, expected, padding=True):
    want = spark.createDataFrame([(k, p, c) for k, (p, c) in expected.items()], "rec_idx long, want_pos long, want string")
    eq = C.equivalent(F.col("dst_cigar"), C.parse(F.col("want")), padding)
    rows = df.join(want, "rec_idx").select("rec_idx", "dst_pos", "want_pos", C.render(F.col("dst_cigar")).alias("got"), "want", eq.alias("eq")).collect()
    assert len(rows) == len(expected)
    assert not [r for r in rows if not r.eq or r.dst_pos != r.want_pos]


def test_rewrite(spark):
    df, blocks, refs, expected = case_frames(spark, REWRITE)
    check(spark, project.project_cigars(df, blocks, refs, "dst", anew=False), expected)


def test_project(spark):
    df, blocks, refs, expected = case_frames(spark, PROJECT)
    check(spark, project.project_cigars(df, blocks, refs, "dst", use_qualities=True), expected)


def test_project_without_qualities(spark):
    df, blocks, refs, expected = case_frames(spark, PLAIN)
    check(spark, project.project_cigars(df, blocks, refs, "dst"), expected)


def test_short_steps_agree(spark):
    df, blocks, refs, expected = case_frames(spark, REWRITE)
    check(spark, project.project_cigars(df, blocks, refs, "dst", anew=False, step=3), expected)


def test_indel_runs(spark):
    cases = [("3I", []), ("3M", []), ("3M4I5M", []), ("3M2I3D5M", [(3, 6, 3, 5)]), ("2M3I2D2M3D4I1M", [(2, 4, 2, 5), (6, 9, 7, 11)])]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, text string")
    for r in df.select("k", C.indel_runs(C.parse(F.col("text")), F.lit(0)).alias("runs")).collect():
        assert [(x.ref_start, x.ref_end, x.query_start, x.query_end) for x in r.runs] == cases[r.k][1]


def test_equivalence(spark):
    cases = [("2I1D1P", "1I1D1P", False, False), ("1I2D3P1=", "2D3P1I1=", False, False), ("1I2D3P1=", "2D3P1I1=", True, True), ("3M1I2D1M", "3M2D1I1M", False, True), ("3M1I1M", "3M1M", False, False), ("", "", False, True)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _, _) in enumerate(cases)], "k int, a string, b string")
    for p in (False, True):
        for r in df.select("k", C.equivalent(C.parse(F.col("a")), C.parse(F.col("b")), p).alias("eq")).collect():
            if cases[r.k][2] == p:
                assert r.eq == cases[r.k][3], cases[r.k]


def test_cigar_columns(spark):
    row = spark.createDataFrame([("2S3=1X2I4D0M3M1M5H",)], "t string").withColumn("c", C.parse(F.col("t")))
    got = row.select(C.render(C.collapse(F.col("c"))), C.reference_length(F.col("c")), C.query_length(F.col("c")), C.right_anchored_length(F.col("c")), C.record_length(F.col("c"), True), C.render(C.to_alignment_match(F.col("c")))).first()
    assert tuple(got) == ("2S3=1X2I4D4M5H", 12, 12, 12, 16, "2S4M2I4D4M5H")
    assert spark.createDataFrame([("*",), (None,)], "t string").select(C.render(C.parse(F.col("t")))).collect() == [("*",), ("*",)]


def test_sequence_match(spark):
    df = spark.createDataFrame([("1S4M1I2M2D1=", "TACGTTGACA", "xxACNTNNGGA")], "t string, seq string, ref string").withColumn("c", C.parse(F.col("t")))
    got = df.select(C.render(C.to_sequence_match(F.col("c"), F.col("seq"), F.col("ref"), F.lit(2))), C.reference_n_positions(F.col("c"), F.col("ref"), F.lit(2).cast("long"))).first()
    assert got[0] == "1S2=1X1=1I2X2D1=" and got[1] == [2, 4, 5]


#: Worked by hand: CIGAR, read, lengths of the alleles, what the read shows at position 3 without and with clipped bases.
ALLELES = [
    ("10M", "ACGTACGTAC", 1, 1, "T", "T"),
    ("4M2I4M", "ACGTGGACGT", 1, 3, "TGG", "TGG"),
    ("10M", "ACGTACGTAC", 1, 3, "T", "T"),
    ("4M2D4M", "ACGTGTAC", 3, 1, "T", "T"),
    ("4M3D4M", "ACGTTACG", 3, 1, "T~", "T~"),
    ("4M1D2N4M", "ACGTTACG", 2, 1, "T~", "T~"),
    ("4M2I1P1I4M", "ACGTGGCACGT", 1, 3, "TGG", "TGG"),
    ("2=1X1=2I4X", "ACGTGGACGT", 1, 3, "TGG", "TGG"),
    ("2M9H2M2P2I4M", "ACGTGGACGT", 1, 3, "TGG", "TGG"),
    ("3M2I4M", "ACGggTACG", 1, 1, "ggT", "ggT"),
    ("3M1I4M", "ACGgTACG", 1, 2, "gT", "gT"),
    ("4M2S", "ACGTCC", 1, 3, "T", "Tcc"),
    ("4M2S1H", "ACGTCC", 1, 1, "T", "Tcc"),
    ("3M2S", "ACGTT", 1, 1, None, None),
    ("2S4M", "TTACGT", 1, 1, "T", "T"),
    ("*", "ACGT", 1, 1, None, None),
]


def test_read_allele(spark):
    schema = "var_id int, t string, r_seq string, ref_len long, alt_len long, want string, clipped string"
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(ALLELES)], schema).withColumns({"r_cigar": C.parse(F.col("t")), "r_pos": F.lit(0), "pos": F.lit(3)})
    for clip, want in ((False, 4), (True, 5)):
        got = {r.var_id: r.allele for r in support.shown_alleles(df.coalesce(1), clip).collect()}
        assert got == {k: x[want] for k, x in enumerate(ALLELES) if x[want] is not None}


def test_mapq(spark):
    cases = [(0.0, None, 39), (0.0, -6.0, 6), (0.0, -7.0, 30), (-10.0, -40.0, 14), (-10.0, -10.0, 1), (-30.0, -30.0, 0), (-70.0, -80.0, 0)]
    df = spark.createDataFrame([(k, s, n) for k, (s, n, _) in enumerate(cases)], "k int, s double, n double")
    got = df.select("k", mapq.mapq(F.lit(100), F.lit(0), F.col("s"), F.col("n")).alias("q"), mapq.mapq(F.lit(100), F.lit(0), F.col("s"), F.col("n"), True).alias("u")).collect()
    assert {r.k: r.q for r in got} == {k: c[2] for k, c in enumerate(cases)}
    assert {r.k: r.u for r in got}[0] == 42


def test_rescore(spark):
    df = spark.createDataFrame([("2=1X1I1D2=", "ACGTNA", "IIIIII", [2]), ("2=1X", "ACG", "I+!", []), ("3M", "ACG", "III", [])], "t string, seq string, qual string, n array<bigint>")
    got = [r[0] for r in df.select(mapq.rescore(C.parse(F.col("t")), F.col("seq"), F.col("qual"), F.col("n"))).collect()]
    assert got == [-1 - (5 + 3) - 3 - 1, -2.0, None]


def test_lift(spark):
    blocks = coordinates.build_msa_index(spark.createDataFrame([("c", "a", "GAT-ACA"), ("c", "b", "G-TTACA")], "chr string, seq_id string, seq string"))
    got = coordinates.lift_regions(spark.createDataFrame([("c", 0, 2), ("c", 2, 6)], "chr string, lb long, rb long"), blocks, "a", "b").collect()
    assert sorted(map(tuple, got)) == [("c", 0, 1), ("c", 1, 6)]
