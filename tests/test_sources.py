"""Text and BAM sources, sinks and their round trips; streams."""

import gzip
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from alnspark.functions import cigar as C
from alnspark.functions import text as T
from alnspark.operators import coordinates, headers, order, overlap, project, stats, subset, support
from alnspark.sources import bam, bgzf, sinks, text
from alnspark.streaming import alignments as streaming

SAM = """@HD\tVN:1.6
@SQ\tSN:c1/a\tLN:100
@SQ\tSN:c2/a\tLN:50
@PG\tID:x.3\tPN:x\tCL:x y
@RG\tID:g\tSM:s
@CO\thello there
r1\t99\tc1/a\t5\t30\t2S3M1I4M\t=\t20\t25\tACGTACGTAC\tIIIIIIIIII\tAS:i:-3\tZZ:Z:a:b
r1\t147\tc1/a\t20\t30\t10M\t=\t5\t-25\tACGTACGTAC\t*\tXB:B:I,1,2,3\tFF:f:0.5
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGTN\tIIIII
"""


@pytest.fixture
def sam(tmp_path):
    path = tmp_path / "a.sam"
    path.write_text(SAM)
    (tmp_path / "a.sam.gz").write_bytes(gzip.compress(SAM.encode()))
    return path


def test_sam(spark, sam):
    df = text.read_sam(spark, str(sam)).orderBy("rec_idx")
    rows = df.collect()
    assert [(r.qname, r.flag, r.rname, r.pos, r.rnext, r.pnext, r.qual is None) for r in rows] == [("r1", 99, "c1/a", 4, "c1/a", 19, False), ("r1", 147, "c1/a", 19, "c1/a", 4, True), ("r2", 4, None, None, None, None, False)]
    assert rows[0].tags == {"AS": "i:-3", "ZZ": "Z:a:b"} and rows[2].cigar == []
    body = [line for line in SAM.splitlines() if not line.startswith("@")]
    body[1] = body[1].replace("XB:B:I,1,2,3\tFF:f:0.5", "FF:f:0.5\tXB:B:I,1,2,3")
    assert [r.value for r in sinks.sam_lines(df).collect()] == body
    assert text.read_sam(spark, str(sam) + ".gz").count() == 3
    refs, programs, groups, comments = text.read_sam_header(spark, str(sam))
    assert [tuple(r) for r in refs.orderBy("ref_idx").collect()] == [(0, "c1/a", 100), (1, "c2/a", 50)]
    assert groups.first().fields == {"ID": "g", "SM": "s"} and comments.first().text == "hello there"
    more = headers.append_program(programs, "x.", "x", "x z", "2")
    assert [r.id for r in more.orderBy("place").collect()] == ["x.3", "x.4"] and more.orderBy(F.desc("place")).first().previous == "x.3"
    lines = [r.value for r in sinks.header_lines(refs, more).collect()]
    assert lines[:3] == ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:c1/a\tLN:100", "@SQ\tSN:c2/a\tLN:50"] and lines[-1] == "@PG\tID:x.4\tPN:x\tCL:x z\tVN:2\tPP:x.3"


def test_bam_round_trip(spark, sam, tmp_path):
    df = text.read_sam(spark, str(sam)).coalesce(1)
    (tmp_path / "a.bam").write_bytes(b"".join(bam.bam_blocks(iter(df.collect()), [("c1/a", 100), ("c2/a", 50)], "@HD\tVN:1.6\n")))
    spark.dataSource.register(bam.BamSource)
    want = [tuple(r)[1:] for r in df.orderBy("rec_idx").collect()]
    for back in (spark.read.format("bam").load(str(tmp_path / "a.bam")), bam.read_bam(spark, str(tmp_path / "a.bam"))):
        assert [tuple(r)[1:] for r in back.orderBy("rec_idx").collect()] == want


def test_bam_is_split_where_its_index_says(spark, tmp_path):
    """Blocks of 300 bytes, so that records and even their lengths lie across blocks; the index is written by hand."""
    rows = [(k, f"q{k}", 0, "c1/a", k, 30, "20M", None, None, 0, "ACGTT" * 4, "I" * 20, {"AS": f"i:{k}"}) for k in range(400)]
    df = spark.createDataFrame(rows, "rec_idx long, qname string, flag int, rname string, pos int, mapq int, c string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>").withColumn("cigar", C.parse(F.col("c"))).drop("c")
    df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in text.ALIGNMENTS])
    some, size = df.collect(), bam.BLOCK_BYTES
    bam.BLOCK_BYTES = 300
    try:
        whole = b"".join(bam.bam_blocks(iter(some), [("c1/a", 1000)], "@SQ\tSN:c1/a\tLN:1000\n"))
    finally:
        bam.BLOCK_BYTES = size
    path = tmp_path / "b.bam"
    path.write_bytes(whole)
    spark.dataSource.register(bam.BamSource)
    load = lambda: spark.read.format("bam").option("splitBytes", 2000).load(str(path))
    one = load()
    assert one.rdd.getNumPartitions() == -(-len(whole) // 2000)  # without an index, at the first record after each 2000 bytes
    want = [tuple(r)[1:] for r in some]
    begun = [r.rec_idx for r in one.orderBy("rec_idx").collect()]
    assert [tuple(r)[1:] for r in one.orderBy("rec_idx").collect()] == want
    chunks = begun[::7]
    index = b"BAI\1" + struct.pack("<ii", 1, 2) + struct.pack("<Ii", 4681, len(chunks)) + b"".join(struct.pack("<QQ", c, c + 1) for c in chunks)
    index += struct.pack("<Ii4Q", bam.COUNTS_BIN, 2, 5, 6, 7, 8) + struct.pack("<iQ", 1, chunks[0]) + struct.pack("<Q", 0)
    (tmp_path / "b.bam.bai").write_bytes(index)
    many = load()
    assert many.rdd.getNumPartitions() > 3
    assert [tuple(r)[1:] for r in many.orderBy("rec_idx").collect()] == want and [r.rec_idx for r in many.orderBy("rec_idx").collect()] == begun
    narrow = spark.read.format("bam").schema("pos int, mapq int").load(str(path))
    assert sorted(map(tuple, narrow.collect())) == [(k, 30) for k in range(400)]
    path.write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="ends within|unpack|buffer"):
        spark.read.format("bam").schema("pos int").load(str(path)).collect()


def test_files_with_headers(spark, sam, tmp_path):
    df = text.read_sam(spark, str(sam)).repartition(3, "pos")
    refs, programs, groups, comments = text.read_sam_header(spark, str(sam))
    want = sorted(str(tuple(r)[1:]) for r in df.collect())
    sinks.write_sam(df, refs, str(tmp_path / "s"), programs)
    assert sorted(str(tuple(r)[1:]) for r in text.read_sam(spark, str(tmp_path / "s")).collect()) == want
    for part in (tmp_path / "s").glob("part-*"):
        assert part.read_text().startswith("@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:c1/a\tLN:100\n@SQ\tSN:c2/a\tLN:50\n@PG\tID:x.3")
    sinks.write_bam(df, refs, str(tmp_path / "b"), programs, groups=groups, comments=comments)
    names = sorted(p.name for p in (tmp_path / "b").iterdir())
    assert names and all(n.endswith(".bam") for n in names)
    back = spark.read.format("bam").load(str(tmp_path / "b"))
    assert sorted(str(tuple(r)[1:]) for r in back.collect()) == want
    header, of = bam.read_header(bgzf.BlockStream((tmp_path / "b" / names[0]).open("rb")))
    assert of == [("c1/a", 100), ("c2/a", 50)]
    assert header.splitlines() == [line if k else line + "\tSO:unsorted" for k, line in enumerate(sorted(SAM.splitlines()[:6], key=lambda x: ["@HD", "@SQ", "@RG", "@PG", "@CO"].index(x[:3])))]
    assert gzip.decompress((tmp_path / "b" / names[0]).read_bytes())[:4] == b"BAM\1"
    df.write.format("bam").option("header", header).mode("overwrite").save(str(tmp_path / "b"))
    assert spark.read.format("bam").load(str(tmp_path / "b")).count() == 3


def test_bgzip_fasta_by_its_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bgzf, "PIECE", 25)
    seqs = {"a": "ACGTACGTTA" * 12 + "ACG", "b": "T" * 10, "e": "", "z": "GATTACA" * 30}
    plain, fai = "", ""
    for name, seq in seqs.items():
        plain += f">{name} text\n"
        fai += f"{name}\t{len(seq)}\t{len(plain)}\t10\t11\n"
        plain += "".join(seq[k : k + 10] + "\n" for k in range(0, len(seq), 10))
    blocks, starts = b"", []
    for k in range(0, len(plain), 37):
        starts.append((len(blocks), k))
        blocks += bam.bgzf_block(plain[k : k + 37].encode())
    path = tmp_path / "g.fa.gz"
    path.write_bytes(blocks + bam.END_BLOCK)
    (tmp_path / "g.fa.gz.fai").write_text(fai)
    (tmp_path / "g.fa.gz.gzi").write_bytes(struct.pack("<Q", len(starts) - 1) + b"".join(struct.pack("<QQ", *s) for s in starts[1:]))
    whole = {}
    for r in bgzf.read_indexed_fasta(spark, str(path)).orderBy("name", "start").collect():
        assert r.start == len(whole.get(r["name"], ""))
        whole[r["name"]] = whole.get(r["name"], "") + r.seq
    assert whole == seqs
    assert {tuple(r) for r in text.read_reference(spark, str(path), ["z", "b"]).collect()} == {("z", seqs["z"]), ("b", seqs["b"])}
    with pytest.raises(Exception, match="no sequence nowhere"):
        text.read_reference(spark, str(path), ["nowhere"]).collect()
    assert {tuple(r) for r in text.read_reference(spark, str(path)).collect()} == set(seqs.items())


def test_sequences_that_the_index_lacks(spark):
    aligned = spark.createDataFrame([("c", "s", "ACGTACGTAC"), ("c", "t", "ACGTACGTAC")], "chr string, seq_id string, seq string")
    blocks, reference = coordinates.build_msa_index(aligned), spark.createDataFrame([("c", "ACGTACGTAC")], "name string, seq string")
    columns = "rec_idx long, qname string, flag int, rname string, pos int, mapq int, c string, rnext string, pnext int, tlen int, seq string, qual string"
    reads = lambda rname, rnext: spark.createDataFrame([(0, "q", 1, "c/s", 1, 9, "3M", None, None, 0, "CGT", None), (1, "r", 1, rname, 2, 9, "3M", rnext, 4, 0, "GTA", None)], columns).withColumn("cigar", C.parse(F.col("c"))).drop("c")
    assert [(r.rname, r.pos) for r in project.project_alignments(reads("c/s", "c/s"), blocks, reference, "t").orderBy("rec_idx").collect()] == [("c", 1), ("c", 2)]
    for rname, rnext, target, message in (("c/u", "c/s", "t", "sequence u of c"), ("c/s", "d/s", "t", "sequence s of d"), ("c/s", "c/s", "v", "sequence v of c")):
        with pytest.raises(Exception, match=f"lacks {message}"):
            project.project_alignments(reads(rname, rnext), blocks, reference, target).collect()
    for pos, pnext, message in ((8, 4, "positions 8 to 11 aren't within the 10 bases of sequence s of c"), (5000, 4, "positions 5000 to 5003"), (2, 10, "positions 10 to 11")):
        with pytest.raises(Exception, match=message):
            project.project_alignments(reads("c/s", "c/s").withColumn("pos", F.lit(pos)).withColumn("pnext", F.lit(pnext)), blocks, reference, "t").collect()


def test_vcf_and_bed(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\nc\t11\tv1;v2\tAC\tA\t.\tPASS\tCO;DP=3\tGT:DP\t0|1:9\nc\t21\t.\tA\t<DEL>\t9\tPASS\tEND=25\tDP:GT\t1:./1\nd\t1\t.\tA\tT\t.\tPASS\t.\tGT\t1/1\n")
    (tmp_path / "r.bed").write_text("track x\nc\t11\t12\nc\t100\t200\nc\t24\t25\n")
    v = text.read_vcf(spark, str(tmp_path / "v.vcf"))
    rows = v.collect()
    assert [(r.pos, r.ids, r.gt, r.info) for r in rows] == [(10, ["v1", "v2"], [0, 1], {"CO": None, "DP": "3"}), (20, [], [None, 1], {"END": "25"}), (0, [], [1, 1], {})]
    a = text.variant_alleles(v).withColumn("var_id", F.col("pos"))
    assert [(r.ref_len, r.alt_len) for r in a.collect()] == [(2, 1), (5, 0), (1, 1)]
    assert sorted(r.pos for r in support.in_regions(v, text.read_bed(spark, str(tmp_path / "r.bed"))).collect()) == [10, 20]
    assert [(r.zygosity, r.is_reversed) for r in support.variant_rows(a).orderBy("var_id").collect()] == [(2, 0), (1, 1), (2, 0)]
    with pytest.raises(Exception, match="one plain ALT"):
        text.variant_alleles(v.withColumn("alts", F.array(F.lit("A"), F.lit("C")))).collect()
    sinks.write_bed(text.read_bed(spark, str(tmp_path / "r.bed")), str(tmp_path / "out"))
    assert text.read_bed(spark, str(tmp_path / "out")).count() == 3


def test_pieces_of_fasta_and_of_the_index(spark, tmp_path):
    """Small splits and pieces: records begin and end anywhere, and blocks run over several pieces."""
    r = random.Random(3)
    records = [(f"c{k % 2}", f"s{k}", "".join(("-" if r.random() < 0.5 else r.choice("ACGT")) * r.randint(1, 40) for _ in range(n))) for k, n in enumerate((1, 30, 0, 2, 60, 5))]
    records.append(("c1", "whole", "A" * 700))
    text_of = lambda seq: "".join(seq[a : a + 17] + "\n" for a in range(0, len(seq), 17))
    (tmp_path / "x.a2m").write_text("".join(f">{c}\t{s}\n{text_of(seq)}" for c, s, seq in records))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        pieces = text.read_a2m_pieces(spark, str(tmp_path / "x.a2m"), 64)
        assert spark.read.text(str(tmp_path / "x.a2m")).rdd.getNumPartitions() > 3
        rows = pieces.collect()
        blocks = sorted(map(tuple, coordinates.build_msa_index(pieces).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = {}
    for row in sorted(rows, key=lambda x: x.start):
        assert len(found.setdefault((row.chr, row.seq_id), "")) == row.start and len(row.seq) < 64 + 17
        found[row.chr, row.seq_id] += row.seq
    assert found == {(c, s): seq for c, s, seq in records if seq}
    whole = spark.createDataFrame([x for x in records if x[2]], "chr string, seq_id string, seq string")
    want, cut = [], lambda s: [(m.start(), m.end()) for m in re.finditer("[^-]+", s)]
    for c, s, seq in records:
        want += [(c, s, a, len(seq[:a].replace("-", "")), b - a) for a, b in cut(seq)]
    assert blocks == sorted(want) == sorted(map(tuple, coordinates.build_msa_index(whole).collect()))


def test_overlaps_and_order_in_slabs(spark):
    """Narrow slabs and bins against every pair, long and empty intervals included."""
    r = random.Random(8)
    left = [(k, f"c{r.randint(0, 2)}", a := r.randint(0, 90), a + r.choice([0, 1, 3, 60])) for k in range(80)]
    right = [(f"c{r.randint(0, 1)}", a := r.randint(0, 90), a + r.choice([0, 1, 2, 5, 40])) for _ in range(25)]
    one, two = spark.createDataFrame(left, "start long, chr string, a long, b long"), spark.createDataFrame(right, "r_chr string, lb long, rb long")
    meets = lambda x, y: x[2] < y[2] and y[1] < x[3] and y[1] < y[2]
    got = overlap.overlapping(one, "a", "b", two, "lb", "rb", [("chr", "r_chr")], width=8)
    assert got.columns == one.columns and sorted(x.start for x in got.collect()) == [x[0] for x in left if any(x[1] == y[0] and meets(x, y) for y in right)]
    assert sorted(x.start for x in overlap.overlapping(one, "a", "b", two, "lb", "rb", width=8).collect()) == [x[0] for x in left if any(meets(x, y) for y in right)]
    assert overlap.overlapping(one, "a", "b", two.limit(0), "lb", "rb", [("chr", "r_chr")]).count() == 0
    rows, last, want = [(k, r.choice(["a", "b", None]), r.randint(0, 9)) for k in range(60)], {}, []
    for k, name, pos in rows:
        want += [k] if name in last and pos < last[name] else []
        last[name] = pos
    assert sorted(x.rec_idx for x in order.unsorted(spark.createDataFrame(rows, "rec_idx long, rname string, pos int"), width=4).collect()) == want


def test_report_in_order(spark, tmp_path):
    """Lines of a variant stay together over several files, counters come last."""
    variants = spark.createDataFrame([(f"v{k}", f"c{k % 3}", 100 - k, "A", "T", 1, 0, "") for k in range(40)], "var_id string, chrom string, pos long, ref string, alts string, zygosity int, is_reversed int, ids string")
    shown = spark.createDataFrame([(f"v{k}", a, n) for k in range(40) for a, n in (("A", k), ("", 2), ("T", 1))[: k % 4]], "var_id string, allele string, n long")
    counters = spark.createDataFrame([("S", "total variants", 40), ("T", "reads processed", 7)], "line string, metric string, n long")
    sinks.write_report(variants, shown, counters, str(tmp_path / "report"), files=4)
    files = sorted((tmp_path / "report").glob("part-*"))
    lines = [x.split("\t") for f in files for x in f.read_text().splitlines()]
    assert len(files) > 1 and [x[0] for x in lines[-2:]] == ["S", "T"]
    places = [(x[1], int(x[2])) for x in lines if x[0] == "V"]
    assert places == sorted(places) and len(places) == 40
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150")  # variants cut between their lines
        got = {(x.chrom, x.pos): x.alleles for x in text.read_report(spark, str(tmp_path / "report")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f"c{k % 3}", 100 - k): ";".join(sorted([f"{k} A", "2 <DEL>", "1 T"][: k % 4])) for k in range(40)}


def test_fasta_lists_and_index(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a first one\nACGT\nAC\n>b\nTT\n")
    assert [tuple(r) for r in text.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("name").collect()] == [("a", "first one", "ACGTAC"), ("b", "", "TT")]
    (tmp_path / "x.a2m").write_text(">c\ts1\nAC-\nT\n>c\ts2\nA-GT\n")
    blocks = coordinates.build_msa_index(text.read_a2m(spark, str(tmp_path / "x.a2m")))
    assert sorted(map(tuple, blocks.collect())) == [("c", "s1", 0, 0, 2), ("c", "s1", 3, 2, 1), ("c", "s2", 0, 0, 1), ("c", "s2", 2, 1, 2)]
    (tmp_path / "s1").write_text("AC-T\n")
    (tmp_path / "s2.gz").write_bytes(gzip.compress(b"A-GT"))
    (tmp_path / "list.tsv").write_text(f"c\ts1\t{tmp_path}/s1\nc\ts2\t{tmp_path}/s2.gz\n")
    raw = text.read_raw_sequences(spark, text.read_sequence_list(spark, str(tmp_path / "list.tsv")))
    assert sorted(map(tuple, raw.collect())) == [("c", "s1", "AC-T"), ("c", "s2", "A-GT")]
    (tmp_path / "bad.tsv").write_text("c\ts1\n")
    with pytest.raises(Exception, match="three tab"):
        text.read_sequence_list(spark, str(tmp_path / "bad.tsv")).collect()
    sinks.write_index(blocks, str(tmp_path / "index"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_index(blocks, str(tmp_path / "index"))
    sinks.write_fasta(text.read_reference(spark, str(tmp_path / "x.fa"), ["a"]), str(tmp_path / "fa"), 4)
    assert text.read_fasta(spark, str(tmp_path / "fa")).first().seq == "ACGTAC"
    (tmp_path / "x.gzi").write_bytes(struct.pack("<5Q", 2, 10, 100, 30, 200))
    assert sorted(map(tuple, text.read_gzi(spark, str(tmp_path / "x.gzi")).collect())) == [(0, 0), (10, 100), (30, 200)]
    (tmp_path / "x.fai").write_text("a\t6\t13\t4\t5\n")
    assert text.read_fai(spark, str(tmp_path / "x.fai")).first().line_bases == 4
    assert text.read_reference_order(spark, str(tmp_path / "x.fai")).first().name == "a"


def test_report_round_trip(spark, tmp_path):
    (tmp_path / "r.txt").write_text("V\tc\t10\tv1\tA\tT\t1\t0\nR\t3\tA\nR\t2\t<DEL>\nV\tc\t20\tv2\tA\tC\t1\t0\nS\tTotal\t2\n")
    one = text.read_report(spark, str(tmp_path / "r.txt"))
    assert [r.alleles for r in one.orderBy("pos").collect()] == ["2 <DEL>;3 A", ""]
    (tmp_path / "s.txt").write_text("V\tc\t10\tv1\tA\tT\t1\t0\nR\t3\tA\nR\t2\t<DEL>\nV\tc\t30\tv3\tA\tC\t1\t0\nR\t1\tG\n")
    diff = support.support_diff(one, text.read_report(spark, str(tmp_path / "s.txt")))
    assert [(r.pos, r.left_alleles, r.right_alleles) for r in diff.collect()] == [(20, "", None), (30, None, "1 G")]


def test_split_and_coverage_cases(spark, tmp_path):
    reads = spark.createDataFrame([(0, "c", 0, "3M"), (1, "c", 1, "3M"), (2, "c", 6, "2M")], "rec_idx long, rname string, pos int, t string").withColumn("cigar", C.parse(F.col("t")))
    want = {0: 1, 1: 2, 2: 2, 3: 1, 6: 1, 7: 1}
    assert {r.position: r.coverage for r in stats.coverage(reads, width=2).collect()} == want
    assert {r.position for r in stats.coverage(reads, explicit_ends=True).where("coverage = 0").collect()} == {4, 8}
    covered = spark.createDataFrame([("c", 2, 1), ("c", 4, 3)], "rname string, position long, coverage long")
    assert {r.coverage: r.n for r in stats.coverage_histogram(covered, 6).collect()} == {0: 4, 1: 1, 2: 0, 3: 1}
    wanted = spark.createDataFrame([("c", None), ("ca", None)], "name string, new_name string")
    with pytest.raises(Exception, match="several targets"):
        subset.split_by_reference(reads.withColumn("rname", F.lit("cab")), wanted, prefix=True).collect()
    sinks.write_split(subset.split_by_reference(reads, wanted.limit(1)), str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).where("target = 'c'").count() == 3


def test_text_helpers(spark):
    row = spark.createDataFrame([("c/a/b", "acgUn~", {"AS": "i:3"})], "r string, s string, t map<string,string>")
    got = row.select(T.chr_of(F.col("r")), T.seq_of(F.col("r")), T.dna5(F.col("s")), T.reverse_complement(F.lit("ACGTa~")), T.tag(F.col("t"), "AS"), T.with_tags(F.col("t"), XS=F.lit("i:1"), AS=F.lit(None).cast("string"))).first()
    assert tuple(got) == ("c", "a/b", "ACGTNN", "~tACGT", "3", {"XS": "i:1"})
    with pytest.raises(Exception, match="no separator"):
        spark.createDataFrame([("c",)], "r string").select(T.chr_of(F.col("r"))).collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"r{k // 2}", 1, "c", k * 10, k % 3, k) for k in range(20)], "rec_idx long, qname string, flag int, rname string, pos int, mapq int, s long").withColumn("ts", F.timestamp_seconds(F.col("s") * 60))
    rows.drop("s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert {r.mapq: r.n for r in run(streaming.running_histogram(stream), "complete", "hist").collect()} == {0: 7, 1: 7, 2: 6}
    assert run(streaming.running_contig_counts(stream), "complete", "contigs").first().n == 20
    assert run(streaming.first_of_each_read(stream), "append", "firsts").count() == 10
    assert run(streaming.windowed_coverage_starts(stream, late="1 minute"), "append", "starts").agg(F.sum("n")).first()[0] >= 15


def test_fasta_headers_may_hold_more_signs(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s1 a->b text >c\nAC\nGT\n>s2\n>s3\td>\r\nTT\r\n")
    got = sorted(map(tuple, text.read_fasta(spark, str(tmp_path / "x.fa")).collect()))
    assert got == [("s1", "a->b text >c", "ACGT"), ("s2", "", ""), ("s3", "d>", "TT")]
