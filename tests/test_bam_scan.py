"""BAM scans that prune rows and split files, and alignments dealt to a file a target."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from alnspark.functions import cigar as C
from alnspark.operators import subset
from alnspark.schema import ALIGNMENTS
from alnspark.sources import bam, bgzf, sinks, split_bam

REFS = [("c1/a", 3_000_000), ("c2/a", 500_000), ("c3/a", 100)]
HEADER = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in REFS)


def reads(spark, n=3000, long=0, seed=5):
    """Sorted reads on two of three references and some without a place; ``long`` of them have 30,000 bases."""
    r = random.Random(seed)
    places = sorted([(0, r.randrange(2_900_000)) for _ in range(n)] + [(1, r.randrange(400_000)) for _ in range(n // 3)])
    rows = []
    for k, (ref, pos) in enumerate([*places, *[(None, None)] * 20]):
        size = 30_000 if long and k % (len(places) // long) == 7 else r.choice([50, 80])
        name = REFS[ref][0] if ref is not None else None
        rows.append((k, f"q{k}", r.choice([0, 16, 99]) if name else 4, name, pos, r.randrange(61), f"{size}M" if name else "*", None, None, 0, "".join(r.choices("ACGT", k=size)), "I" * size, {"AS": f"i:{k}"}))
    raw = spark.createDataFrame(rows, "rec_idx long, qname string, flag int, rname string, pos int, mapq int, c string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>")
    raw = raw.withColumn("cigar", C.parse(F.col("c")))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ALIGNMENTS]).orderBy("rec_idx").collect()


def save(path, rows, block=4000):
    size, bam.BLOCK_BYTES = bam.BLOCK_BYTES, block
    try:
        path.write_bytes(b"".join(bam.bam_blocks(iter(rows), REFS, HEADER)))
    finally:
        bam.BLOCK_BYTES = size


def index_of(path):
    """A .bai from the records of a file, written by the rules of the format."""
    bins, linear = [{} for _ in REFS], [{} for _ in REFS]
    with path.open("rb") as file:
        stream = bgzf.BlockStream(file)
        _, refs = bam.read_header(stream)
        starts = [(r[0], r[1], r[2], sum(c.n for c in r[3])) for r in bam.read_records(stream, refs, ["rec_idx", "rname", "pos", "cigar"])]
    ends = [s[0] for s in starts[1:]] + [path.stat().st_size << 16]
    ids = {n: k for k, (n, _) in enumerate(REFS)}
    for (at, name, pos, length), end in zip(starts, ends, strict=True):
        if name is None:
            continue
        last = pos + length - 1
        of = next((base + (pos >> bits) for base, bits in reversed(bam.LEVELS) if pos >> bits == last >> bits), 0)
        chunks = bins[ids[name]].setdefault(of, [])
        if chunks and chunks[-1][1] == at:
            chunks[-1] = (chunks[-1][0], end)
        else:
            chunks.append((at, end))
        for w in range(pos >> 14, (last >> 14) + 1):
            linear[ids[name]].setdefault(w, at)
    out = b"BAI\1" + struct.pack("<i", len(REFS))
    for of, windows in zip(bins, linear, strict=True):
        out += struct.pack("<i", len(of) + 1)
        for k, chunks in of.items():
            out += struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<Ii4Q", bam.COUNTS_BIN, 2, 1, 2, 3, 4)
        n = max(windows, default=-1) + 1
        out += struct.pack("<i", n) + b"".join(struct.pack("<Q", windows.get(w, 0)) for w in range(n))
    return out


def rows_of(df):
    return sorted(str(tuple(r)[1:]) for r in df.collect())


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bam") / "r.bam"
    rows = reads(spark, long=20)
    save(path, rows)
    return path, rows


CASES = [
    "rname = 'c1/a' AND pos >= 1000000 AND pos < 1050000",
    "rname = 'c1/a' AND pos > 2880000",
    "rname = 'c1/a' AND pos = 5",
    "rname IN ('c2/a', 'c3/a') AND mapq >= 30",
    "rname = 'c2/a' AND pos <= 16384",
    "rname = 'c3/a'",
    "rname = 'nowhere'",
    "rname IS NULL",
    "rname IS NOT NULL AND flag = 16 AND mapq < 3",
    "pos BETWEEN 100 AND 90000",
    "rname = 'c1/a' AND rname = 'c2/a'",
    "rname = 'c1/a' AND qname LIKE 'q1%' AND pos < 400000",
    "rname = 'c1/a' AND pos < -5",
    "rname = 'c1/a' AND pos >= 2000000000",
    "(rname = 'c1/a' OR mapq = 7) AND NOT flag = 16",
]


@pytest.mark.parametrize("with_index", [True, False])
def test_filters_are_answered_by_the_source(spark, file, tmp_path, with_index):
    path, rows = file
    at = tmp_path / "r.bam"
    at.write_bytes(path.read_bytes())
    if with_index:
        (tmp_path / "r.bam.bai").write_bytes(index_of(path))
    whole = spark.createDataFrame(rows, ALIGNMENTS)
    pruned = bam.read_alignments(spark, str(at), split_bytes=40_000)
    assert pruned.rdd.getNumPartitions() > 5
    for case in CASES:
        assert rows_of(pruned.where(case)) == rows_of(whole.where(case)), case
    narrow = bam.read_alignments(spark, str(at), ["rname", "pos"], 40_000).where(CASES[0]).select("pos")
    assert sorted(r.pos for r in narrow.collect()) == sorted(r.pos for r in whole.where(CASES[0]).collect())
    plan = pruned.where(CASES[0])._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("Filters:", "")


def test_a_region_reads_only_its_chunks(file):
    path, rows = file
    index = path.with_name("r.bam.bai")
    index.write_bytes(index_of(path))
    try:
        reader = bam.PruningBamReader({"path": str(path)}, ["pos"])
        asked = [EqualTo(("rname",), "c1/a"), GreaterThanOrEqual(("pos",), 1_000_000), LessThan(("pos",), 1_050_000)]
        assert list(reader.pushFilters(asked)) == []
        spans = reader.partitions()
        got = [r[0] for s in spans for r in reader.read(s)]
        assert got == [r.pos for r in rows if r.rname == "c1/a" and 1_000_000 <= r.pos < 1_050_000] and got
        met = sum((b >> 16) - (a >> 16) for s in spans for a, b in s.ranges)
        assert met < path.stat().st_size // 8
        few = bam.PruningBamReader({"path": str(path)}, ["pos"])
        list(few.pushFilters([In(("rname",), ("c3/a", "nowhere"))]))
        assert few.partitions() == []
    finally:
        index.unlink()


@pytest.mark.parametrize("split", [977, 5000, 33_333, 1 << 20])
def test_files_without_an_index_are_split(spark, file, split):
    path, rows = file
    reader = bam.BamReader({"path": str(path), "splitBytes": str(split)}, ALIGNMENTS.fieldNames())
    spans = reader.partitions()
    assert len(spans) == -(-path.stat().st_size // split)
    parts = [[str(r[1:]) for r in reader.read(s)] for s in spans]
    assert [x for p in parts for x in p] == [str(tuple(r)[1:]) for r in rows]
    assert split > 50_000 or sum(bool(p) for p in parts) > 5


def test_small_files_without_an_index(spark, tmp_path):
    for n, rows in ((0, []), (1, reads(spark, 3)[:1]), (5, reads(spark, 9)[:5])):
        path = tmp_path / f"{n}.bam"
        save(path, rows, 90)
        for split in (20, 100, 1000):
            reader = bam.BamReader({"path": str(path), "splitBytes": str(split)}, ["qname"])
            assert [r[0] for s in reader.partitions() for r in reader.read(s)] == [r.qname for r in rows]


@pytest.mark.parametrize("single", [False, True])
def test_a_file_for_each_target(spark, tmp_path, single):
    """One target holds most rows and is several parts; mates and headers are renamed, targets without rows have a file."""
    rows = reads(spark, 600)
    df = spark.createDataFrame(rows, ALIGNMENTS).withColumn("rnext", F.when(F.col("pos") % 2 == 0, F.lit("c2/a")))
    refs = spark.createDataFrame([(k, n, size) for k, (n, size) in enumerate(REFS)], "ref_idx int, name string, length long")
    wanted = spark.createDataFrame([("c1", "one"), ("c2/", ".two"), ("none", None)], "name string, new_name string")
    split = subset.split_by_reference(df, wanted, prefix=True)
    renamed = subset.renamed_references(refs, wanted, prefix=True)
    header = sinks.header_text(renamed)
    path = tmp_path / "out"
    split_bam.write_split_bam(split, header, str(path), [r.name for r in wanted.collect()], "x-", single, files=5)
    names = sorted(str(p.relative_to(path)) for p in path.rglob("*.bam"))
    if single:
        assert names == ["x-c1.bam", "x-c2%2F.bam", "x-none.bam"] and sorted(p.name for p in path.iterdir()) == names
    else:
        assert len([n for n in names if n.startswith("c1/")]) > 2 and "none/part-empty.bam" in names
        assert sum(f["rows"] for f in split_bam.manifest(str(path))) == 800
        assert rows_of(bam.read_alignments(spark, str(path))) == rows_of(split.where("target IS NOT NULL").drop("target"))
    places = {"one": "c1", ".two": "c2/"}
    for target in ("c1", "c2/", "none"):
        mine = [n for n in names if split_bam.file_name(target) in n]
        got = []
        for n in mine:
            reader = bam.BamReader({"path": str(path / n)}, ["qname", "rname", "rnext"])
            got += [tuple(r) for s in reader.partitions() for r in reader.read(s)]
            text, of = bam.read_header(bgzf.BlockStream((path / n).open("rb")))
            assert of == [("one", 3_000_000), (".two", 500_000), ("c3/a", 100)] and text == header
        want = [(r.qname, r.rname, r.rnext) for r in split.where(F.col("target") == target).orderBy("rec_idx").collect()]
        assert got == want and all(places[r[1]] == target and r[2] in (None, ".two") for r in got)
        assert bool(got) == (target != "none")
    with pytest.raises(FileExistsError):
        split_bam.write_split_bam(split, header, str(path))


def test_a_failed_split_leaves_no_file(spark, tmp_path):
    df = spark.createDataFrame(reads(spark, 100), ALIGNMENTS).withColumn("target", F.col("rname"))
    broken = df.withColumn("qual", F.when(F.col("rec_idx") == 70, F.lit(" ")).otherwise(F.col("qual")))  # the writer can't encode it
    with pytest.raises(Exception, match="range\\(0, 256\\)"):
        split_bam.write_split_bam(broken, HEADER, str(tmp_path / "o"), single=True)
    assert not list((tmp_path / "o").rglob("*"))
