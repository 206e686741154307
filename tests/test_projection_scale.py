"""What projection reads, sends and compares: each alignment once, wanted columns only, few blocks a position."""

import random

import pytest
from pyspark.sql import functions as F

from alnspark.functions import cigar as C
from alnspark.operators import coordinates, project

TARGET, SOURCE = "ACGT--ACGTACGTAC", "ACGTTTAC-TACG-AC"


@pytest.fixture(scope="module")
def index(spark):
    aligned = spark.createDataFrame([("c", "s", SOURCE), ("c", "t", TARGET)], "chr string, seq_id string, seq string")
    return coordinates.build_msa_index(aligned).localCheckpoint(), spark.createDataFrame([("c", TARGET.replace("-", ""))], "name string, seq string")


def reads(spark):
    bases = SOURCE.replace("-", "")
    rows = [(k, f"q{k}", 1, "c/s", k % 8, 9, "5M", "c/s" if k % 3 else None, k % 5 if k % 3 else None, bases[k % 8 : k % 8 + 5], "IIIII") for k in range(40)]
    df = spark.createDataFrame(rows, "rec_idx long, qname string, flag int, rname string, pos int, mapq int, text string, rnext string, pnext int, seq string, qual string")
    return df.withColumn("cigar", C.parse(F.col("text"))).withColumn("tags", F.create_map(F.lit("NM"), F.lit("i:1")))


def test_alignments_are_read_once_for_counts_and_once_for_projection(spark, index, tmp_path):
    reads(spark).write.parquet(str(tmp_path / "reads"))
    df = project.project_alignments(spark.read.parquet(str(tmp_path / "reads")), *index, "t")
    assert len(df.collect()) == 40
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Final Plan" in final and final.count("FileScan parquet") == 2


def test_alignments_are_not_shuffled_to_meet_the_counts(spark, index):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = project.project_alignments(reads(spark), *index, "t")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    side = plan.split("FlatMapCoGroupsInArrow")[1].split("Generate")[0]
    joins = [x for x in side.splitlines() if "Join" in x and "level#" in x]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0]


def test_deep_chunks_are_dealt_without_a_change_of_results(spark, index):
    rows = [sorted(map(tuple, project.project_alignments(reads(spark), *index, "t", group=g).collect())) for g in (20_000, 3)]
    assert len(rows[0]) == 40 and rows[0] == rows[1]


def test_only_wanted_columns_pass_python(spark, index):
    whole = project.project_alignments(reads(spark), *index, "t")
    assert whole.columns == list(project.PROJECTED)
    for columns in (("rec_idx", "pos", "oa"), ("rname", "yb"), tuple(project.PROVENANCE), ("cigar", "qual")):
        df = project.project_alignments(reads(spark), *index, "t", columns=columns)
        assert sorted(df.columns) == sorted(columns)
        assert sorted(map(repr, df.collect())) == sorted(map(repr, whole.select(df.columns).collect()))
    plan = project.project_alignments(reads(spark), *index, "t", columns=project.PROVENANCE)._jdf.queryExecution().optimizedPlan().toString()
    made = next(x for x in plan.splitlines() if "FlatMapCoGroupsInArrow" in x)
    assert not any(f" {c}#" in made.split("), [")[-1] for c in ("qname", "qual", "tags", "text", "dst_cigar"))
    with pytest.raises(ValueError, match="no columns"):
        project.project_alignments(reads(spark), *index, "t", columns=["nowhere"])


def test_positions_meet_few_blocks_however_short(spark):
    r = random.Random(3)
    short = "".join(r.choice("ACGT") + "-" * r.choice([0, 0, 1, 3]) for _ in range(3000))
    n = len(short)
    pairs = {"s": short, "t": "A" * (n // 2) + "".join(r.choice("A-") for _ in range(n - n // 2 - 40)) + "-" * 40}
    blocks = coordinates.build_msa_index(spark.createDataFrame([("c", k, x) for k, x in pairs.items()], "chr string, seq_id string, seq string")).localCheckpoint()
    places = [k for k in range(3100)]
    df = spark.createDataFrame([(k, "c", "s", "t", k) for k in places], "id int, chr string, src string, dst string, pos long")
    columns = [k for k, b in enumerate(short) if b != "-"]
    target = pairs["t"]
    want = {k: (columns[k], target[: columns[k]].count("A"), target[columns[k]] == "-") if k < 3000 else (None, None, None) for k in places}
    assert {x.id: (x.aln, x.dst_pos, x.dst_gap) for x in coordinates.project_positions(df, blocks).collect()} == want
    widths = blocks.groupBy("seq_id").agg(coordinates.bin_width(F.max(F.col("seq_start") + F.col("len")), F.count(F.lit(1)), coordinates.BIN).alias("w"), F.max("len").alias("most")).collect()
    assert all(1 <= x.w < 64 for x in widths)
