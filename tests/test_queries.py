"""Every query against its SQL on the smallest tables; those without SQL return rows."""

import pytest

from alnspark.operators import coordinates, order
from alnspark.plans.registry import ORACLES, QUERIES, flagship
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert compare(spark, QUERIES[name], ORACLES[name], SMALL) == ""
    else:
        assert QUERIES[name](spark, SMALL).count() > 0


def test_flagship(spark):
    assert flagship(spark, SMALL).count() > 0


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "alnspark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__

    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_merge_refuses_a_repeated_sequence(spark):
    blocks = spark.createDataFrame([("c", "s", 0, 0, 2)], "chr string, seq_id string, aln_start long, seq_start long, len long")
    with pytest.raises(Exception, match="in both indices"):
        coordinates.merge_index(blocks, blocks).collect()


def test_runs_across_ranges(spark):
    names = ["a", "a", "b", "b", "b", "a", "c", "c"]
    df = spark.createDataFrame(list(enumerate(names)), "rec_idx long, qname string")
    got = order.consecutive_runs(df, width=3).orderBy("rec_idx").collect()
    assert [r.run for r in got] == [1, 1, 2, 2, 2, 3, 4, 4]


def test_places_over_all_references(spark):
    rows = [(k, ("b", "a", None)[k % 3], (k * 7) % 10) for k in range(30)]
    df = spark.createDataFrame(rows, "rec_idx long, rname string, pos int")
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2], r[0]))]
    assert [r.rec_idx for r in order.coordinate_places(df, width=3).orderBy("place").collect()] == want
    assert sorted(r.place for r in order.coordinate_places(df).collect()) == list(range(1, 31))
    assert [r.rec_idx for r in order.coordinate_sort(df).collect()] == want


def test_whole_views_are_registered(spark):
    n = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert QUERIES["coordinate_places"](spark, SMALL).count() == n and QUERIES["concatenation_whole"](spark, SMALL).count() == 2 * n
