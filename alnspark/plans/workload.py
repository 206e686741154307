"""Genomic views over the driver's tables, by integer arithmetic that Spark and DuckDB evaluate alike.

``cte(...)`` gives the views as common table expressions for either engine; ``view()`` one of them as a DataFrame.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C

ALIGNED_LENGTH = 6000


def _i(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def _rname(e: str) -> str:
    return f"concat('chr', CAST(({_i(f'({e})/4')} + {_i(f'({e})/2')}) % 5 AS STRING), '/s', CAST(({_i(f'({e})/2')} * 7) % 5 AS STRING))"


def _pos(e: str) -> str:
    return f"CAST((({e}) * 37 + ({_i(f'({e})/2')} % 3) * 11) % 5000 AS INT)"


_MATE = "(event_id + 1 - 2 * (event_id % 2))"
_LENGTHS = {"s": "1 + event_id % 4", "m1": "20 + event_id % 17", "i": "1 + event_id % 3", "m2": "10 + event_id % 7", "d": "1 + event_id % 5", "m3": "5 + event_id % 6"}
_TEXT = {k: f"CAST({v} AS STRING)" for k, v in _LENGTHS.items()}
#: CIGARs with every operation; what they take of the read and the reference is the same.
_SHAPES = {1: "3:H s:S m1:M i:I m2:M d:D m3:M", 2: "s:S m1:= i:I m2:X d:N m3:M", 3: "s:S m1:M 2:P i:I m2:M d:D m3:M 1:P", 4: "m1:M i:I m2:M d:D m3:M s:S 1:H", 5: "m1:M i:I m2:M d:D m3:M 2:N s:S"}
#: Some reads have no mates, some have them only for a part of their records.
_PAIRED = f"{_i('event_id/4')} % 43 <> 0 AND event_id % 101 <> 0"


def _shape(items: str) -> str:
    return "concat(" + ", ".join(f"{_TEXT.get(n, repr(n))}, '{op}'" for n, op in (x.split(":") for x in items.split())) + ")"


_QUERY = "CAST(" + " + ".join(f"({_LENGTHS[k]})" for k in ("s", "m1", "i", "m2", "m3")) + " AS INT)"

ALIGNMENTS = f"""
SELECT event_id AS rec_idx, concat('r', CAST({_i("event_id/4")} AS STRING)) AS qname,
    CAST(1 + 16 * (event_id % 2) + CASE WHEN event_id % 29 = 0 THEN 4 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 256 ELSE 0 END
        + CASE WHEN event_id % 37 = 0 THEN 1024 ELSE 0 END + CASE WHEN event_id % 41 = 0 THEN 2048 ELSE 0 END AS INT) AS flag,
    {_rname("event_id")} AS rname, {_pos("event_id")} AS pos,
    CAST(CASE WHEN event_id % 11 = 0 THEN 255 ELSE (event_id * 13) % 43 END AS INT) AS mapq,
    CASE event_id % 7 {" ".join(f"WHEN {k} THEN {_shape(v)}" for k, v in _SHAPES.items())} ELSE {_shape("s:S m1:M i:I m2:M d:D m3:M")} END AS cigar_text,
    CASE WHEN {_PAIRED} THEN {_rname(_MATE)} END AS rnext,
    CASE WHEN {_PAIRED} THEN {_pos(_MATE)} END AS pnext,
    substr(repeat('ACGTTGCANGTCA', 10), CAST(1 + event_id % 13 AS INT), {_QUERY}) AS seq,
    substr(repeat('I5?A+7', 20), CAST(1 + event_id % 6 AS INT), {_QUERY}) AS qual,
    CAST({_QUERY} AS BIGINT) AS seq_length, CASE WHEN event_id % 47 <> 0 THEN CAST(-(event_id % 31) AS INT) END AS as_score
FROM events"""

REFS = """
SELECT n_nationkey AS ref_idx, concat('chr', CAST(n_nationkey % 5 AS STRING), '/s', CAST(CAST(floor(n_nationkey / 5) AS INT) AS STRING)) AS name,
    CAST(5000 + n_nationkey AS BIGINT) AS length FROM nation"""

_GAP = "(CAST(floor(i / 7) AS BIGINT) * 31 + n_nationkey * 13) % 19 = 0 OR (i * 5 + n_nationkey) % 53 = 0"
_BASE = "substr('ACGT', CAST(1 + (i * i + CAST(floor(i / 3) AS BIGINT) + CASE WHEN (i + n_nationkey) % 17 = 0 THEN 1 ELSE 0 END) % 4 AS INT), 1)"
_LETTER = f"CASE WHEN {_GAP} THEN '-' ELSE {_BASE} END"


def aligned_sql(duckdb: bool) -> str:
    text = f"array_to_string(list_transform(range({ALIGNED_LENGTH}), lambda i: {_LETTER}), '')" if duckdb else f"array_join(transform(sequence(0, {ALIGNED_LENGTH - 1}), i -> {_LETTER}), '')"
    return f"SELECT concat('chr', CAST(n_nationkey % 5 AS STRING)) AS chr, concat('s', CAST(CAST(floor(n_nationkey / 5) AS INT) AS STRING)) AS seq_id, {text} AS seq FROM nation"


VARIANTS = """
SELECT p_partkey AS var_id, concat('chr', CAST(p_partkey % 5 AS STRING)) AS chrom, CAST((p_partkey * 29) % 5000 AS BIGINT) AS pos,
    substr('ACGTAC', CAST(1 + p_partkey % 4 AS INT), CAST(1 + p_partkey % 3 AS INT)) AS ref, substr('GTACGTAA', CAST(1 + p_partkey % 4 AS INT), CAST(1 + p_partkey % 4 AS INT)) AS alt,
    CAST(1 + p_partkey % 3 AS BIGINT) AS ref_len, CAST(1 + p_partkey % 4 AS BIGINT) AS alt_len, CAST(p_partkey % 2 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS zygosity
FROM part"""

REGIONS = """
SELECT concat('chr', CAST(s_suppkey % 5 AS STRING)) AS chr, CAST((s_suppkey * 97) % 5000 AS BIGINT) AS lb, CAST((s_suppkey * 97) % 5000 + 1 + s_suppkey % 200 AS BIGINT) AS rb
FROM supplier"""

#: CIGAR items of an alignment in DuckDB, exploded with their number.
ITEMS = """
SELECT rec_idx, pos, k, CAST(left(t, length(t) - 1) AS BIGINT) AS n, right(t, 1) AS op FROM (
    SELECT rec_idx, pos, unnest(regexp_extract_all(cigar_text, '[0-9]+[A-Z=]')) AS t, generate_subscripts(regexp_extract_all(cigar_text, '[0-9]+[A-Z=]'), 1) AS k FROM alignments)"""

#: Gap-free runs of the aligned sequences in DuckDB.
BLOCKS = """
SELECT chr, seq_id, min(i) AS aln_start, min(r) AS seq_start, count(*) AS len FROM (
    SELECT chr, seq_id, i, row_number() OVER (PARTITION BY chr, seq_id ORDER BY i) - 1 AS r FROM (
        SELECT chr, seq_id, i, substr(seq, CAST(i + 1 AS INT), 1) AS b FROM aligned, (SELECT unnest(range(6000)) AS i)) WHERE b <> '-')
GROUP BY chr, seq_id, i - r"""

VIEWS = {"alignments": ALIGNMENTS, "refs": REFS, "variants": VARIANTS, "regions": REGIONS, "items": ITEMS, "blocks": BLOCKS}


def cte(*names: str) -> str:
    """``WITH`` clause for DuckDB, in the order given; "items" needs "alignments", "blocks" needs "aligned"."""
    return "WITH " + ", ".join(f"{n} AS ({aligned_sql(True) if n == 'aligned' else VIEWS[n]})" for n in names) + " "


_TABLE = {"alignments": "events", "refs": "nation", "variants": "part", "regions": "supplier", "aligned": "nation"}


def view_of(spark: SparkSession, source: DataFrame, name: str) -> DataFrame:
    """The view over a given table, which may be a stream."""
    sql = aligned_sql(False) if name == "aligned" else VIEWS[name]
    return spark.sql(sql.replace(f"FROM {_TABLE[name]}", "FROM {source}"), source=source)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view_of(spark, spark.read.parquet(f"{sf_dir}/{_TABLE[name]}.parquet"), name)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With parsed CIGARs, tags, and the places before projection, which are those of the view."""
    df = view(spark, sf_dir, "alignments").withColumn("cigar", C.parse(F.col("cigar_text")))
    df = df.withColumn("tags", F.map_from_arrays(F.array(F.lit("AS"), F.when(F.col("rec_idx") % 2 == 0, "OQ").otherwise("ZZ"), F.lit("XM")), F.array(F.concat(F.lit("i:"), F.col("as_score").cast("string")), F.lit("Z:x"), F.lit("i:0"))))
    return df.withColumn("score", F.col("as_score").cast("double"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, as an index is that many lookups read.

    ``spark.checkpoint.dir`` names the folder; only a session on one machine may leave it unset.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir isn't set: an index needs a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="alnspark-"))
    return df.checkpoint()
