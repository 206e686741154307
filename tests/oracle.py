"""Compare queries with their SQL in DuckDB, and a session for tests."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb
from pyspark.sql import SparkSession


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", "/tmp/alnspark-warehouse")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark: SparkSession, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    got = connect(sf_dir).execute(sql)
    names = [c[0] for c in got.description]
    other = rows(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if not mine:
        return "no rows, so nothing is compared"
    if mine != other:
        odd = next((a, b) for a, b in zip(mine + [None], other + [None], strict=False) if a != b) if mine and other else (mine[:1], other[:1])
        return f"{len(mine)} and {len(other)} rows; first differing: {odd}"
    return ""
