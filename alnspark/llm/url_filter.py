"""Operator 4: URL rules by host suffix and path prefix, in DataFrame operations only.

A URL is expanded into its host suffixes times its path prefixes; the expressions meet the rules on a short
prefix of their SHA-256, then the full digests must agree, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hex digits of the digest on which URLs and rules meet.
PREFIX = 8
#: A rule list of at most so many rows (some 100 bytes each) is broadcast; beyond it, the distinct expressions join by shuffle.
BROADCAST_RULES = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(verdict, expression) pairs such as ("block", "example.com/de/") as host, path, rule, verdict."""
    rows = [(v, e, e[: e.index("/")] if "/" in e else e, e[e.index("/") :] if "/" in e else "") for v, e in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict.

    A rule fits its host and every subdomain when the path begins with the rule's.  Of several the longest expression wins,
    then the longer host, then block before allow.  Without one, rule is null and the verdict is ``default``.  A null
    URL, or one without ``://``, has an empty host and path.  Repeated rows and null ids are judged each.

    Path prefixes are cut at the lengths that occur in rule paths, so any string prefix is met exactly; host suffixes have at most
    as many labels as the longest rule host, so a URL of very many labels makes no more of them.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "rule", F.col("verdict").alias("r_verdict"))
    lengths = rules.select(F.length("r_path").alias("n")).distinct().orderBy("n")  # a few: no path is longer than a URL
    depth = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("n")).first()["n"] or 1
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rules = rules.withColumn("r_digest", digest(F.concat_ws("\n", "r_host", "r_path"))).withColumn("short", F.substring("r_digest", 1, PREFIX))
    best = F.struct(F.length("rule").alias("n"), F.length("r_host").alias("m"), (F.col("r_verdict") == "block").alias("b"), "rule", "r_verdict")
    rules = rules.groupBy("short", "r_digest").agg(F.max(best).alias("best"))
    lengths = [r["n"] for r in lengths.collect()]

    host, path = host_and_path(F.col("url"))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (depth - 1)), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\n", h, p))))
    expanded = rows.withColumn("expression", F.explode_outer(expressions)).withColumn("digest", digest(F.col("expression"))).withColumn("short", F.substring("digest", 1, PREFIX))
    if rules.count() <= BROADCAST_RULES:
        met = expanded.join(F.broadcast(rules), "short", "left")
    else:  # a hot expression is looked up once
        hits = expanded.select("short", "digest").distinct().join(rules, "short").where("digest = r_digest").select("digest", "r_digest", "best")
        met = expanded.join(hits, "digest", "left")
    sure = F.when(F.col("digest") == F.col("r_digest"), F.col("best"))
    judged = met.groupBy("row", "id", "host", "path").agg(F.max(sure).alias("best"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
