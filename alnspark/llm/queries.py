"""The queries of the operators, over the driver's tables, and the SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversation_repair import damaged, repair_conversations, transcript_digests
from .exact_dedup import exact_dedup
from .mixing import mix
from .html_text import main_text
from .minhash import near_duplicates
from .periodic_runs import periodic_runs, with_planted_period
from .quality import classify_quality
from .sentencepiece_fst import encode_decode
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .topk import top_k
from .toxicity import score_toxicity
from .url_filter import filter_urls, rule_table

#: The rules of the query on URLs.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of offending sentences and where the worst of them stands."""
    done = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    worst = F.array_max(F.transform("offending", lambda s: F.struct(s["score"], s["start"], s["stop"])))
    done = done.withColumn("worst", worst).withColumn("n_offending", F.size("offending").cast("long"))
    return done.select("doc_id", "held_out", "score", "predicted", "n_offending", F.col("worst.start").alias("worst_start"), F.col("worst.stop").alias("worst_stop"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as text rather than an array keep the result comparable by value."""
    done = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_pieces", F.md5(F.concat_ws(",", "pieces")).alias("pieces_md5"), F.md5("decoded").alias("decoded_md5"), "round_trip")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods and six words, in texts of which a tenth have a period planted."""
    docs = table(spark, sf_dir, "documents")
    done = periodic_runs(docs.select("doc_id", with_planted_period(docs).alias("text")), least_exponent=4, least_length=6)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair; every original conversation has a row."""
    conversations = table(spark, sf_dir, "conversations")
    done = repair_conversations(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("c")).distinct()
    hashed = transcript_digests(done.turns).select(F.col("conv_id").alias("h"), "sha256")
    found = every.join(done.conversations, F.col("c").eqNullSafe(F.col("conv_id")), "left").join(hashed, F.col("c").eqNullSafe(F.col("h")), "left")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by an earlier string of 100 bytes go."""
    done = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_url_filters": op4_url_filters,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_minhash": op6_minhash,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_url_filters": f"""
        WITH rules(verdict, rule, r_host, r_path) AS (
            VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                   ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
        split AS (SELECT row_number() OVER () AS r, page_id,
            CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT r, page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
        fits AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (r)""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
