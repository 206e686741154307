"""A pipeline over ``documents``: quality filter, exact and near dedup, mixing of sources, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns the columns of documents, the last
one the encoded texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from alnspark.llm.common import materialise, table
from alnspark.llm.exact_dedup import keep_last
from alnspark.llm.minhash import keep_one
from alnspark.llm.mixing import mixed
from alnspark.llm.quality import keep_good
from alnspark.llm.sentencepiece_fst import encode_decode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id."""
    return keep_last(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return keep_one(docs, k=5, percent=80)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in weights of 5, 2, 1; a document comes as often as the mix takes it, in whole copies that keep each source's share."""
    return mixed(docs, nearest=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces, decoded, round_trip."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", sources), ("sentencepiece", encode)]

#: The quality and encoding stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
