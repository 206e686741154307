"""Bounded samples of labelled documents, and scoring of all documents with a small model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_slices

#: A classifier is fitted on at most SAMPLE_ROWS labelled documents of at most SAMPLE_CHARS characters together, whole texts, those
#: with the smallest hashes of their ids; one that would pass the second bound is left out.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 12_000_000
#: Bytes of text scored at once.
BATCH_BYTES = 1 << 19


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", holding_out: bool = True) -> list[tuple[str, int]]:
    """(text, 0 or 1) of a bounded sample of labelled rows that are not held out.

    Rows without a label, an id or a document don't count; of several labels of a document the highest does, and a repeated document
    counts each time that it is chosen.  Labels meet ids and lengths first, so only the chosen texts are moved, each once.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label].cast("int").alias("y")).dropna()
    if holding_out:
        known = known.where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    every = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    first = every.select("id", F.length("text").alias("n"), F.xxhash64("text").alias("t")).join(known, "id").orderBy(F.xxhash64("id"), "id", "t").limit(rows).collect()
    chosen, left = [], chars
    for r in first:
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["id"], r["t"], int(r["y"] > 0)))
    if not chosen:
        return []
    kind = known.schema["id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([*dict.fromkeys(c[:2] for c in chosen)], f"id {kind}, t long")  # at most ``rows``
    met = every.withColumn("t", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "t"]).groupBy("id", "t").agg(F.first("text").alias("text"))
    texts = {(r["id"], r["t"]): r["text"] for r in met.collect()}  # each chosen text once, however often its row is repeated
    return [(texts[i, t], y) for i, t, y in chosen]


def score(docs: DataFrame, model: object, apply: Callable[[object, list[str]], list[pa.Array]], fields: str, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """``apply(model, texts)`` on every whole text (null as empty), with held_out.  The model is broadcast: its size is fixed by its parameters."""
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 1, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), *apply(held.value, texts)], [id_col, *names])

    out = chosen.mapInArrow(run, f"`{id_col}` {kind}, {fields}")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), *names)
