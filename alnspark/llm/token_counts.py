"""Operator 1: token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import spans, text_slices
from .transducer import END, MergeTransducer, char_classes, pretoken_starts

#: Characters worked on at once; a longer text is cut where a pre-token surely begins.
BATCH_CHARS = 1 << 19
LETTERS_END = re.compile(r"[^\W\d_](?=[\s!-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load_byte_bpe(path: str) -> tuple[MergeTransducer, tuple[str, ...]]:
    """The transducer of a byte-level BPE file and its added tokens; compiled once a worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("only byte-level BPE without a normaliser or a prefix space is compiled")
    alphabet = byte_alphabet()
    spell = lambda piece: bytes(alphabet[c] for c in piece)
    pieces = {spell(p): i for p, i in spec["model"]["vocab"].items()}
    merges = {}
    for k, pair in enumerate(spec["model"]["merges"]):
        a, b = map(spell, pair if isinstance(pair, list) else pair.split(" "))
        merges.setdefault((pieces[a], pieces[b]), (k, pieces[a + b]))
    return MergeTransducer(pieces, lambda a, b: merges.get((a, b)), utf8=False), tuple(t["content"] for t in spec["added_tokens"])


def cut(text: str, limit: int) -> Iterator[str]:
    """Parts of about ``limit`` characters, cut after a letter that no letter follows: a pre-token begins there in any case."""
    at = 0
    while len(text) - at > limit:
        found = LETTERS_END.search(text, at + limit)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def count_batch(machine: MergeTransducer, parts: list[str]) -> np.ndarray:
    """Tokens of each part."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    joined = "".join(parts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.cumsum(lengths) + np.arange(len(parts))  # in the stream with an END after each part
    classes = np.empty(len(chars) + len(parts), np.uint8)
    is_end = np.zeros(len(classes), bool)
    is_end[ends] = True
    classes[is_end] = END
    classes[~is_end] = char_classes()[chars]
    starts = pretoken_starts(classes)
    width = np.zeros(len(classes), np.int64)
    width[~is_end] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    byte_at = np.concatenate(([0], np.cumsum(width)))
    bounds = byte_at[np.append(starts, len(classes))]
    size = np.diff(bounds)
    real = size > 0
    counts = machine.run(data, bounds[:-1][real], size[real])
    part = np.searchsorted(ends, starts[real])
    return np.bincount(part, weights=counts, minlength=len(parts)).astype(np.int64)


def count_texts(path: str, texts: list[str], batch_chars: int = BATCH_CHARS) -> np.ndarray:
    """Tokens of each text; an added token's string within a text is one token, as is the library's default."""
    machine, added = load_byte_bpe(path)
    total = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    for k, text in enumerate(texts):
        pieces = [text]
        for special in added:
            if special in text:
                pieces = [x for p in pieces for x in p.split(special)]
        total[k] += len(pieces) - 1
        for p in pieces:
            for x in cut(p, batch_chars):
                if x:
                    parts.append(x)
                    owner.append(k)
    for a, b in spans(parts, len, batch_chars):
        np.add.at(total, owner[a:b], count_batch(machine, parts[a:b]))
    return total


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty: 0 bytes and 0 tokens.  Ids may be null or repeated; each row is
    counted on its own.  Other columns don't take part.  Texts of any length are read whole, in parts
    that end where letters do; only a run of letters is never parted.  Rows never meet, so nothing is shuffled and a lost task is simply run again.
    """
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 1, 2 * BATCH_CHARS):
                tokens = count_texts(tokenizer_path, texts)
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(tokens), pa.array(tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
