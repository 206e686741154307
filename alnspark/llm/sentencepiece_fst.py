"""Operator 5: SentencePiece encoding and decoding by a weighted finite-state transducer.

Composition is associative: the normaliser (dummy prefix, U+0020 to U+2581), a transducer of one state, is applied to the input first, then
the one of pieces and byte fallback.  That gives a lattice of pieces; an arc costs nothing
if ranked merging leaves its piece beside the one before it, infinity otherwise, so the
shortest path in the tropical semiring is the only one of finite cost and equals the library's result.
The forward pass keeps the best last piece at each byte, the backward pass reads the path.  Models of another kind, or with another
normaliser, are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spans, text_slices
from .transducer import UNKNOWN, MergeTransducer

SPACE = "▁"
BATCH_BYTES = 1 << 19
#: Bytes of a segment from which on it is read back by itself.
LONG = 4096


def check_supported(path: str) -> None:
    """Raise an error unless the model is BPE with byte fallback, keeps spaces as they are, adds the dummy prefix and has no character map."""
    with open(path, "rb") as f:
        model = fields(f.read(), {2, 3})
    train = fields(model.get(2, [b""])[-1], {3, 24, 35})
    normal = fields(model.get(3, [b""])[-1], {2, 3, 4, 5})
    one = lambda found, number, default: found.get(number, [default])[-1]
    wrong = [
        name
        for name, bad in {
            "the model isn't BPE": one(train, 3, 1) != 2,
            "it has no byte fallback": not one(train, 35, 0),
            "white space is a suffix": bool(one(train, 24, 0)),
            "it maps characters": bool(one(normal, 2, b"")),
            "it adds no dummy prefix": not one(normal, 3, 1),
            "it drops extra white space": bool(one(normal, 4, 1)),
            "it doesn't escape white space": not one(normal, 5, 1),
        }.items()
        if bad
    ]
    if wrong:
        raise ValueError(f"{path} can't be compiled: {', '.join(wrong)}")


def fields(data: bytes, wanted: set[int]) -> dict[int, list]:
    """Values of some fields of a protocol buffer message: numbers, or bytes of strings and messages."""
    found: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        if key >> 3 in wanted:
            found.setdefault(key >> 3, []).append(value)
    return found


class Codec:
    """Encodes and decodes lists of texts with the pieces of a BPE ``.model`` that has byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        check_supported(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        text = {i: model.id_to_piece(i) for i in ids}
        self.byte_id = np.zeros(256, np.int32)
        for i in ids:
            if model.is_byte(i):
                self.byte_id[int(text[i][3:-1], 16)] = i
        pieces = {text[i].encode(): i for i in ids if i not in special}
        by_score = {i: -model.get_score(i) for i in pieces.values()}
        spelt = {i: p for p, i in pieces.items()}

        def rank(a: int, b: int):
            if a < 0 or b < 0:
                return None
            i = pieces.get(spelt[a] + spelt[b])
            return None if i is None else (by_score[i], i)

        self.machine = MergeTransducer(pieces, rank, utf8=True)
        said = [b""] * len(ids)
        for i in ids:
            said[i] = bytes([int(text[i][3:-1], 16)]) if model.is_byte(i) else b"" if i in special else text[i].replace(SPACE, " ").encode()
        self.length = np.array([len(text[i].encode()) if i not in special else 1 for i in ids], np.int64)
        self.said_length = np.array([len(s) for s in said], np.int64)
        self.said_at = np.concatenate(([0], np.cumsum(self.said_length)[:-1]))
        self.said = np.frombuffer(b"".join(said), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many belong to each text.  An empty text has none."""
        normal = [(SPACE + t.replace(" ", SPACE)).encode("utf-8", "replace") if t else b"" for t in texts]
        size = np.fromiter(map(len, normal), np.int64, len(normal))
        flat = np.zeros(0, np.int32)
        counts = np.zeros(len(texts), np.int64)
        out = []
        for a, b in spans(normal, len, BATCH_BYTES):
            ids, at = self._encode(np.frombuffer(b"".join(normal[a:b]), np.uint8), size[a:b])
            out.append(ids)
            counts[a:b] = np.bincount(np.searchsorted(np.cumsum(size[a:b]), at, side="right"), minlength=b - a)
        return (np.concatenate(out) if out else flat), counts

    def _encode(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a batch and the byte at which each ends."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        # no piece holds U+2581 after another character: what begins with one after something else is a segment
        space = np.zeros(n, bool)
        space[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begins = space.copy()
        begins[3:] &= ~space[:-3]
        begins[0] = True
        begins[np.cumsum(size)[:-1][np.cumsum(size)[:-1] < n]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, n))
        last = np.empty(n, np.int32)
        self.machine.run(data, starts, lengths, last)
        out = np.full(n, -1, np.int32)
        long = lengths > LONG
        for stop, size in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
            self._read_back(data, last, out, stop, stop + size - 1)
        at, stop = (starts + lengths - 1)[~long], starts[~long]
        while len(at):
            piece = last[at]
            unknown = piece == UNKNOWN
            if unknown.any():  # a byte at a time: the bytes before the last of a symbol have no last piece of their own
                out[at[unknown]] = self.byte_id[data[at[unknown]]]
                lead = at[unknown]
                follows = (data[lead] & 0xC0) == 0x80
                inner = (lead - 1)[follows]
                last[inner] = UNKNOWN
            known = ~unknown
            out[at[known]] = piece[known]
            step = np.ones(len(at), np.int64)
            step[known] = self.length[piece[known]]
            at = at - step
            go = at >= stop
            at, stop = at[go], stop[go]
        where = np.flatnonzero(out >= 0)
        return out[where], where

    def _read_back(self, data: np.ndarray, last: np.ndarray, out: np.ndarray, stop: int, at: int) -> None:
        """The path of one long segment, whose pieces are read one after another."""
        raw, piece, length = data[stop : at + 1].tobytes(), last[stop : at + 1].tolist(), self.length
        found, where, base, at, inner = [], [], stop, at - stop, False
        while at >= 0:
            if inner or piece[at] == UNKNOWN:
                found.append(int(self.byte_id[raw[at]]))
                step, inner = 1, raw[at] & 0xC0 == 0x80
            else:
                found.append(piece[at])
                step = int(length[piece[at]])
            where.append(at)
            at -= step
        out[np.array(where) + base] = found

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids: pieces joined, the dummy prefix's space left out."""
        length = self.said_length[ids]
        total = int(length.sum())
        begin = np.cumsum(length) - length
        src = np.repeat(self.said_at[ids] - begin, length) + np.arange(total)
        data = self.said[src].tobytes()
        ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(counts)))]
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
        return out


@lru_cache(maxsize=2)
def load_codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, pieces (array of ids), n_pieces, decoded, round_trip (decoded equals the text).

    A null or empty text has no pieces and decodes to the empty string.  What normalising loses does not come back:
    a literal U+2581 is decoded as a space and round_trip is false there.  Rows are encoded whole and apart from
    each other, repeated ids too; other columns don't take part.
    """
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(model_path)
        for batch in batches:
            for part, texts in text_slices(batch, 1, 4 * BATCH_BYTES):
                ids, counts = codec.encode(texts)
                decoded = codec.decode(ids, counts)
                pieces = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids))
                same = pa.array([x == y for x, y in zip(decoded, texts, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pieces, pa.array(counts), pa.array(decoded), same], [id_col, "pieces", "n_pieces", "decoded", "round_trip"])

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, pieces array<int>, n_pieces long, decoded string, round_trip boolean")
