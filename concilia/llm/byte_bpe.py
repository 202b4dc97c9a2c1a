"""Byte-level BPE by a sentencepiece model serialised from a rank file.

The rank file lists byte strings in merge order. Each becomes one piece
of a sentencepiece BPE model: byte b is written as the character
U+0100 + b, the score is the negative rank, normalisation is the identity
(no prefix, no white-space rewriting). Merging the best-scored adjacent
pair first is merging the lowest rank first, so encoding a pre-token's
byte characters gives the rank file's ids (shifted by one for the unknown
piece that the format requires). A pre-token that is itself in the
vocabulary is its own id, as in rank-file encoders. Decoding maps ids back to their
byte strings; any id sequence decodes, whole or not.

Null text is empty; null and repeated ids keep one row per input row; an
empty table gives no rows; other columns are ignored. Map only: no shuffle, one Arrow batch in
memory, one memo of bounded size per task that encodes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_fields, body, map_rows, on_workers, slices

SHIFT = 0x100
MEMO = 500_000
#: Longer pre-tokens are encoded, but not remembered.
LONG = 64
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _message(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def byte_chars(b: bytes) -> str:
    """Each byte as the character U+0100 + byte."""
    return b.decode("latin-1").translate(_TABLE)


_TABLE = {b: SHIFT + b for b in range(256)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece id = rank + 1."""
    size = max(ranks.values(), default=-1) + 1
    by_rank = {r: t for t, r in ranks.items()}
    piece = lambda text, score, kind: _message(1, (
        _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)))
    pieces = [piece("<unk>", 0.0, _UNKNOWN)]
    for r in range(size):
        # a rank that the file leaves out keeps its id, with a piece that no text can hold
        pieces.append(piece(byte_chars(by_rank[r]) if r in by_rank else f"<{r}>", -float(r), _NORMAL))
    trainer = _number(3, _BPE) + _number(4, size + 1)
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normaliser)


class Codec:
    def __init__(self, rank_path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(rank_path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.find = regex.compile(pattern).findall
        self.memo = Memo(MEMO)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pre = [self.find(t) for t in texts]
        memo = self.memo
        new = {w for words in pre for w in words if w not in memo}
        memo.room(len(new))
        if not memo:
            new = {w for words in pre for w in words}
        left = []
        for w in new:
            r = self.ranks.get(w.encode())
            if r is None:
                left.append(w)
            else:
                memo[w] = struct.pack("<I", r)
        for w, ids in zip(left, self.sp.encode([byte_chars(w.encode()) for w in left], num_threads=1)):
            memo[w] = array("I", [i - 1 for i in ids]).tobytes()
        get = memo.__getitem__
        out = [b"".join(map(get, words)) for words in pre]
        for w in left:
            if len(w) > LONG:
                del memo[w]
        return out


@lru_cache(maxsize=4)
def codec(rank_path: str, pattern: str) -> Codec:
    return Codec(rank_path, pattern)


@lru_cache(maxsize=4)
def tokens(rank_path: str) -> dict[int, bytes]:
    return {r: t for t, r in read_ranks(rank_path).items()}


def decode(ids: bytes, rank_path: str) -> bytes:
    return b"".join(map(tokens(rank_path).__getitem__, memoryview(ids).cast("I")))


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns ``carry``, ids (binary, little-endian unsigned 32-bit)."""
    kept = [id_col, *carry]
    return map_rows(docs.select(*kept, body(text_col)),
                    lambda *cols: (*cols[:-1], [x for run in slices(cols[-1]) for x in codec(rank_path, pattern).encode(run)]),
                    f"{_types(docs, kept)}, ids binary")


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
               carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns ``carry``, text_bytes (binary)."""
    kept = [id_col, *carry]
    return map_rows(encoded.select(*kept, F.col("ids").alias("__ids")),
                    lambda *cols: (*cols[:-1], [decode(x, rank_path) for x in cols[-1]]),
                    f"{_types(encoded, kept)}, text_bytes binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text", carry: tuple[str, ...] = (), ids: bool = False) -> DataFrame:
    """Per row: id, the columns ``carry``, n_tokens, ids_sha256,
    decoded_sha256, and ids if wanted. Texts are encoded and the ids decoded
    in one pass over a batch, some texts at a time."""
    kept = [id_col, *carry]
    schema = f"{_types(docs, kept)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    names, types = arrow_fields(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = 0
            for texts in slices(b.column(len(kept)).to_pylist()):
                codes = codec(rank_path, pattern).encode(texts)
                cols = [b.column(i).slice(at, len(texts)).cast(types[i]) for i in range(len(kept))]
                cols += [pa.array([len(x) // 4 for x in codes], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in codes]),
                         pa.array([hashlib.sha256(decode(x, rank_path)).hexdigest() for x in codes])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(codes, pa.binary())] * ids, names=names)
                at += len(texts)
        codec(rank_path, pattern).memo.clear()  # idle workers live on beside those of later stages

    return on_workers(docs.select(*kept, body(text_col)), run, schema)
