"""Token-id store: documents compressed one by one with a shared dictionary.

Layout under ``root`` (any file system that Spark writes to):

* ``dictionary``  one row: hash (SHA-256 hex) and bytes of a zstandard
  dictionary trained on serialised id arrays, and the id width in bytes
* ``shards``      uncompressed Parquet, sorted by document id: one row per
  shard of at most SHARD_DOCS documents: part and shard number,
  dictionary hash, smallest and largest id, token offset of the shard within its part,
  the ids of its documents, byte offsets of their frames, and the frames
  back to back. Each document is one frame, so reading a short document
  costs one shard row, one slice and one small decompression
* ``parts``       tokens before each part (one row per write task)

The global token offset of a document is parts + shard + the counts before
it in its shard; no step numbers all documents in one task. Texts are
dealt by id range (one shuffle of the texts); a task holds one shard.

The dictionary is fitted on a bounded sample: the SAMPLE_DOCS rows with the
smallest hash of their id, one text of each id, at most SAMPLE_BYTES of ids
each. All else covers every document.

Ids are encoded by the tokenizers library. White space separates this
vocabulary's pre-tokens and is dropped; so are letters, punctuation and single
digits pre-tokens of their own, as long as no apostrophe or character of another
kind stands beside them. Texts are cut at these places, many at a time, and each
distinct piece is encoded once per worker, many in one call: pieces of letters
are told from each other by the mark that ends a pre-token's last token; all
others have a one-token separator between them. ASCII letters are lower-cased
before pieces are looked up, as the vocabulary's normalisation does, unless the
text has combining marks, which could compose otherwise. A text in which, after
that, a special string could be seen, or the separator occurs, is encoded
as a whole.

Null text is empty (just the end id); null ids sort first; rows that
repeat an id are stored in order of their texts; an empty table gives a store
without documents; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from .common import Memo, arrow_fields, body, on_workers, slices

SAMPLE_DOCS = 512
SAMPLE_BYTES = 16384
DICTIONARY_BYTES = 65536
SHARD_DOCS = 64
SHARD_BYTES = 1 << 20
LEVEL = 3
MEMO = 600_000
SLICE = 2 << 20
LONG = 48
SEPARATOR = "\x01"
#: Letters: ASCII, Latin-1, Latin Extended-A and -B, but U+0130, whose lower case has a mark.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: ASCII punctuation but the apostrophe.
_PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Kinds of bytes; pieces are cut between two kinds where neither is _OTHER, and at each digit.
_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
#: First bytes of the two-byte letters of _LETTERS, and the code point after the last that they begin.
_LATIN, _LATIN_END = (0xC3, 0xC9), 0x280


class Encoder:
    """Texts to ids; the ids of a text as a numpy array."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        import numpy as np
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.np, self.tk = np, Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.special = tuple(t["content"].encode().lower() for t in spec["added_tokens"])
        self.width = 2 if self.tk.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        sep = self.ids(SEPARATOR)
        probe = self.ids(f"don't {SEPARATOR} 3é. {SEPARATOR} a")
        # words may be encoded apart only if white space never joins or changes tokens
        apart = self.ids("don't") + sep + self.ids("3é.") + sep + self.ids("a")
        self.by_word = len(sep) == 1 and probe == apart
        self.sep = sep[0] if sep else None
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.ends = np.zeros(max(self.tk.get_vocab(with_added_tokens=True).values()) + 1, bool)
        if suffix:
            for piece, i in self.tk.get_vocab(with_added_tokens=False).items():
                self.ends[i] = piece.endswith(suffix)
        # parts may be encoded apart only if letters, punctuation and digits are pre-tokens of their own
        parts = ["don", ",.", "1", "2", "é", ".", "3", "a"]
        self.by_part = self.by_word and bool(suffix) and self.ids("".join(parts)) == [i for p in parts for i in self.ids(p)]
        kinds = bytearray([_OTHER]) * 256
        for chars, kind in ((string.ascii_letters.encode(), _LETTER), (_PUNCTUATION, _MARK), (string.digits.encode(), _DIGIT)):
            for c in chars if self.by_part else b"":
                kinds[c] = kind
        for c in b" \t\n\x0b\x0c\r":
            kinds[c] = _SPACE
        self.kinds = bytes(kinds)
        self.latin = np.array([bool(_LETTERS.fullmatch(chr(c))) for c in range(_LATIN_END)])
        # begins[8 * kind before + kind]: a piece begins here
        self.begins = bytes(k != _SPACE and (b == _SPACE or _OTHER not in (b, k) and (b != k or k == _DIGIT))
                            for b in range(32) for k in range(8))
        # letters need no more of the vocabulary's normaliser and pre-tokeniser than a table, where these are made of such steps
        steps = lambda part: [s["type"] for s in (part or {}).get("normalizers") or (part or {}).get("pretokenizers") or ()]
        self.lean = self.table = None
        if steps(spec.get("normalizer")) == ["NFC", "Replace", "Lowercase"] and steps(spec.get("pre_tokenizer")) == ["Split", "ByteLevel"]:
            lean = Tokenizer.from_str(json.dumps(
                spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            letters = [chr(c) for c in range(_LATIN_END) if _LETTERS.fullmatch(chr(c))]
            level = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            table = {ord(c): level(c.lower())[0][0] for c in letters}
            if lean.encode(" ".join(letters).translate(table), add_special_tokens=False).ids == self.ids(" ".join(letters)):
                self.lean, self.table = lean, table
        self.memo = Memo(MEMO)

    def ids(self, text: str) -> list[int]:
        return self.tk.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return self.np.asarray(self.ids(text), self.dtype).tobytes()

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes the pieces, those of letters in longer calls."""
        plain, letters, other = [], [], []
        fullmatch = _LETTERS.fullmatch
        for w in pieces:
            if w.isascii():
                (plain if self.by_part and w.isalpha() else other).append(w)  # of bytes: ASCII letters
            else:
                (letters if self.by_part and fullmatch(w.decode()) else other).append(w)
        self.learn_apart(other + self.learn_letters(plain) + self.learn_letters(letters))

    def learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Encodes words of one pre-token each, many in one call; returns those of texts in which one had more."""
        np, step, left = self.np, 128, []
        for at in range(0, len(words), 32 * step):
            groups = [words[i:i + step] for i in range(at, min(at + 32 * step, len(words)), step)]
            texts = [b" ".join(g).decode() for g in groups]
            if self.lean is not None:
                texts = [t.lower() if t.isascii() else t.translate(self.table) for t in texts]
            for g, e in zip(groups, (self.lean or self.tk).encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.asarray(e.ids, np.int64)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(g) or len(ids) != cuts[-1]:
                    left += g
                    continue
                raw, to = ids.astype(self.dtype).tobytes(), (cuts * self.width).tolist()
                self.memo.update(zip(g, [raw[a:b] for a, b in zip([0, *to], to)]))
        return left

    def learn_apart(self, words: list[bytes]) -> None:
        """Encodes the words, some hundred in one call, with a separator between them."""
        np, step, join = self.np, 256, f" {SEPARATOR} ".encode()
        groups = [words[i:i + step] for i in range(0, len(words), step)]
        sent = self.tk.encode_batch_fast([join.join(g).decode() for g in groups], add_special_tokens=False)
        for g, e in zip(groups, sent):
            ids = np.asarray(e.ids, np.int64)
            cuts = np.flatnonzero(ids == self.sep)
            if len(cuts) != len(g) - 1:
                raise ValueError("the separator is not one token")
            raw, at = ids.astype(self.dtype).tobytes(), 0
            for w, cut in zip(g, [*cuts.tolist(), len(ids)]):
                self.memo[w] = raw[at * self.width:cut * self.width]
                at = cut + 1

    def cut(self, texts: list[bytes]):
        """The pieces of the texts in order (an Arrow array) and the number of pieces before each text and in all."""
        import pyarrow as pa

        np = self.np
        joined = b"\n".join([*texts, b""])
        data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(bytearray(joined.translate(self.kinds)), np.uint8)
        if self.by_part:
            first = np.flatnonzero((data >= _LATIN[0]) & (data <= _LATIN[1]))
            first = first[self.latin[(data[first] & 0x1F).astype(np.int64) << 6 | data[first + 1] & 0x3F]]
            kind[first] = kind[first + 1] = _LETTER
        before = np.empty_like(kind)
        before[0], before[1:] = _SPACE, kind[:-1] << 3
        begins = np.frombuffer((before | kind).tobytes().translate(self.begins), bool)
        starts = np.cumsum([0, *map(len, texts[:-1])]) + np.arange(len(texts))
        counts = np.add.reduceat(begins, starts, dtype=np.int64)
        shown = kind != _SPACE
        body = data[shown]
        offsets = np.append(np.flatnonzero(begins[shown]), len(body)).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(body)]
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers), np.append(0, np.cumsum(counts))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        at, cut = [], []
        for i, t in enumerate(texts):
            raw = t.encode()
            low = raw.lower()
            if not self.by_word or SEPARATOR in t or any(s in low for s in self.special):
                out[i] = self.whole(t)
            else:
                at.append(i)
                # U+0300 to U+036F start with these bytes
                cut.append(raw if b"\xcc" in raw or b"\xcd" in raw else low)
        if cut:
            for i, ids in zip(at, self.encode_cut(cut)):
                out[i] = ids
        return out

    def encode_cut(self, texts: list[bytes]) -> list[bytes]:
        import pyarrow as pa

        pieces, ends = self.cut(texts)
        if not len(pieces):
            return [b""] * len(texts)
        coded, memo = pieces.dictionary_encode(), self.memo
        _, offsets, raw = coded.dictionary.buffers()
        raw, to = raw.to_pybytes(), self.np.frombuffer(offsets, self.np.int64, len(coded.dictionary) + 1).tolist()
        words = [raw[a:b] for a, b in zip(to, to[1:])]
        found = list(map(memo.get, words))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        if len(memo) + len(gaps) > memo.limit:  # the pieces of this run stay: the frequent ones are among them
            memo.clear()
            memo.update((w, ids) for w, ids in zip(words, found) if ids is not None)
        self.learn([words[k] for k in gaps])
        for k in gaps:
            found[k] = memo[words[k]]
            if len(words[k]) > LONG:
                del memo[words[k]]
        got = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, ids = got.buffers()
        to = self.np.frombuffer(offsets, self.np.int64)[got.offset + ends].tolist()
        ids = memoryview(ids or b"")
        return [bytes(ids[a:b]) for a, b in zip(to, to[1:])]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[bytes, str]:
    """The dictionary's bytes and hash, fitted on the bounded sample."""
    import numpy as np
    import zstandard

    # ids are chosen first, so that no texts but the chosen ones meet in a task; an id may have many rows
    key = F.xxhash64(F.col("__id").cast("string"))
    chosen = docs.select("__id").orderBy(key, "__id").limit(SAMPLE_DOCS).distinct().withColumnRenamed("__id", "__chosen")
    sample = docs.join(chosen, F.col("__id").eqNullSafe(F.col("__chosen"))).groupBy("__id").agg(F.min("__text").alias("__text")).select(
        F.col("__text"))

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()
        for b in batches:
            got = [(x + end)[:SAMPLE_BYTES] for run in slices(b.column(0).to_pylist(), SLICE) for x in enc.encode(run)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["ids"])

    got = [bytes(r.ids) for r in on_workers(sample, run, "ids binary").collect()]
    try:
        raw = zstandard.train_dictionary(DICTIONARY_BYTES, got).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: a raw content dictionary
        raw = b"".join(got)[:DICTIONARY_BYTES]
    return raw, hashlib.sha256(raw).hexdigest()


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", level: int = LEVEL) -> None:
    """Encodes every document, appends ``end_id`` and writes the store."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), body(text_col).alias("__text"))
    raw, digest = train_dictionary(rows, tokenizer, end_id)
    width = encoder(tokenizer).width
    spark.range(1).select(F.lit(digest).alias("dict_hash"), F.lit(bytearray(raw)).alias("dictionary"),
                          F.lit(width).alias("width")).write.parquet(f"{root}/dictionary")
    schema = (f"part int, shard int, dict_hash string, first_id {id_type}, last_id {id_type}, base long, "
              f"tokens long, doc_ids array<{id_type}>, offsets array<int>, frames binary")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()
        zc = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_dict_id=False)
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        ids, frames, tokens, size = [], [], 0, 0

        def flush():
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            known = [x for x in ids if x is not None]
            row = [part, shard, digest, min(known, default=None), max(known, default=None), base, tokens,
                   ids, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow)], names=names)

        names, arrow = fields
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for key, x in zip(keys, (x for run in slices(texts, SLICE) for x in enc.encode(run))):
                x += end
                ids.append(key)
                frames.append(zc.compress(x))
                tokens += len(x) // enc.width
                size += len(frames[-1])
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield flush()
                    shard, base = shard + 1, base + tokens
                    ids, frames, tokens, size = [], [], 0, 0
        if ids:
            yield flush()

    fields = arrow_fields(schema)
    dealt = rows.repartitionByRange("__id").sortWithinPartitions("__id", "__text")
    on_workers(dealt, run, schema).write.option("compression", "uncompressed").parquet(f"{root}/shards")
    parts = spark.read.parquet(f"{root}/shards").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    # one row per write task
    before = F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")
    parts.select("part", before.alias("before")).write.parquet(f"{root}/parts")


def _dictionary(spark: SparkSession, root: str) -> dict[str, tuple[bytes, int]]:
    return {r.dict_hash: (bytes(r.dictionary), r.width) for r in spark.read.parquet(f"{root}/dictionary").collect()}


def _decoder(dicts):
    import zstandard

    made = {}

    def of(digest: str):
        if digest not in made:
            raw, width = dicts[digest]
            if hashlib.sha256(raw).hexdigest() != digest:
                raise ValueError("the dictionary does not match its hash")
            made[digest] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), width
        return made[digest]

    return of


def read_tokens(spark: SparkSession, root: str, id_col: str = "doc_id") -> DataFrame:
    """Every document from the files: id, start (tokens before it), n_tokens,
    ids (binary, little-endian unsigned 32-bit), ids_crc32."""
    dicts = _dictionary(spark, root)
    shards = spark.read.parquet(f"{root}/shards")
    id_type = shards.schema["first_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of = _decoder(dicts)
        for b in batches:
            for r in b.to_pylist():
                zd, width = of(r["dict_hash"])
                o, f = r["offsets"], r["frames"]
                ids = [np.frombuffer(zd.decompress(f[o[i]:o[i + 1]]), f"<u{width}").astype("<u4")
                       for i in range(len(o) - 1)]
                n = [len(x) for x in ids]
                start = (np.cumsum([0, *n[:-1]]) + r["base"]).tolist()
                raw = [x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(n), pa.int32()), pa.array(r["doc_ids"], id_arrow),
                     pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary()),
                     pa.array([zlib.crc32(x) for x in raw], pa.int64())],
                    names=["part", "id", "at", "n_tokens", "ids", "ids_crc32"])

    id_arrow = to_arrow_type(shards.schema["first_id"].dataType)
    docs = on_workers(shards.select("part", "dict_hash", "base", "doc_ids", "offsets", "frames"),
                      run, f"part int, id {id_type}, at long, n_tokens long, ids binary, ids_crc32 long")
    parts = spark.read.parquet(f"{root}/parts")  # one row per write task
    return docs.join(parts, "part").select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"),
                                           "n_tokens", "ids", "ids_crc32")


def read_document(spark: SparkSession, root: str, doc_id) -> list[list[int]]:
    """Ids of the documents with this id: one shard row, one slice each."""
    import numpy as np

    of = _decoder(_dictionary(spark, root))
    rows = spark.read.parquet(f"{root}/shards").filter(
        (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("dict_hash", "doc_ids", "offsets", "frames")
    out = []
    for r in rows.toLocalIterator():
        zd, width = of(r.dict_hash)
        out += [np.frombuffer(zd.decompress(bytes(r.frames[r.offsets[i]:r.offsets[i + 1]])), f"<u{width}").tolist()
                for i, k in enumerate(r.doc_ids) if k == doc_id]
    return out
