"""Token counts of whole texts by a sentencepiece BPE model, with overlap
resynchronisation for huge documents.

A position of a text is *proven stable* when the two characters around it
(space written as the model's U+2581) are adjacent in no piece of the
vocabulary. A BPE merge joins neighbours into a vocabulary piece, so no
merge can ever cross such a position: the pieces on both sides are those of
the whole text, whatever else the text holds.

* A text longer than ``chunk`` code points is encoded in chunks that
  overlap, with offsets. Neighbouring chunks are spliced at a boundary that
  both encodings have inside the overlap and that is proven stable. If
  there is none, the overlap doubles, up to joining both chunks; a chunk
  that was joined takes as much again next time, so a text without any
  stable boundary is encoded in linear time, too.
* A shorter text is cut before its spaces, when the vocabulary proves all
  positions between a non-space and a space stable (checked once per
  model), and each distinct segment is encoded by the library once per
  worker. With any other vocabulary, or if the text itself holds U+2581
  (which is a space to the model), it is encoded whole.

No special tokens are added; null text is empty (0 tokens); null and
repeated ids keep one row per input row; an empty table gives no rows; other
columns are ignored. Map
only: no shuffle, one Arrow batch in memory, one memo of bounded size.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, body, map_rows, slices

MARK = "▁"
CHUNK = 16384
OVERLAP = 512
MEMO = 1_000_000
#: Longer segments are encoded, but not remembered.
LONG = 64

_SEGMENT = re.compile(r" +[^ ]+| +$")


class Counter:
    """Token counts by one model file."""

    def __init__(self, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        normal = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())
                  if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.adjacent = {p[i:i + 2] for p in normal for i in range(len(p) - 1)}
        self.spaces_are_stable = not any(b[1] == MARK and b[0] != MARK for b in self.adjacent)
        self.last_space = len(self.sp.encode("a ")) - len(self.sp.encode("a"))
        self.memo = Memo(MEMO)
        self.widened = 0

    def stable(self, text: str, p: int) -> bool:
        """No merge can cross the position before text[p]."""
        return text[p - 1:p + 1].replace(" ", MARK) not in self.adjacent

    def starts(self, text: str, at: int, to: int) -> list[int]:
        """Where the pieces of text[at:to] start, in the whole text's code points; one entry per piece."""
        return [at + b for b, _ in self.sp.encode(text[at:to], out_type="offset_mapping")["offsets"]]

    def spliced(self, text: str) -> int:
        total, at, to = 0, 0, min(len(text), self.chunk)
        have, cut = self.starts(text, 0, to), 0  # pieces of the current chunk; counted from cut on
        while to < len(text):
            after, overlap = min(len(text), to + self.chunk), self.overlap
            while True:
                begin = max(at, to - overlap)
                if begin == at:  # widened over the whole chunk before: one larger chunk
                    to = min(len(text), max(after, at + 2 * (to - at)))
                    have = self.starts(text, at, to)
                    break
                new = self.starts(text, begin, after)
                common = sorted({p for p in have if max(begin, cut) < p < to}.intersection(new),
                                key=lambda p: abs(2 * p - begin - to))
                p = next((p for p in common if self.stable(text, p)), None)
                if p is not None:
                    total += sum(cut <= s < p for s in have)
                    have, at, to, cut = new, begin, after, p
                    break
                overlap *= 2
                self.widened += 1
        return total + sum(s >= cut for s in have)

    def counts(self, texts: list[str]) -> list[int]:
        out: list = [None] * len(texts)
        cut: dict[int, list[str]] = {}
        whole: list[int] = []
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.spliced(t)
            elif not self.spaces_are_stable or MARK in t:
                whole.append(i)
            elif t:
                # the library puts one space before what it encodes, as it does before the text
                if "  " not in t and t[0] != " " and t[-1] != " ":
                    cut[i] = t.split(" ")
                else:
                    cut[i] = [s[1:] or None for s in _SEGMENT.findall(" " + t)]  # None: a last space alone
            else:
                out[i] = 0
        for i, ids in zip(whole, self.sp.encode([texts[i] for i in whole], num_threads=1)):
            out[i] = len(ids)
        memo = self.memo
        new = {s for segments in cut.values() for s in segments if s not in memo}
        memo.room(len(new))
        if not memo:  # it was full and forgot all
            new = {s for segments in cut.values() for s in segments}
        memo[None] = self.last_space
        new = list(new - {None})
        fresh = {s: len(ids) for s, ids in zip(new, self.sp.encode(new, num_threads=1))}
        memo.update(fresh)
        get = memo.__getitem__
        for i, segments in cut.items():
            out[i] = sum(map(get, segments))
        for s in fresh:
            if len(s) > LONG:
                del memo[s]
        return out


@lru_cache(maxsize=4)
def counter(model_path: str, chunk: int, overlap: int) -> Counter:
    return Counter(model_path, chunk, overlap)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make(ids, sizes, texts):
        c = counter(model_path, chunk, overlap)
        return ids, sizes, [n for run in slices(texts) for n in c.counts(run)]

    rows = docs.select(F.col(id_col), F.octet_length(body(text_col)).cast("long"), body(text_col))
    out = map_rows(rows, make, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
