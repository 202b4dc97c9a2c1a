"""Periodic runs of words by maximal-pair enumeration.

A run is a stretch of words with smallest period q that no neighbour extends
and that is at least ``max(min_words, times * q)`` long. Two occurrences x < y
of the same words are a maximal pair of length L if neither the words before
nor the words after them agree. The run [s, s + l) of period q is the maximal
pair (s, s + q) of length l - q, and a maximal pair (x, x + p) whose length
satisfies L >= max(min_words - p, (times - 1) * p) covers exactly the run
[x, x + p + L): nothing has to be extended. Multiples of q give the same
stretch again; the smallest distance of a stretch is its period.

Pairs come from a bottom-up pass over the tree of LCP intervals of the
document's suffix array. A node of depth L holds the positions of its
words, ordered, each with the word on its left; when a child joins, the
positions of the smaller side look up those of the larger side within the
distance L // (times - 1). Occurrences so near to each other, under half of
their length, are one arithmetic progression, in which all but the first
have the same left word. So the list of a left-word class within reach is
one piece of the ordered positions: the first position before x and the
first one after x tell whether a whole list differs from x, only lists that
differ are walked, and the work beyond the joins (smaller into larger) is
the number of pairs found, which is linear in the text.

Intervals less deep than ``floor`` words (5 with the defaults: for
shorter ones no distance is allowed) give no pairs and are not built. Words
are numbered per document, so one suffix array, by prefix doubling over the
suffixes that are still tied, serves all documents of a slice of a batch.

Map only: no shuffle; a task holds one Arrow batch and the arrays of about a
million characters, or of one longer document. Null text is no words; null
and repeated ids keep one row per input row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, body, map_rows, slices

MIN_WORDS = 6
TIMES = 4
#: Longest piece of an ordered list of positions.
PIECE = 1024


class Ordered:
    """Ascending distinct numbers in pieces of bounded length, so that adding one moves few others."""

    __slots__ = ("pieces", "firsts", "size")

    def __init__(self, values: list[int]):
        self.pieces = [values[i:i + PIECE] for i in range(0, len(values), PIECE)]
        self.firsts = [p[0] for p in self.pieces]
        self.size = len(values)

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        for p in self.pieces:
            yield from p

    def since(self, x: int):
        """The numbers >= x, ascending."""
        k = max(0, bisect_right(self.firsts, x) - 1)
        at = bisect_left(self.pieces[k], x)
        for p in self.pieces[k:k + 1]:
            yield from p[at:] if at else p
        for k in range(k + 1, len(self.pieces)):
            yield from self.pieces[k]

    def first_since(self, x: int) -> int | None:
        k = max(0, bisect_right(self.firsts, x) - 1)
        p = self.pieces[k]
        at = bisect_left(p, x)
        if at < len(p):
            return p[at]
        return self.firsts[k + 1] if k + 1 < len(self.firsts) else None

    def add(self, x: int) -> None:
        k = max(0, bisect_right(self.firsts, x) - 1)
        p = self.pieces[k]
        insort(p, x)
        self.firsts[k] = p[0]
        self.size += 1
        if len(p) > 2 * PIECE:
            self.pieces[k:k + 1] = [p[:PIECE], p[PIECE:]]
            self.firsts[k:k + 1] = [p[0], p[PIECE]]


def join(one: Ordered, two: Ordered, depth: int, times: int, left, found) -> Ordered:
    """Both position sets as one; calls found(x, y, depth) for their maximal pairs within reach."""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    reach = depth // (times - 1)
    for x in small:
        before = large.first_since(x - reach)
        if before is None:
            continue
        if before < x:
            if left[before] != left[x]:
                found(before, x, depth)
            after = large.first_since(x)
        else:
            after = before
        if after is not None and after <= x + reach and left[after] != left[x]:
            for y in large.since(after):
                if y > x + reach:
                    break
                found(x, y, depth)
    if len(small) * 8 < len(large):
        for x in small:
            large.add(x)
        return large
    return Ordered(sorted([*small, *large]))


def maximal_pairs(suffixes: list[int], lcps: list[int], left, floor: int, times: int, found) -> None:
    """Bottom-up over the LCP intervals of at least ``floor`` words; lcps[i] belongs to suffixes i - 1 and i."""
    stack: list[list] = []  # open intervals: depth, positions so far
    for i, x in enumerate(suffixes):
        node = Ordered([x])
        depth = lcps[i + 1] if i + 1 < len(lcps) else 0
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            node = join(top[1], node, top[0], times, left, found)
        if stack and stack[-1][0] == depth:
            stack[-1][1] = join(stack[-1][1], node, depth, times, left, found)
        elif depth >= floor:
            stack.append([depth, node])


def repeated_suffixes(words, ends, floor: int):
    """(suffixes, lcps) of the suffixes that share their first ``floor`` words
    with another one, in suffix order; an lcp under ``floor`` is 0. ``words``:
    numbers that differ between documents; ends[i]: where i's document ends."""
    import numpy as np

    n = len(words)
    _, group, sizes = np.unique(words, return_inverse=True, return_counts=True)
    rank = np.append((np.cumsum(sizes) - sizes)[group] + 1, 0)  # one more than the number of smaller suffixes
    tied = np.flatnonzero(sizes[group] > 1)
    step, order = 1, np.argsort(rank[:n], kind="stable")
    while len(tied):
        nxt = np.where(tied + step < ends[tied], rank[np.minimum(tied + step, n)], 0)
        old = rank[tied]
        by = np.lexsort((nxt, old))
        old, nxt, at = old[by], nxt[by], tied[by]
        group = np.append(True, old[1:] != old[:-1])
        part = group | np.append(True, nxt[1:] != nxt[:-1])
        place = np.arange(len(at))
        base = place[group][np.cumsum(group) - 1]
        begin = place[part]
        new = old + begin[np.cumsum(part) - 1] - base
        rank[at] = new
        order[new - 1 + place - begin[np.cumsum(part) - 1]] = at
        alone = np.diff(np.append(begin, len(at))) == 1
        tied = at[~alone[np.cumsum(part) - 1]]
        step *= 2
    del rank, group
    # the lcp of neighbours, by position: it falls by at most one from a position to the next
    same = np.zeros(n, bool)
    a, b = order[:-1], order[1:]
    near = words[a] == words[b]
    for k in range(1, floor):
        ok = (a + k < ends[a]) & (b + k < ends[b])
        near &= ok & (words[np.minimum(a + k, n - 1)] == words[np.minimum(b + k, n - 1)])
    same[1:] = near
    kept = same | np.append(same[1:], False)
    before = np.full(n, -1, np.int64)
    before[order[1:][near]] = order[:-1][near]
    # only the words of repeated stretches are compared one by one
    lcp = np.zeros(n, np.int64)
    look, stop = words.tolist(), ends.tolist()
    had, last = 0, -2
    for x in np.flatnonzero(before >= 0).tolist():
        y = int(before[x])
        had = max(had - 1, floor) if x == last + 1 else floor
        room = min(stop[x] - x, stop[y] - y)
        while had < room and look[x + had] == look[y + had]:
            had += 1
        lcp[x], last = had, x
    chosen = order[kept]
    return chosen.tolist(), np.where(same[kept], lcp[chosen], 0).tolist()


class Runs:
    """The runs of one document: (start, length, period), by start, then period."""

    __slots__ = ("words", "runs")

    def __init__(self, words: list[bytes], runs: list[tuple[int, int, int]]):
        self.words, self.runs = words, sorted(runs, key=lambda r: (r[0], r[2]))

    def best(self) -> tuple[int, int, int] | None:
        """The run of greatest length / period; ties: smallest start, then period."""
        top = None
        for r in self.runs:
            if top is None or r[1] * top[2] > top[1] * r[2]:
                top = r
        return top

    def kept(self) -> list[bytes]:
        """The words that no run contains after its first period."""
        out, at = [], 0
        for a, b in sorted((s + q, s + n) for s, n, q in self.runs):
            if b > at:
                out += self.words[at:a] if a > at else []
                at = b
        return out + self.words[at:]

    def listed(self) -> str:
        return "".join(f"{s},{n},{q}\n" for s, n, q in self.runs)


def find_runs(texts: list[str], min_words: int = MIN_WORDS, times: int = TIMES) -> list[Runs]:
    """The runs of each text, found together."""
    import numpy as np

    if min_words < 2 or times < 3:
        raise ValueError("runs of less than two words or three periods are not looked for")
    # the least depth at which some distance is allowed
    floor = min(max(min_words - p, (times - 1) * p) for p in range(1, min_words + 1))
    docs = [t.encode().split() for t in texts]
    found: list[dict[tuple[int, int], int]] = [{} for _ in docs]
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), np.int64, int(sizes.sum()))
    del number
    if len(ids):
        of = np.repeat(np.arange(len(docs)), sizes)
        words = of * (int(ids.max()) + 1) + ids
        suffixes, lcps = repeated_suffixes(words, np.repeat(starts + sizes, sizes), floor)
        left = np.append(-1, ids[:-1])
        left[starts[sizes > 0]] = -1  # nothing stands before the first word
        left = left.tolist()

        def pair(x: int, y: int, depth: int) -> None:
            if depth < min_words - (y - x):
                return
            doc = int(of[x])
            key = x - int(starts[doc]), y - x + depth
            found[doc][key] = min(found[doc].get(key, depth), y - x)  # a distance is less than the depth

        maximal_pairs(suffixes, lcps, left, floor, times, pair)
    return [Runs(d, [(s, n, q) for (s, n), q in f.items()]) for d, f in zip(docs, found)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  times: int = TIMES) -> DataFrame:
    """Per row: id, runs (array of start, length, period by start, then
    period; start is a word number) and collapsed: the words outside of
    repetitions, joined by one space."""
    def make(ids, texts):
        got = [r for part in slices(texts) for r in find_runs(part, min_words, times)]
        return (ids, [[{"start": s, "length": n, "period": q} for s, n, q in r.runs] for r in got],
                [b" ".join(r.kept()).decode() for r in got])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), body(text_col)), make,
                    f"`{id_col}` {id_type}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                times: int = TIMES) -> DataFrame:
    """Per row: id, n_runs, the run of greatest exponent (start, length,
    period, exponent_milli; null without runs), runs_sha256, collapsed_sha256."""
    def make(ids, texts):
        got = [r for part in slices(texts) for r in find_runs(part, min_words, times)]
        best = [r.best() for r in got]
        one = lambda k: [b and b[k] for b in best]
        return (ids, [len(r.runs) for r in got], one(0), one(1), one(2), [b and 1000 * b[1] // b[2] for b in best],
                [hashlib.sha256(r.listed().encode()).hexdigest() for r in got],
                [hashlib.sha256(b" ".join(r.kept())).hexdigest() for r in got])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), body(text_col)), make,
                    f"`{id_col}` {id_type}, n_runs long, start long, length long, period long, exponent_milli long, "
                    "runs_sha256 string, collapsed_sha256 string")


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with planted runs: in the documents whose h = crc32(id as
    text) is divisible by 10, with n > 0 words and g = h div 10, every word
    from number a = g mod n on repeats the p = 1 + (n - a) div (3 + g mod 8)
    words that start there. A null id plants nothing."""
    words = F.regexp_extract_all("__t", F.lit(f"[^{WS_CLASS[1:-1]}]+"), F.lit(0))
    out = docs.select(F.col(id_col).alias("__id"), body(text_col).alias("__t"),
                      F.crc32(F.col(id_col).cast("string").cast("binary")).alias("__h"))
    out = out.withColumn("__w", F.when(F.col("__h") % 10 == 0, words)).withColumn("__n", F.size("__w").cast("long"))
    out = out.withColumn("__g", F.expr("__h DIV 10")).withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    out = out.withColumn("__p", F.expr("1 + (__n - __a) DIV (3 + __g % 8)"))
    planted = F.expr("array_join(transform(sequence(0L, __n - 1), "
                     "i -> element_at(__w, CAST(1 + IF(i < __a, i, __a + (i - __a) % __p) AS INT))), ' ')")
    text = F.when(F.col("__p").isNull(), F.col("__t")).otherwise(planted)
    return out.select(F.col("__id").alias(id_col), text.alias(text_col))
