"""Conversation structure repair by Wagner-Fischer alignment to a target grammar.

The roles of a repaired conversation, by their initials, are ``(s?(ua)+)?``:
nothing, or an optional system turn and then user and assistant in turns.
Every edit of a row has a letter and a cost: K keep 0, R give it the role
user or assistant 3, D delete 4, I insert an empty user or assistant turn 3.
Blank and duplicate rows must be deleted; a truncated row that stays costs 3
more. Of the cheapest repairs the one whose letters are least in ASCII order
is the ``audit``.

**Alignment.** The grammar's strings are one alternating string, cut to every
feasible length, so the tables of all lengths are columns of one table of
suffixes: cost[i][j] aligns the rows from i on with the last j letters. Only
cells are filled that Ukkonen's bound allows: the fixed cost of the rows
before, plus what the difference between rows and letters left costs at
least, must not exceed the incumbent (all rows that may stay aligned one by
one). For every length of least cost an audit is traced through the table, by
the least letter that keeps the cost; the least of these audits wins.
Two repairs of the same rows and cost never have audits of which one begins
with the other, so least pieces make a least whole.

**Hot conversations.** Rows are dealt by ranges of (conversation, turn, role,
text) and a conversation is cut into segments of at most ``SEGMENT`` rows. A
segment is aligned on its own for every pair of states of the grammar (Z
nothing yet, S after s, A after u, U after a) before and behind it, and a
conversation's segments are folded over these states in order. So no task
holds a conversation's texts, and the table of a segment has bounded size. A
conversation that surely is one segment is finished where it is found. Equal rows are counted before they are dealt, and duplicates are found by an
aggregate, not by a set in one task. The digest of a conversation reads its
repaired segments one after another.

Defined cases: rows are ordered by turn (null first), role and text; a null
role or text is one space; a null conv_id is one conversation; a role whose
initial is not s, u or a cannot be kept; a conversation none of whose rows is
left has zeros, an empty audit and the digest of an empty string; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, arrow_fields, on_workers, stored

KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
SEGMENT = 64
FAR = 1 << 40
OTHER = {"u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
#: Row kinds, by first fault.
FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: The letter that comes next in each state; Z may also take s.
NEXT = {"Z": "u", "S": "u", "U": "u", "A": "a"}


class Aligned:
    """The rows (initial, kind) of a segment against all alternating strings that end with ``last``."""

    def __init__(self, rows: tuple[tuple[str, int], ...], last: str):
        n = len(rows)
        self.rows, self.last, self.n = rows, last, n
        # from row i on: fixed cost, rows that may stay, truncated ones of them
        self.fixed, self.free, self.cut = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            kind = rows[i][1]
            gone = kind in (BLANK, DUPLICATE)
            self.fixed[i] = self.fixed[i + 1] + (DELETE if gone else CUT_OFF * (kind == TRUNCATED))
            self.free[i] = self.free[i + 1] + (not gone)
            self.cut[i] = self.cut[i + 1] + (kind == TRUNCATED)
        self.limit = max(self.one_by_one("u"), self.one_by_one("a"))
        self.cost = self.table()

    def letter(self, left: int) -> str:
        """The letter that is followed by left - 1 others."""
        return self.last if left % 2 else OTHER[self.last]

    def one_by_one(self, first: str) -> int:
        """Cost of aligning the rows that may stay one by one from ``first`` on, and inserting what then is missing."""
        want, cost, m = first, self.fixed[0], 0
        for initial, kind in self.rows:
            if kind not in (BLANK, DUPLICATE):
                cost += RENAME * (initial != want)
                want, m = OTHER[want], m + 1
        while not m or OTHER[want] != self.last:
            cost, want, m = cost + INSERT, OTHER[want], m + 1
        return cost

    def at_least(self, i: int, left: int) -> int:
        """No alignment of the rows from i on with ``left`` letters costs less."""
        more = self.free[i] - left
        if more <= 0:
            return self.fixed[i] - INSERT * more
        cheap = min(more, self.cut[i])  # deleting a truncated row saves its surcharge
        return self.fixed[i] + (DELETE - CUT_OFF) * cheap + DELETE * (more - cheap)

    def table(self) -> list[dict[int, int]]:
        """cost[i][j] for the cells within the band of the incumbent; others are missing."""
        cost: list[dict[int, int]] = [{} for _ in range(self.n + 1)]
        for i in range(self.n, -1, -1):
            here, below = cost[i], cost[i + 1] if i < self.n else {}
            room = self.limit - (self.fixed[0] - self.fixed[i])
            low = high = self.free[i]
            while low > 0 and self.at_least(i, low - 1) <= room:
                low -= 1
            while self.at_least(i, high + 1) <= room:
                high += 1
            if i < self.n:
                initial, kind = self.rows[i]
                gone, extra = kind in (BLANK, DUPLICATE), CUT_OFF * (kind == TRUNCATED)
            for j in range(low, high + 1):
                best = 0 if i == self.n and j == 0 else FAR
                if i < self.n:
                    best = min(best, below.get(j, FAR) + DELETE)
                    if j and not gone:
                        best = min(best, below.get(j - 1, FAR) + extra + (KEEP if initial == self.letter(j) else RENAME))
                if j:
                    best = min(best, here.get(j - 1, FAR) + INSERT)
                here[j] = best
        return cost

    def trace(self, i: int, j: int) -> str:
        """The least audit among the cheapest alignments of the rows from i on with j letters."""
        out = []
        while i < self.n or j:
            now = self.cost[i][j]
            if i < self.n and self.cost[i + 1].get(j, FAR) + DELETE == now:
                out.append("D")
                i += 1
            elif j and self.cost[i].get(j - 1, FAR) + INSERT == now:
                out.append("I")
                j -= 1
            else:
                out.append("K" if self.rows[i][0] == self.letter(j) else "R")
                i, j = i + 1, j - 1
        return "".join(out)

    def best(self, first: str) -> tuple[int, str]:
        """Cheapest and then least over all lengths from ``first`` to ``last``."""
        lengths = [j for j in self.cost[0] if j and self.letter(j) == first]
        least = min(self.cost[0][j] for j in lengths)
        return least, min(self.trace(0, j) for j in lengths if self.cost[0][j] == least)

    def best_with_system(self) -> tuple[int, str] | None:
        """The same for s and then an alternating string from u: the rows before the kept s are deleted."""
        found = {}
        for i, (initial, kind) in enumerate(self.rows):
            if initial == "s" and kind not in (BLANK, DUPLICATE):
                for j, rest in self.cost[i + 1].items():
                    if j and self.letter(j) == "u" and rest < FAR:
                        found[i, j] = DELETE * i + CUT_OFF * (kind == TRUNCATED) + rest
        if not found:
            return None
        least = min(found.values())
        return least, min("D" * i + "K" + self.trace(i + 1, j) for (i, j), c in found.items() if c == least)


@lru_cache(maxsize=5_000)
def transitions(rows: tuple[tuple[str, int], ...]) -> dict[tuple[str, str], tuple[int, str]]:
    """(cost, audit) of a segment for every pair of states before and behind it that it can link."""
    none = DELETE * len(rows), "D" * len(rows)
    out = {(s, s): none for s in NEXT}
    alone = [(DELETE * (len(rows) - 1) + CUT_OFF * (kind == TRUNCATED), "D" * i + "K" + "D" * (len(rows) - 1 - i))
             for i, (initial, kind) in enumerate(rows) if initial == "s" and kind not in (BLANK, DUPLICATE)]
    if alone:
        out["Z", "S"] = min(alone)
    for last, end in (("u", "A"), ("a", "U")):
        t = Aligned(rows, last)
        plain = t.best("u")
        out["Z", end] = min(filter(None, (plain, t.best_with_system())))
        for s, first in (("S", "u"), ("U", "u"), ("A", "a")):
            got = plain if first == "u" else t.best(first)
            out[s, end] = min(out.get((s, end), got), got)
    return out


def repaired_rows(rows: list[tuple[str, str]], audit: str, state: str):
    """(role, text) of what the audit makes of the rows (role, text); state: before the first of them."""
    i = 0
    for edit in audit:
        if edit == "I":
            yield NAMES[NEXT[state]], ""
        else:
            role, text = rows[i]
            i += 1
            if edit == "D":
                continue
            if edit == "K" and state == "Z" and role[:1] == "s":
                yield role, text
                state = "S"
                continue
            yield (role if edit == "K" else NAMES[NEXT[state]]), text
        state = "U" if NEXT[state] == "a" else "A"


def _said(c: str) -> Column:
    """A column as text; null is one space."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, n) with planted damage by k = crc32 of
    ``conv:turn`` mod 20: 0 takes the row away (n = 0), 1 empties its text, 2
    takes its ``.!?`` away, 3 puts it in twice (n = 2), 4 makes it a user's."""
    k = F.crc32(F.concat(_said(conv_col), F.lit(":"), _said(turn_col)).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(_said(text_col), "[.!?]", "")).otherwise(_said(text_col))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(k == 4, "user").otherwise(_said(role_col)).alias("role"),
                       text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("n"))


def intact(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, n) of the rows as they are."""
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), _said(role_col).alias("role"),
                       _said(text_col).alias("text"), F.lit(1).cast("long").alias("n"))


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number n, and whether role and text were said at an earlier turn."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn(
        "said", F.md5(F.concat_ws("\0", F.length("role").cast("string"), "role", "text").cast("binary")))
    # null sorts first: the earliest turn, and whether one of the rows has none
    first = rows.filter("n > 0").groupBy(F.col("conv").alias("conv2"), F.col("said").alias("said2")).agg(
        F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("at_null"))
    seen = F.col("turn").isNotNull() & (F.coalesce("at_null", F.lit(False)) | (F.col("turn") > F.col("first")))
    return rows.join(first, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("said") == F.col("said2")), "left").select(
        "conv", "turn", "role", "text", "n", F.coalesce(seen, F.lit(False)).alias("again"))


_STATS = "gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string"
_FIELDS = ("seg bigint, first_turn {turn}, last_turn {turn}, n_turns bigint, first_role string, last_role string, n_rows bigint, "
           "blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
           "steps array<struct<before:string,behind:string,cost:bigint,audit:string>>, lines array<struct<role:string,text:string>>")
LEGAL = {"su", "ua", "au"}


def _segment(conv, seg: int, rows: list[tuple]) -> dict:
    """What holds for the rows (turn, role, text, kind) of one segment."""
    kinds, initials = [r[3] for r in rows], [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return {"conv": conv, "seg": seg, "first_turn": min(turns, default=None), "last_turn": max(turns, default=None),
            "n_turns": len(set(turns)), "first_role": initials[0] if rows else None, "last_role": initials[-1] if rows else None,
            "n_rows": len(rows), "blank": kinds.count(BLANK), "duplicate": kinds.count(DUPLICATE), "truncated": kinds.count(TRUNCATED),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "steps": [{"before": a, "behind": b, "cost": c, "audit": s}
                      for (a, b), (c, s) in transitions(tuple(zip(initials, kinds))).items()],
            "lines": [{"role": r[1], "text": r[2]} for r in rows]}


def _folded(segs: list[dict]) -> tuple[dict, list[tuple[str, str]]]:
    """What holds for a conversation of these segments; the state before each segment and its part of the audit."""
    best: dict = {"Z": (0, "", None)}  # by state: cost, audit, and the parts as a linked list
    total = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
    lo = hi = role = None
    n_turns = 0
    for s in segs:
        after: dict = {}
        for t in s["steps"]:
            if t["before"] in best:
                cost, audit, way = best[t["before"]]
                new = cost + t["cost"], audit + t["audit"]
                if t["behind"] not in after or new < after[t["behind"]][:2]:
                    after[t["behind"]] = *new, (t["before"], t["audit"], way)
        best = after
        for k in ("blank", "duplicate", "truncated", "illegal"):
            total[k] += s[k]
        if s["n_rows"]:
            total["illegal"] += role is not None and role + s["first_role"] not in LEGAL
            role = s["last_role"]
        if s["n_turns"]:
            n_turns += s["n_turns"] - (hi == s["first_turn"])
            lo, hi = s["first_turn"] if lo is None else lo, s["last_turn"]
    if n_turns:
        total["gaps"] = hi - lo + 1 - n_turns
    total["cost"], total["audit"], way = min(best[s] for s in ("Z", "U") if s in best)
    parts = []
    while way:
        parts.append(way[:2])
        way = way[2]
    return total, parts[::-1]


class Digest:
    """SHA-256 of the repaired lines of segments that come one after another."""

    def __init__(self):
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, lines: list[dict], audit: str, state: str) -> "Digest":
        for role, text in repaired_rows([(x["role"], x["text"]) for x in lines], audit, state):
            self.sha.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
            self.lines += 1
        return self

    def hex(self) -> str:
        return self.sha.hexdigest()


def segments(rows: DataFrame, size: int = SEGMENT, finish: bool = False) -> DataFrame:
    """Segments of at most ``size`` rows, numbered in the order of
    conversations and rows: counts, what their borders need, the alignment
    for every pair of states, and the rows. With ``finish``, a conversation
    that is one segment and neither the first nor the last of its task, where
    it could go on, comes with its ``result`` and without steps and rows."""
    conv, turn = rows.schema["conv"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    schema = f"conv {conv}, {_FIELDS.format(turn=turn)}, result struct<{_STATS},repaired_sha256:string>"
    names, types = arrow_fields(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, done, bulk, begun = TaskContext.get().partitionId() << 40, 0, 0, 0
        here, ready, old = [], [], None  # begun: segments done when the conversation began; old: (conversation,)

        def close(complete: bool) -> None:
            nonlocal done, bulk
            s = _segment(old[0], part + done, here) | {"result": None}
            if complete and finish:
                total, [(state, audit)] = _folded([s])
                s["result"] = total | {"repaired_sha256": Digest().add(s["lines"], audit, state).hex()}
                s["steps"] = s["lines"] = None
            else:
                bulk += sum(len(r[2]) for r in here)
            ready.append(s)
            done += 1
            here.clear()

        def flush():
            nonlocal bulk
            out = pa.RecordBatch.from_arrays([pa.array([s[n] for s in ready], t) for n, t in zip(names, types)], names=names)
            ready.clear()
            bulk = 0
            return out

        for b in batches:
            for conv, turn, role, text, n, again in zip(*(c.to_pylist() for c in b.columns)):
                if old != (conv,):
                    if old is not None:
                        close(0 < begun == done)
                    old, begun = (conv,), done
                solid = text.rstrip(WS)
                kind = BLANK if not solid else DUPLICATE if again else FINE if solid[-1] in ".!?" else TRUNCATED
                for copy in range(n):
                    if len(here) == size:
                        close(False)
                    if len(ready) >= 512 or bulk >= 1 << 22:
                        yield flush()
                    here.append((turn, role, text, kind if not copy or kind == BLANK else DUPLICATE))
        if old is not None:
            close(False)
            yield flush()

    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return on_workers(dealt.select("conv", "turn", "role", "text", "n", "again"), run, schema)


_CHOSEN = f"seg bigint, state string, audit string, whole struct<{_STATS}>"


def _fold(found: DataFrame) -> DataFrame:
    """For every segment the state before it and its part of the audit; the first of a conversation also has what holds for it as a whole."""
    names, types = arrow_fields(_CHOSEN)

    def run(batches):
        import pyarrow as pa

        ready, segs = [], []

        def close():
            total, parts = _folded(segs)
            ready.extend([s["seg"], *part, None if k else total] for k, (s, part) in enumerate(zip(segs, parts)))
            segs.clear()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*ready), types)], names=names)
            ready.clear()
            return out

        for b in batches:
            for s in b.to_pylist():
                if segs and segs[0]["conv"] != s["conv"]:
                    close()
                    if len(ready) >= 4096:
                        yield flush()
                segs.append(s)
        if segs:
            close()
            yield flush()

    narrow = found.drop("lines", "result").repartition("conv").sortWithinPartitions("conv", "seg")
    return on_workers(narrow, run, _CHOSEN)


def _chosen(found: DataFrame) -> DataFrame:
    """(conv, seg, state, audit, whole, lines): what was chosen for every segment, beside its rows."""
    chosen = _fold(found).withColumnRenamed("seg", "seg2")
    return found.select("conv", "seg", "lines").join(chosen, F.col("seg") == F.col("seg2")).drop("seg2")


def repaired_turns(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv, seg, at, role, text): the turns of the repaired conversations; read by (seg, at)."""
    parts = _chosen(stored(segments(_marked(rows), size), "segments"))
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, seg bigint, at bigint, role string, text string"
    names, types = arrow_fields(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [(r["conv"], r["seg"], k, *turn) for r in b.to_pylist() for k, turn in enumerate(
                repaired_rows([(x["role"], x["text"]) for x in r["lines"]], r["audit"], r["state"]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)

    return on_workers(parts.select("conv", "seg", "state", "audit", "lines"), run, schema)


def repair(rows: DataFrame, size: int = SEGMENT, id_name: str = "conv_id") -> DataFrame:
    """Per conversation of ``intact`` or ``damaged`` rows: gaps in the turns,
    rows by first fault, illegal neighbours, cost, audit, and the SHA-256 of
    the repaired ``role:text`` lines."""
    schema = f"`{id_name}` {rows.schema['conv'].dataType.simpleString()}, {_STATS.replace(':', ' ')}, repaired_sha256 string"
    names, types = arrow_fields(schema)

    def run(batches):
        import pyarrow as pa

        old, digest, whole, ready = None, None, None, []
        for b in batches:
            for r in b.to_pylist():
                if old != (r["conv"],):
                    if old is not None:
                        ready.append([old[0], *whole, digest.hex()])
                    old, digest, whole = (r["conv"],), Digest(), r["whole"].values()
                digest.add(r["lines"], r["audit"], r["state"])
            if len(ready) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*ready), types)], names=names)
                ready = []
        if old is not None:
            ready.append([old[0], *whole, digest.hex()])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*ready), types)], names=names)

    found = stored(segments(_marked(rows), size, finish=True), "segments")
    parts = _chosen(found.filter("result IS NULL")).repartition("conv").sortWithinPartitions("conv", "seg")
    cut = on_workers(parts.select("conv", "state", "audit", "whole", "lines"), run, schema)
    return found.filter("result IS NOT NULL").select(F.col("conv").alias(id_name), "result.*").unionByName(cut)
