"""Conversation repair against a search over all edit sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from concilia.llm import conv_repair as C
from concilia.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string, audit string, seg long"
FAULT = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows, state="Z", goals=("Z", "U")):
    """(cost, audit) of the least edit sequence, by trying them all; rows: (initial, kind)."""
    best = (10**9, "")

    def go(i, state, cost, audit, inserted):
        nonlocal best
        if (cost, audit) > best and cost >= best[0]:
            return
        if i == len(rows):
            if state in goals:
                best = min(best, (cost, audit))
        else:
            initial, kind = rows[i]
            go(i + 1, state, cost + 4, audit + "D", 0)
            if kind not in (C.BLANK, C.DUPLICATE):
                extra = 3 * (kind == C.TRUNCATED)
                step = {"u": "A", "a": "U"}
                if state == "Z" and initial == "s":
                    go(i + 1, "S", cost + extra, audit + "K", 0)
                for letter in "ua":
                    if C.NEXT[state] == letter:
                        go(i + 1, step[letter], cost + extra + 3 * (letter != initial), audit + ("K" if letter == initial else "R"), 0)
        if inserted < 3:
            go(i, "A" if C.NEXT[state] == "u" else "U", cost + 3, audit + "I", inserted + 1)

    go(0, state, 0, "", 0)
    return best


def test_alignment_equals_a_search_of_all_edits():
    rng = random.Random(3)
    for _ in range(250):
        rows = tuple((rng.choice("sua xua"[:7]).strip(), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 6)))
        got = C.transitions(rows)
        assert min(got[k] for k in (("Z", "Z"), ("Z", "U"))) == cheapest(rows)
        for a in C.NEXT:
            for b in C.NEXT:
                want = cheapest(rows, a, (b,))
                assert got.get((a, b), (10**9, "")) == want, (rows, a, b)


def expected(rows):
    """By conversation what the contract asks of (conv, turn, role, text) after damage."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        convs[c] += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for c, m in convs.items():
        m.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds = set(), []
        for _, r, x in m:
            said = x.rstrip(" \t\n\x0b\x0c\r")
            kinds.append(C.BLANK if not said else C.DUPLICATE if (r, x) in seen else C.FINE if said[-1] in ".!?" else C.TRUNCATED)
            seen.add((r, x))
        marks = [(r[:1], k) for (_, r, _), k in zip(m, kinds)]
        cost, audit = cheapest(marks)
        lines, state, left = [], "Z", iter(m)
        for e in audit:
            _, r, x = next(left) if e != "I" else (0, "", "")
            if e == "D":
                continue
            if state == "Z" and e == "K" and r[0] == "s":
                state = "S"
            else:
                r = r if e == "K" else C.NAMES[C.NEXT[state]]
                state = "A" if C.NEXT[state] == "u" else "U"
            lines.append(f"{r}:{x}")
        turns = {t for t, *_ in m if t is not None}
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in (1, 2, 3)),
                  sum(a[0] + b[0] not in C.LEGAL for a, b in zip(marks, marks[1:])), cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _conversations(n, seed):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        role = rng.choice(["user", "system", "user"])
        for t in range(rng.randint(1, 7)):
            text = rng.choice(["Yes.", "What? ", "no end", f"t{rng.random()}.", "", " \n", None, f"x{rng.random()}"])
            out.append((c, rng.choice([t, t, t, t, None, t + 3, 0]), rng.choice([role] * 8 + ["", None, "tool", "system"]), text))
            role = "assistant" if role == "user" else "user"
    gone = next(c for c in range(n, 10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return out + [(gone, 0, "user", "Hi."), (None, 0, "user", "A null conversation."), (None, 1, "assistant", "It is one."), (None, None, None, None)]


@pytest.mark.parametrize("size", [64, 2, 3])
def test_repair(spark, size):
    rows = _conversations(150, size)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = C.repair(C.damaged(docs), size).collect()
    want = expected(rows)
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    gone = [r for r in got if r.repaired_sha256 == hashlib.sha256(b"").hexdigest() and r.audit == ""]
    assert gone and all(tuple(r)[1:7] == (0,) * 6 for r in gone)


def test_a_conversation_over_many_segments_and_tasks(spark):
    """A third of all rows in one conversation: the segments are dealt to several tasks and folded."""
    rng = random.Random(7)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"{rng.randrange(900)}{rng.choice(['.', '.', ''])}") for t in range(1000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", "Well.") for c in range(10, 300) for t in range(6)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = stored(C.segments(C._marked(C.intact(docs)), 16), "test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.filter("conv = 5").select(F.shiftright("seg", 40)).distinct().count() > 1
    small = {r.conv_id: r for r in C.repair(C.intact(docs), 16).collect()}
    large = {r.conv_id: r for r in C.repair(C.intact(docs), 250).collect()}
    assert small == large and small[5].duplicate > 100 and small[10].duplicate == 4
    turns = C.repaired_turns(C.intact(docs), 16).filter("conv = 5").collect()
    lines = "\n".join(f"{r.role}:{r.text}" for r in sorted(turns, key=lambda r: (r.seg, r.at)))
    assert hashlib.sha256(lines.encode()).hexdigest() == small[5].repaired_sha256
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in sorted(turns, key=lambda r: (r.seg, r.at))))


def test_equal_rows_are_counted_before_they_are_dealt(spark):
    docs = spark.range(5000).selectExpr("1L AS conv_id", "CAST(NULL AS LONG) AS turn", "'user' AS role", "'Hi.' AS text")
    got = C.repair(C.intact(docs)).collect()
    assert [(r.duplicate, r.cost, r.gaps) for r in got] == [(4999, 4 * 4999 + 3, 0)]
    assert got[0].audit == "K" + "D" * 4999 + "I"


def test_empty_table(spark):
    assert C.repair(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
