"""Periodic runs against a search over all periods and starts."""

import hashlib
import random
import time
import zlib

import pytest

from concilia.llm import periodic

SCHEMA = "doc_id long, text string, start long, runs string"


def brute(w, min_words=6, times=4):
    """(start, length, period) of every run, by trying every period."""
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(min_words, times * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def digest(w):
    runs = brute(w)
    drop = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1] * 1.0 / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def _texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [f"w{rng.randrange(rng.choice([1, 2, 2, 3, 5]))}" for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and w:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.randint(3, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out


@pytest.mark.parametrize("min_words,times", [(6, 4), (2, 3), (9, 3), (12, 5)])
def test_runs_equal_a_search_of_all_periods(min_words, times):
    texts = _texts(1500, min_words)
    for t, got in zip(texts, periodic.find_runs(texts, min_words, times)):
        assert got.runs == brute(t.split(), min_words, times)


def test_long_runs_and_hubs_take_linear_time():
    n = 100_000
    hub = [x for i in range(n // 7) for x in (f"l{i}", "u", "v", "w", "x", "y", f"r{i}")]
    began = time.time()
    assert periodic.find_runs(["a " * n])[0].runs == [(0, n, 1)]
    assert periodic.find_runs(["a b c " * n])[0].runs == [(0, 3 * n, 3)]
    assert periodic.find_runs([" ".join(hub)])[0].runs == []
    assert time.time() - began < 60


def test_ordered_keeps_the_order():
    rng = random.Random(4)
    values = rng.sample(range(100_000), 9000)
    got = periodic.Ordered(values[:1])
    for v in values[1:]:
        got.add(v)
    want = sorted(values)
    assert list(got) == want and len(got) == len(want)
    for x in rng.sample(range(-5, 100_005), 500):
        later = [v for v in want if v >= x]
        assert got.first_since(x) == (later[0] if later else None) and list(got.since(x)) == later


def test_digests(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "one", "x " * 50, "é a " * 9, "a\x1cb " * 7 + "c", *_texts(200, 2),
             " ".join(f"w{rng.randrange(50)}" for _ in range(20_000))]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "y " * 7, 1, "x"), (7, "z " * 8, 1, "x"), (7, "z " * 8, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, periodic.run_digests(docs).collect()), key=str)
    assert got == sorted(((i, *digest([x.decode() for x in (t or "").encode().split()])) for i, t, *_ in rows), key=str)
    full = {r.doc_id: r for r in periodic.periodic_runs(docs.filter("doc_id = 4")).collect()}
    assert full[4].collapsed == "x" and [tuple(r) for r in full[4].runs] == [(0, 50, 1)]
    assert periodic.run_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planted_tails(spark):
    rows = [(i, t) for i, t in enumerate(_texts(300, 6))] + [(None, "a b"), (4000, None), (4001, "")]
    got = {r.doc_id: r.text for r in periodic.with_periodic_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for i, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
            changed += 1
        assert got[i].split() == w
    assert changed > 10
