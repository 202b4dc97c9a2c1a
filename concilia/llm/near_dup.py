"""Near-duplicates by a chosen-path set similarity join.

A text is the set of its distinct word shingles (A-Z lower-cased); two
texts are linked when 100 * |intersection| >= percent * |union|, checked
on the full sets. The result is the connected components of the links.

1. **Sets.** Each text's shingles become 64-bit hashes; the set gets 256
   minwise tokens of 16 bits (its sketch) and a 128-bit hash. Texts with
   equal sets form one *node*, found by a map-side combined aggregate, so
   thousands of copies cost one row per task.
2. **Trees.** In each of a number of independent trees a node follows a
   path of chosen minwise tokens: first BASE of them, enough to part texts
   that merely share a phrase. Nodes that share a path form a bucket. Two
   linked nodes share a tree's path with probability s**BASE and stay
   together below it as in 4; ``RECALL`` of a pair at the very threshold,
   with trees taken as independent, fixes the number of trees.
3. **Contraction.** Each node's most similar bucket minimum (by sketch) is
   checked on the full sets; confirmed links are contracted. A group of
   near copies of any size costs one check per member, not one per pair,
   and buckets whose nodes all hang together are done.
4. **Recursion.** A bucket that still holds several components and more
   than BRANCH nodes branches on the next tokens that its path selects: ROOTS
   of them at the base, below it one (more if s is small), and a further one for so many paths
   that a linked pair stays together on GROWTH > 1 branches on average. So
   it survives to any depth with a probability that ``number_of_trees``
   counts in, and only rows that branch pay for it. Buckets of LEAF to BRANCH
   nodes, and what is still larger DEPTH levels down, are compared chunk by
   chunk: every pair of chunks is a leaf.
5. **Leaves.** Buckets of at most LEAF nodes are compared exhaustively, by
   sketch first (a pair at the threshold passes with probability over
   0.9999), pairs within one component left out; nodes of passing pairs
   meet again with their full sets, and every passing pair that is not
   yet connected inside the leaf is checked exactly. Only confirmed links
   leave a leaf, at most one less than its nodes, never its pairs.

Joins that carry hot keys start from written tables, so AQE splits them.
Components are found by hooking and pointer jumping on written tables of
links; nothing is collected.

Defined cases: null, empty or blank texts have no shingles and link with
nothing; texts with fewer words than a shingle are one shingle; rows that
repeat keep one result row each, and rows that share an id but not the
text belong to that id's smallest component; null ids are allowed;
other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fields, body, free_name, on_workers, stored, with_row_key

WIDTH = 256
BASE = 3
LEAF = 1024
BRANCH = 8 * LEAF
DEPTH = 24
#: Branches at the base, and the mean number of branches below it that keep a pair at the threshold together.
ROOTS = 10
GROWTH = 1.1
RECALL = 0.99999
#: Standard deviations of the sketch estimate that a pair may lie below the threshold.
SLACK = 4.0
#: Words whose hashes a task remembers; none outlive it.
MEMO = 500_000
_MIX = 0x9E3779B97F4A7C15


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word):
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingles(text: str, size: int):
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    import numpy as np

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    code = np.full(n, size, np.uint64)
    for k in range(size):
        code = (code ^ h[k:k + n]) * np.uint64(_MIX)
        code ^= code >> np.uint64(29)
    code.sort()
    return code[np.concatenate(([True], code[1:] != code[:-1]))] if n > 1 else code


def _multipliers():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(20240501))
    return (rng.integers(0, 1 << 32, WIDTH, np.uint32) | np.uint32(1))[:, None], rng.integers(
        0, 1 << 32, WIDTH, np.uint32)[:, None]


def sketch(codes, multipliers) -> bytes:
    """WIDTH minwise tokens, 16 bits each."""
    import numpy as np

    a, b = multipliers
    x = (codes >> np.uint64(32)).astype(np.uint32)
    least = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, ((x[None, i:i + 4096] ^ b) * a).min(axis=1), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16).tobytes()


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(row, id, n, h: hash of the set, sig: sketch) per row of (__row, __id, __text)."""
    row_type, id_type = (docs.schema[c].dataType.simpleString() for c in ("__row", "__id"))
    schema = f"row {row_type}, id {id_type}, n long, h binary, sig binary"
    names, types = arrow_fields(schema)

    def run(batches):
        import pyarrow as pa

        m = _multipliers()
        for b in batches:
            n, h, sig = [], [], []
            for t in b.column(2).to_pylist():
                codes = shingles(t, size)
                n.append(len(codes))
                h.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest())
                sig.append(sketch(codes, m) if len(codes) else None)
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(types[i]) for i in range(2)], *[pa.array(v, t) for v, t in zip(
                (n, h, sig), types[2:])]], names=names)
        _words.clear()

    return on_workers(docs.select("__row", "__id", "__text"), run, schema)


def _branches(percent: int) -> tuple[int, float]:
    """Tokens that every path follows, and the share of paths that follow one more."""
    n = GROWTH * 100 / percent
    return int(n), n - int(n)


def survival(percent: int) -> float:
    """Least probability, at any depth, that a pair at the threshold which
    shares a base path still shares a bucket."""
    s, (every, some), p = percent / 100, _branches(percent), 1.0
    for _ in range(1000):  # one path below the base, level by level
        p = 1 - (1 - s * p) ** every * (1 - some * s * p)
    return 1 - (1 - s * p) ** ROOTS


def number_of_trees(percent: int) -> int:
    found = (percent / 100) ** BASE * survival(percent)
    return 1 if found >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - found))


def _paths(nodes: DataFrame, trees: int) -> DataFrame:
    """(key, node): each node's bucket at the base of every tree."""
    names, types = arrow_fields("key long, node long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.Generator(np.random.PCG64(7))
        chosen = [rng.permutation(WIDTH)[:BASE] for _ in range(trees)]
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, WIDTH).astype(np.uint64)
            node = b.column(0).to_numpy()
            for t, coords in enumerate(chosen):
                key = np.full(len(node), t + 1, np.uint64)
                for c in coords:
                    key = _step(key, sig[:, c])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], names=names)

    return on_workers(nodes.select("node", "sig"), run, "key long, node long")


def _step(key, token):
    """The path extended by a token, as a 64-bit hash."""
    import numpy as np

    key = (key ^ (token + np.uint64(0x51ED27))) * np.uint64(_MIX)
    key ^= key >> np.uint64(31)
    key = key * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(29))


def _branch(rows: DataFrame, percent: int, base: bool) -> DataFrame:
    """(key, node) one level down: (key, node, sig) on the tokens that the path selects."""
    names, _ = arrow_fields("key long, node long")
    every, more = _branches(percent)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            node = b.column(1).to_numpy()
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, WIDTH)
            pick = _step(key, np.uint64(1))
            first = (pick % np.uint64(WIDTH)).astype(np.int64)
            # an odd stride: the coordinates of a path's branches differ
            stride = ((pick >> np.uint64(16)) % np.uint64(WIDTH // 2)).astype(np.int64) * 2 + 1
            at = np.arange(len(key))
            further = (pick >> np.uint64(40)) % np.uint64(1000) < np.uint64(math.ceil(1000 * more))
            for branch in range(ROOTS if base else every + 1):
                some = at if base or branch < every else at[further]
                coord = (first[some] + branch * stride[some]) % WIDTH
                got = _step(_step(key[some], np.uint64(branch + 2)), sig[some, coord].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(node[some])], names=names)

    return on_workers(rows.select("key", "node", "sig"), run, "key long, node long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest
    node of its component. Hooking and pointer jumping; each step is a join
    of written tables, in a number of steps logarithmic in path lengths."""
    links = stored(links, "near-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("root")), "near-up")
    while True:
        while True:
            at = up.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            jumped = stored(up.join(at, up["root"] == at["n2"]).select("node", "r2", (F.col("root") != F.col("r2")).alias("moved")),
                            "near-jump")
            up = jumped.select("node", F.col("r2").alias("root"))
            if jumped.filter("moved").isEmpty():
                break
        left = _between(links, up)
        if left.isEmpty():
            return up
        links = left
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy(F.col("a").alias("h")).agg(F.min("b").alias("to")).filter("to < h"), "near-hook")
        up = stored(up.join(hook, up["node"] == hook["h"], "left").select("node", F.coalesce("to", "root").alias("root")), "near-up")


def _between(links: DataFrame, up: DataFrame) -> DataFrame:
    """Links between different roots, as links of roots."""
    a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    half = stored(links.join(a, "a"), "near-half")
    return stored(half.join(b, "b").filter("ra <> rb").select(
        F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "near-between")


def _full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, codes): the full sets of some nodes, from their texts."""
    names, types = arrow_fields("node long, codes binary")
    need = nodes.select("row", "node", "h")
    rows = docs.join(need, docs["__row"] == need["row"]).select("node", "h", "__text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            node, codes = [], []
            for k, h, t in zip(*[c.to_pylist() for c in b.columns]):
                raw = shingles(t, size).tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() != h:
                    raise ValueError("a row's text has changed since its set was hashed")
                node.append(k)
                codes.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(node, types[0]), pa.array(codes, types[1])], names=names)
        _words.clear()

    return on_workers(rows, run, "node long, codes binary")


def _alike(x, y, percent: int) -> bool:
    import numpy as np

    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    names, types = arrow_fields("a long, b long")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("codes").alias("ca")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("codes").alias("cb")), "b").select("a", "b", "ca", "cb")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b, ca, cb = [c.to_pylist() for c in batch.columns]
            ok = [i for i in range(len(a)) if _alike(np.frombuffer(ca[i], np.uint64), np.frombuffer(cb[i], np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in ok], t) for v, t in zip((a, b), types)], names=names)

    return on_workers(two, run, "a long, b long").distinct()


def _floor(percent: int) -> float:
    """Share of equal tokens below which a pair is not checked."""
    s = percent / 100
    return s - SLACK * math.sqrt(s * (1 - s) / WIDTH)


def _estimates(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, est) of pairs whose sketches agree enough."""
    names, types = arrow_fields("a long, b long, est double")
    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    two = one.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b").filter(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b", "sa", "sb")
    least = _floor(percent)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, WIDTH) for i in (2, 3))
            est = (x == y).mean(axis=1)
            ok = pa.array(est >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok).cast(types[0]), batch.column(1).filter(ok).cast(types[1]),
                                              pa.array(est[est >= least])], names=names)

    return on_workers(two, run, "a long, b long, est double")


def _groups(batches, columns):
    """Groups of equal first column from sorted batches, as lists of columns."""
    import numpy as np

    rest = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        cut = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        cut = [0, *cut.tolist()]
        for i, j in zip(cut, cut[1:]):
            yield [c[i:j] for c in cols]
        rest = [c[cut[-1]:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _passing(comp, n, sig, percent: int, least: float):
    """Index pairs (i, j) of a leaf, of different components, whose sketches pass."""
    import numpy as np

    order = np.argsort(n, kind="stable")
    sizes, tokens, comps = n[order], sig[order], comp[order]
    first, second = [], []
    for i in range(len(order) - 1):
        # partners at least as large, up to the largest that can be similar
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        if end <= i + 1:
            continue
        j = np.arange(i + 1, end)
        j = j[comps[i + 1:end] != comps[i]]
        if len(j):
            j = j[(tokens[j] == tokens[i]).mean(axis=1) >= least]
            first.append(np.full(len(j), order[i]))
            second.append(order[j])
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(first), np.concatenate(second)


def _suspects(leaves: DataFrame, percent: int) -> DataFrame:
    """(key, node, comp, n, sig) of leaf rows that some sketch comparison passes."""
    schema = "key long, node long, comp long, n long, sig binary"
    names, types = arrow_fields(schema)
    least = _floor(percent)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for key, node, comp, n, sig in _groups(batches, names):
            if len(key) < 2 or (comp == comp[0]).all():
                continue
            tokens = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, WIDTH)
            i, j = _passing(comp, n, tokens, percent, least)
            if len(i):
                some = np.unique(np.concatenate((i, j)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[some], t) for c, t in zip((key, node, comp, n, sig), types)], names=names)

    dealt = leaves.select("key", "node", "comp", "n", "sig").repartition("key").sortWithinPartitions("key", "node")
    return on_workers(dealt, run, schema)


def _leaf_links(suspects: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links inside the leaves, enough to connect what is linked."""
    names, types = arrow_fields("a long, b long")
    least = _floor(percent)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, node, comp, n, sig, codes in _groups(batches, None):
            tokens = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, WIDTH)
            full = [np.frombuffer(c, np.uint64) for c in codes]
            root: dict = {}

            def find(c):
                while root.get(c, c) != c:
                    c = root[c]
                return c

            a, b = [], []
            for i, j in zip(*_passing(comp, n, tokens, percent, least)):
                x, y = find(comp[i]), find(comp[j])
                if x != y and _alike(full[i], full[j], percent):
                    root[max(x, y)] = min(x, y)
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, types[0]), pa.array(b, types[1])], names=names)

    both = suspects.join(sets, "node").select("key", "node", "comp", "n", "sig", "codes")
    dealt = both.repartition("key").sortWithinPartitions("key", "node")
    return on_workers(dealt, run, "a long, b long").distinct()


def _with_counts(rows: DataFrame, tag: str) -> DataFrame:
    """(key, node, comp, c) of buckets that hold several components."""
    buckets = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                     .filter("lo < hi").select("key", "c"), tag)
    return rows.join(buckets, "key")


def similar_components(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text",
                       leaf: int = LEAF, branch: int = BRANCH, depth: int = DEPTH, row_col: str | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept. ``row_col``: a column
    that is every row's alone, where ``docs`` has one."""
    if row_col is None:
        row_col = free_name(docs, "__row")
        docs = with_row_key(docs, row_col)
    rows = docs.select(F.col(row_col).alias("__row"), F.col(id_col).alias("__id"), body(text_col).alias("__text"))
    sets = stored(sets_of(rows, size), "near-sets")
    nodes = stored(sets.filter("n > 0").groupBy("h").agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.first("n").alias("n"),
                                                         F.first("sig").alias("sig"))
                   .withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    links = _links(rows, nodes, size, percent, leaf, branch, depth)
    roots = components(links)
    placed = nodes.select("node", "h", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed, "near-placed")
    least = stored(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "near-least")
    of_set = stored(placed.join(least, "root").select("h", "component_id"), "near-of-set")
    out = sets.select("id", "n", "h").join(of_set, "h", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.col("id").eqNullSafe(comp).alias("kept"))


def _links(rows: DataFrame, nodes: DataFrame, size: int, percent: int, leaf: int, branch: int,
           depth: int) -> DataFrame:
    """Confirmed links (a, b) of nodes that connect all that is linked."""
    keys = _paths(nodes, number_of_trees(percent))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("pivot")).filter("c > 1"),
                    "near-buckets")
    base = stored(keys.join(shared.select("key", "pivot"), "key"), "near-base")
    # contraction: the best bucket minimum of every node
    stars = base.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    best = stored(_estimates(stars, nodes, percent).groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")), "near-stars")
    wanted = nodes.join(best.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    sets = stored(_full_sets(rows, wanted, size), "near-full")
    links = stored(_confirmed(best.select("a", "b"), sets, percent), "near-confirmed")
    up = components(links)
    rest = base.select("key", "node").join(up, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    rest = stored(_with_counts(rest, "near-mixed"), "near-rest")
    small = nodes.select("node", "n", "sig")
    leaves = [_chunk_pairs(rest.filter(F.col("c") <= branch), leaf)]
    rest = rest.filter(F.col("c") > branch)
    for level in range(depth):
        if rest.isEmpty():
            break
        children = _branch(rest.select("key", "node").join(small, "node").select("key", "node", "sig"), percent, level == 0)
        children = children.join(up, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        children = stored(children, "near-children")
        rest = stored(_with_counts(children, "near-mixed"), "near-rest")
        leaves.append(_chunk_pairs(rest.filter(F.col("c") <= branch), leaf))
        rest = rest.filter(F.col("c") > branch)
    else:
        leaves.append(_chunk_pairs(rest, leaf))
    some = leaves[0]
    for more in leaves[1:]:
        some = some.unionByName(more)
    suspects = stored(_suspects(some.join(small, "node"), percent), "near-suspects")
    wanted = nodes.join(suspects.select("node").distinct(), "node", "left_semi")
    found = _leaf_links(suspects, stored(_full_sets(rows, wanted, size), "near-full"), percent)
    return links.unionByName(found)


def _chunk_pairs(rest: DataFrame, leaf: int) -> DataFrame:
    """Every pair of a bucket's chunks is a leaf; a bucket of at most ``leaf`` nodes is one chunk."""
    m = F.expr(f"IF(c <= {leaf}, 1, CAST(ceil(2.0 * c / {leaf}) AS INT))")
    cut = rest.withColumn("m", m).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    pairs = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    key = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return pairs.select(key.alias("key"), "node", "comp", "c")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component (the smallest id,
    null ids last, then the first row), with all their columns."""
    key = free_name(docs, "__row")
    rows = with_row_key(docs, key)
    placed = similar_components(rows, size, percent, key, text_col, row_col=key).select(F.col(key).alias("placed"), "component_id")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("row")).alias("o")
    first = placed.join(rows.select(F.col(key).alias("row"), order), F.col("placed") == F.col("row")).groupBy("component_id").agg(
        F.min("o").alias("o"))
    return rows.join(first.select(F.col("o.row").alias(key)), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
