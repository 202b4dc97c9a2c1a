"""Quality rules: fixed limits, and robust multivariate outliers.

Each text gets counts (words, symbols, repeated lines, words in repeated
five-word windows, ...) in one map-only pass. Texts with fewer than
MIN_WORDS words, or with more than MAX_REPEAT percent of their words in
repeated windows, fail the base rules.

The others are held against their peers, the rows of the same language
and source: their transformed statistics form a vector, and a minimum
covariance determinant (MCD) estimate gives the peers' centre and scatter
without being pulled by the junk among them. A text whose squared
Mahalanobis distance is above CUTOFF is rejected.

The MCD is fitted by concentration steps over all rows of the group:
start from medians and quartile ranges, then STEPS times take the SUPPORT
share of rows nearest to the centre, and their mean and covariance. Each
step is two aggregates that combine on the map side (a histogram of the
distances, then sums of products), so a group of any size, also one that
holds a third of all rows, costs each task one row per group and bin, and
no group is ever collected. Medians and cut-offs come from histograms with
fixed bins, so they do not depend on how rows are dealt to tasks.

Transforms: shares are counted with PRIOR pseudo-words of typical text, so
short texts stay near the centre; each coordinate's variance has a floor
(FLOORS), so a group of near-identical texts rejects nothing that lies
within ordinary spread. A group with fewer than MIN_ROWS rows that pass
the base rules has no estimate of its own: its rows are held against their
language, or else against all rows; where even those are too few, nothing
is rejected beyond the base rules.

Defined cases: null text has no words and fails the base rules; null
language or source is a group of its own; null and repeated ids keep one
row per input row; other columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_fields, body, free_name, on_workers, stored, with_row_key

MIN_WORDS = 10
MAX_REPEAT = 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Words of typical text that every text is mixed with before shares are taken.
PRIOR = 30.0
#: coordinate: (statistic, typical value per word, smallest standard deviation of the coordinate)
COORDINATES = {
    "length": ("word_chars", 5.0, 0.06),
    "symbols": ("n_symbols", 0.0, 0.03),
    "marks": ("n_marks", 0.15, 0.06),
    "capitals": ("n_capitals", 0.12, 0.06),
    "repeats": ("n_repeat_words", 0.0, 0.05),
    "lines": ("n_dup_lines", 0.0, 0.02),
}
NAMES = tuple(COORDINATES)
FLOORS = tuple(f for _, _, f in COORDINATES.values())
MARKS = ".,;:!?\"'()"
SUPPORT = 0.75
STEPS = 3
MIN_ROWS = 50
CUTOFF = 120.0
#: Bins: of a coordinate, and of the logarithm of a distance.
COORDINATE_BIN, DISTANCE_BIN = 0.005, 0.02

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals")


def repeated_words(words: list) -> int:
    """Words inside 5-word windows found twice or more in the text."""
    import numpy as np

    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    # one 64-bit code per window; equal windows have equal codes, others differ but for a chance of 2**-64 a pair
    z = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    code = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        code = (code + z[k:k + n]) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
    order = np.sort(code)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    twice = np.flatnonzero(np.isin(code, again))
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, twice, 1)
    np.add.at(inside, twice + WINDOW, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def text_counts(text: str) -> tuple:
    """COUNTS of one text."""
    raw = text.encode()
    words = raw.split()
    lines, seen, dup = text.split("\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += 1
            elif line.strip(" \t\n\x0b\x0c\r"):
                seen.add(line)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), dup, repeated_words(words),
            sum(map(text.count, MARKS)), sum(map(text.count, _CAPITALS)))


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"


def count_texts(docs: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """(id, g0..: group labels from the finest to that of all rows, COUNTS) per row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    depth = len(group_cols) + 1
    schema = (f"id {id_type}, " + ", ".join(f"g{i} string" for i in range(depth)) + ", "
              + ", ".join(f"{c} long" for c in COUNTS))
    names, types = arrow_fields(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [text_counts(t) for t in b.column(depth + 1).to_pylist()]
            cols = list(zip(*got)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(types[i]) for i in range(depth + 1)],
                                              *[pa.array(c, pa.int64()) for c in cols]], names=names)

    part = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in group_cols]
    labels = [F.to_json(F.array(*part[:len(part) - i])) if i < len(part) else F.lit("[]") for i in range(depth)]
    return on_workers(docs.select(F.col(id_col), *labels, body(text_col)), run, schema)


def _vector() -> list:
    """The coordinates: log of the mean length, square roots of the shares."""
    share = lambda stat, typical: (F.col(stat) + PRIOR * typical) / (F.col("n_words") + PRIOR)
    return [(F.log(share(stat, typical)) if name == "length" else F.sqrt(share(stat, typical))).alias(name)
            for name, (stat, typical, _) in COORDINATES.items()]


def _quantile(rows: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """Bin numbers where the running count of each key reaches the shares ``at``."""
    bins = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(W.partitionBy(*keys).orderBy("bin")))
    bins = bins.withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    return bins.groupBy(*keys).agg(F.first("all").alias("rows"), *[
        F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))).alias(f"q{i}") for i, q in enumerate(at)])


def _distance():
    """Squared distance of a row joined with its model (centre, weights)."""
    d = len(NAMES)
    dev = [F.col(c) - F.col("centre")[i] for i, c in enumerate(NAMES)]
    terms = [dev[i] * dev[j] * F.col("weights")[i * d + j] * (1.0 if i == j else 2.0) for i in range(d) for j in range(i, d)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _start(rows: DataFrame) -> DataFrame:
    """(g, centre, weights) from medians and quartile ranges."""
    long = rows.select("g", F.posexplode(F.array(*NAMES)).alias("k", "x")).withColumn(
        "bin", F.round(F.col("x") / COORDINATE_BIN).cast("long"))
    q = _quantile(long, ["g", "k"], [0.25, 0.5, 0.75])
    floor = F.array(*[F.lit(f) for f in FLOORS])[F.col("k")]
    scale = F.greatest((F.col("q2") - F.col("q0")) * COORDINATE_BIN / 1.349, floor)
    q = q.select("g", "k", "rows", (F.col("q1") * COORDINATE_BIN).alias("m"), scale.alias("s"))
    one = F.transform(F.array_sort(F.collect_list(F.struct("k", "m", "s"))), lambda x: x)
    q = q.groupBy("g").agg(F.first("rows").alias("rows"), one.alias("v")).filter(F.col("rows") >= MIN_ROWS)
    d = len(NAMES)
    weights = F.transform(F.sequence(F.lit(0), F.lit(d * d - 1)), lambda i: F.when(
        F.floor(i / d) == i % d, 1.0 / F.pow(F.col("v")[i % d]["s"], 2)).otherwise(0.0))
    return q.select("g", "rows", F.transform("v", lambda x: x["m"]).alias("centre"), weights.alias("weights"))


def _concentrate(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step: (g, rows, centre, weights, scale)."""
    import numpy as np

    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    far = rows.join(model, "g").withColumn("bin", F.floor(F.log(F.greatest(_distance(), F.lit(0.0)) + 1e-6) / DISTANCE_BIN))
    dev = [F.col(c) - F.col("centre")[i] for i, c in enumerate(NAMES)]  # sums around the old centre, for precision
    moments = [dev[i] for i in range(d)] + [dev[i] * dev[j] for i, j in pairs]
    names = [f"m{i}" for i in range(len(moments))]
    bins = far.groupBy("g", "bin").agg(
        F.first("rows").alias("rows"), F.first("centre").alias("old"), F.count(F.lit(1)).alias("n"),
        *[F.sum(m).alias(c) for m, c in zip(moments, names)])
    before = F.sum("n").over(W.partitionBy("g").orderBy("bin")) - F.col("n")
    core = bins.withColumn("before", before).filter(F.col("before") < SUPPORT * F.col("rows"))
    sums = core.groupBy("g").agg(F.first("rows").alias("rows"), F.sum("n").alias("n"), F.first("old").alias("old"),
                                 F.array(*[F.sum(c) for c in names]).alias("sums"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                mean = np.asarray(r["sums"]) / r["n"]
                shift, cov = mean[:d], np.empty((d, d))
                for (i, j), m in zip(pairs, mean[d:]):
                    cov[i, j] = cov[j, i] = m
                cov = (cov - np.outer(shift, shift)) / CONSISTENCY + np.diag(np.square(FLOORS))
                out.append((r["g"], r["rows"], (np.asarray(r["old"]) + shift).tolist(), np.linalg.inv(cov).ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=fields)

    fields, types = arrow_fields(MODEL)
    return on_workers(sums, run, MODEL)


MODEL = "g string, rows long, centre array<double>, weights array<double>"
#: Share of the variance that the nearest 75 % of normal rows show in six dimensions: P(chi2_8 < q) / 0.75 for
#: the 75 % point q of chi2_6.
CONSISTENCY = 0.734


def fit(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """MCD models (g, rows, centre, weights) of vectors (g, NAMES...)."""
    rows = stored(rows, "quality-vectors")
    model = stored(_start(rows), "quality-start")
    for _ in range(steps):
        model = stored(_concentrate(rows, model), "quality-step")
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple = ("lang", "source"),
          cutoff: float = CUTOFF) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance (null: no estimate), kept."""
    counts = stored(count_texts(docs, id_col, text_col, list(group_cols)), "quality-counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    vectors = counts.select("*", *_vector())
    labels = [f"g{i}" for i in range(len(group_cols) + 1)]
    levels = F.explode(F.array(*labels)).alias("g")
    model = fit(vectors.filter("NOT base_failed").select(levels, *NAMES))
    groups = counts.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
    for i, g in enumerate(labels):
        at = model.select(F.col("g").alias(f"__{g}"), F.col("centre").alias(f"centre{i}"), F.col("weights").alias(f"weights{i}"))
        groups = groups.join(at, F.col(g) == F.col(f"__{g}"), "left")
    finest = lambda c: F.coalesce(*[F.col(f"{c}{i}") for i in range(len(labels))]).alias(c)
    groups = stored(groups.select("g0", finest("centre"), finest("weights")), "quality-models")
    out = vectors.join(groups, "g0").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "distance", kept.alias("kept"))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  group_cols: tuple = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that are kept, each by its own verdict, with all their columns."""
    key = free_name(docs, "__row")
    rows = with_row_key(docs, key)
    kept = judge(rows, key, text_col, group_cols).filter("kept").select(key)
    return rows.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
