"""Quality classifier learned from trusted positives and unlabelled web text.

Only texts marked good are trusted; all others, whatever their label, are
unlabelled: a mixture of a share pi of good texts and junk. A logistic model
z = w.x of text statistics minimises the non-negative unbiased risk

    pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)]),   l(z) = log(1 + exp(-z))

over the positives P and the unlabelled texts U. The bracket estimates the
risk on junk and can only be negative by overfitting or by a prior that is
too large. As l(-z) - l(z) = z, the unbiased risk is convex and Newton steps
find its minimum; where a step makes the bracket negative, the next one goes
back up its gradient, and the weights of the least non-negative risk met are
kept.

The prior is estimated, not given: a classifier's highest scores hold good
texts almost alone, so pi is the least ratio, over score thresholds, of the
share of U above to the share of P above, with a bound for the chance that
small shares vary (best-bin estimate). Fit and estimate take ``ROUNDS`` turns.

Everything is fitted on all rows of the learning side, none is sampled: a
step is one pass that adds up, per task, the loss, gradient and curvature
(about 200 numbers), summed by Spark; thresholds come from a histogram of fixed
bins. So the driver gets a few hundred numbers a step, whatever the input, and
no group is collected. Statistics are taken once and stored (about twenty
floats a text).

Inputs of a score are the text's statistics alone. Labels are read for rows
whose crc32(id as text) mod 3 is not 1; the others are held out, texts too.

Defined cases: null text is empty; empty texts are scored like any; a null id
is held out and has no label; repeated ids keep one row each; of several
labels of an id the least counts, null labels do not; without a positive (or
without rows to learn from) every score is 0.5; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fields, body, on_workers, stored

#: Statistics of a text; shares are square roots, taken with PRIOR words of nothing.
NAMES = ("words", "word_size", "capitals", "capital_words", "exclaims", "symbols", "bars", "stops", "commas", "digits",
         "markup", "lines", "repeated_lines", "repeated_windows", "distinct_words", "quotes", "accents", "longest",
         "doubled_words")
PRIOR = 20.0
WINDOW = 5
#: Standardised statistics are cut here.
REACH = 6.0
#: Weight of the squared weights: RIDGE, and RIDGE_ROWS by the number of positives, as few rows say little.
RIDGE, RIDGE_ROWS = 1e-2, 5.0
FIRST_PRIOR = 0.5
ROUNDS = 2
STEPS = 8
#: Largest change of a weight in one step, and the change under which steps end.
STRIDE, SETTLED = 4.0, 1e-3
#: Bins of the scores z, and where they end.
BINS, EDGE = 2048, 16.0
#: Best-bin estimate: chance of a miss, and weight of its bound.
DELTA, GAMMA = 0.1, 0.01
LEAST_PRIOR = 0.01


def statistics(text: str) -> list[float]:
    """NAMES of one text."""
    import numpy as np

    raw = text.encode()
    w = raw.split()
    n = len(w)
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    count = lambda chars: sum(int(at[c]) for c in chars)
    share = lambda x: float(np.sqrt(x / (n + PRIOR)))
    capitals, accents = int(at[65:91].sum()), int(at[195:].sum())
    letters = capitals + int(at[97:123].sum()) + accents
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = max(n - WINDOW + 1, 0)
    again = windows - len(set(zip(*(w[k:] for k in range(WINDOW)))))
    return [float(np.log1p(n)), float(np.log((sum(map(len, w)) + 5 * PRIOR) / (n + PRIOR))), share(capitals),
            share(sum(map(bytes.isupper, w))), share(count(b"!")), share(count(b"#*$%&")), share(count(b"|")), share(count(b".?")),
            share(count(b",")), share(count(b"0123456789")), share(count(b"<>/\\{}[]=_@^~`+")), share(len(lines)),
            share(len(lines) - len(set(lines))), again / (windows + PRIOR), len(set(w)) / (n + PRIOR), share(count(b"()\"':;-")),
            accents / (letters + 5 * PRIOR), float(np.sqrt(max(map(len, w), default=0))),
            float(np.sqrt(sum(a == b for a, b in zip(w, w[1:])) / max(n - 1, 1)))]


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, held_out, x): the statistics of every text."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, x array<float>"
    names, types = arrow_fields(schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t) for t in b.column(2).to_pylist()], np.float32)
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(types[0]), b.column(1), pa.ListArray.from_arrays(ends, pa.array(x.ravel())).cast(types[2])],
                    names=names)

    return on_workers(docs.select(F.col(id_col), held_out(F.col(id_col)), body(text_col)), run, schema)


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _matrix(column, scale):
    """The rows of an Arrow list column as a matrix: one, and the standardised statistics."""
    import numpy as np

    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return np.c_[np.ones(len(x)), np.clip((x - scale[0]) / scale[1], -REACH, REACH)]


def _summed(rows: DataFrame, add) -> dict[int, float]:
    """{place: total} of the vectors add(positive?, x column) over all batches; one vector per task leaves Python."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                got = add(b.column(0).to_numpy(zero_copy_only=False).astype(bool), b.column(1))
                total = got if total is None else total + got
        if total is not None:
            places = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(total[places])], names=["place", "value"])

    sums = on_workers(rows, run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    return {r.place: r.value for r in sums.collect()}  # as many as places: bounded


def _vector(sums: dict[int, float], size: int):
    import numpy as np

    out = np.zeros(size)
    out[list(sums)] = list(sums.values())
    return out


def _scale(rows: DataFrame):
    """Means and standard deviations of the statistics of the unlabelled rows."""
    import numpy as np

    d = len(NAMES)

    def add(positive, column):
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)[~positive]
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    s = _vector(_summed(rows, add), 1 + 2 * d)
    n = max(s[0], 1)
    mean = s[1:1 + d] / n
    return mean, np.sqrt(np.maximum(s[1 + d:] / n - mean * mean, 0)) + 1e-3


def _terms(rows: DataFrame, scale, weights):
    """Averages at these weights: over U l(-z), its gradient and curvature; over P l(z), l(-z), the gradient of l(-z), x."""
    import numpy as np

    d = len(weights)
    size = 1 + 1 + d + d * d + 1 + 2 + 2 * d

    def add(positive, column):
        x = _matrix(column, scale)
        z = x @ weights
        s = 1 / (1 + np.exp(-z))
        u, p = ~positive, positive
        up = np.logaddexp(0, z)
        xu, su = x[u], s[u]
        return np.concatenate([
            [u.sum(), up[u].sum()], su @ xu, ((xu * (su * (1 - su))[:, None]).T @ xu).ravel(),
            [p.sum(), np.logaddexp(0, -z[p]).sum(), up[p].sum()], s[p] @ x[p], x[p].sum(0)])

    t = _vector(_summed(rows, add), size)
    k = 2 + d + d * d
    u, p = t[:k], t[k:]
    u, p = u[1:] / max(u[0], 1), p[1:] / max(p[0], 1)
    return (u[0], u[1:1 + d], u[1 + d:].reshape(d, d)), (p[0], p[1], p[2:2 + d], p[2 + d:])


def _fit(rows: DataFrame, scale, weights, prior: float, ridge: float):
    """Weights of the least non-negative risk that the steps meet."""
    import numpy as np

    best, found = None, weights
    for _ in range(STEPS):
        (loss_u, grad_u, curve), (loss_p, loss_not_p, grad_not_p, mean_p) = _terms(rows, scale, weights)
        junk = loss_u - prior * loss_not_p
        risk = prior * loss_p + max(0.0, junk) + ridge / 2 * weights @ weights
        if best is None or risk < best:
            best, found = risk, weights
        if junk < 0:  # back up: the estimated risk on junk has to grow
            grad = -(grad_u - prior * grad_not_p)
        else:
            grad = grad_u - prior * mean_p + ridge * weights
        step = np.linalg.solve(curve + ridge * np.eye(len(weights)), grad)
        size = np.abs(step).max()
        weights = weights - step * min(1.0, STRIDE / max(size, 1e-12))
        if size < SETTLED:
            break
    return found


def _prior(rows: DataFrame, scale, weights) -> float:
    """Best-bin estimate of the share of good texts among the unlabelled ones."""
    import numpy as np

    def add(positive, column):
        at = np.clip((_matrix(column, scale) @ weights + EDGE) * (BINS / (2 * EDGE)), 0, BINS - 1).astype(np.int64)
        return np.concatenate([np.bincount(at[~positive], minlength=BINS), np.bincount(at[positive], minlength=BINS)]).astype(float)

    t = _vector(_summed(rows, add), 2 * BINS)
    above = lambda h: np.cumsum(h[::-1])[::-1]
    u, p = above(t[:BINS]), above(t[BINS:])
    if not u[0] or not p[0]:
        return FIRST_PRIOR
    u, p, n_u, n_p = u / u[0], p / p[0], u[0], p[0]
    some = p > 0
    chance = sum(np.sqrt(np.log(4 / DELTA) / (2 * n)) for n in (n_u, n_p))
    at = np.argmin((u[some] + (1 + GAMMA) * chance) / p[some])
    return float(np.clip((u[some] / p[some])[at], LEAST_PRIOR, 1 - LEAST_PRIOR))


class Model:
    """What was learned: scale of the statistics, weights, and the estimated share of good texts."""

    def __init__(self, scale, weights, prior: float):
        self.scale, self.weights, self.prior = scale, weights, prior


def learn(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fits on all rows of the learning side of ``described`` (stored)."""
    import numpy as np

    good = labels.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("good_id")).agg(
        F.min(label_col).alias("label")).filter("label = 1")
    side = described.filter("NOT held_out")
    trusted = side.join(good, F.col("id") == F.col("good_id")).select(F.lit(True).alias("positive"), "x")
    rows = side.select(F.lit(False).alias("positive"), "x").unionByName(stored(trusted, "trusted"))
    scale = _scale(rows)
    weights, prior = np.zeros(len(NAMES) + 1), FIRST_PRIOR
    positives = _vector(_summed(rows, lambda positive, _: np.array([positive.sum()], float)), 1)[0]
    if not positives:
        return Model(scale, weights, prior)
    ridge = RIDGE + RIDGE_ROWS / positives
    weights = _fit(rows, scale, weights, prior, ridge)
    for _ in range(ROUNDS):
        prior = _prior(rows, scale, weights)
        weights = _fit(rows, scale, weights, prior, ridge)
    return Model(scale, weights, prior)


def score(described: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    schema = f"`{id_col}` {described.schema['id'].dataType.simpleString()}, held_out boolean, score double"
    names, types = arrow_fields(schema)
    scale, weights = model.scale, model.weights

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                z = _matrix(b.column(2), scale) @ weights
                yield pa.RecordBatch.from_arrays([b.column(0).cast(types[0]), b.column(1), pa.array(1 / (1 + np.exp(-z)))], names=names)

    return on_workers(described, run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """Learns from the labels and scores every text: id, held_out, score, predicted."""
    described = stored(_described(docs, id_col, text_col), "statistics")
    return score(described, learn(described, labels, id_col, label_col), id_col)
