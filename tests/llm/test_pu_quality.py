"""The positive-unlabelled classifier: held-out accuracy, the risk against numpy, and its defined cases."""

import random
import zlib

import numpy as np
import pytest

from concilia.llm import pu_quality as Q
from concilia.llm.common import stored

SCHEMA = "doc_id long, text string, label int, quality int, score string, x double"


def _corpus(n, seed, junk=0.3):
    rng = random.Random(seed)
    words = ["the", "of", "house", "winter", "running", "a", "green", "river", "to", "stone", "because", "sun", "Été"]
    out = []
    for i in range(n):
        w = [rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(3, 150))]
        bad = rng.random() < junk
        if bad:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + " |" for x in w] if kind == 1 else [x + "###" for x in w]
        out.append((i, " ".join(w), int(not bad)))
    return out


def _auc(score, good):
    order = np.argsort(score, kind="stable")
    _, inverse, counts = np.unique(np.asarray(score)[order], return_inverse=True, return_counts=True)
    rank = np.empty(len(score))
    rank[order] = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    good = np.asarray(good)
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.fixture(scope="module")
def tables(spark):
    rows = _corpus(3000, 1)
    docs = spark.createDataFrame([(i, t, 0, 1, "x", 0.5) for i, t, _ in rows], SCHEMA).repartition(4)
    # labels of the held-out side are wrong: reading them would show
    labels = [(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q, 0) for i, _, q in rows if i % 2]
    return rows, docs, spark.createDataFrame([*labels, (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, tables):
    rows, docs, labels = tables
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    side = [(got[i], q) for i, _, q in rows if got[i].held_out]
    assert sum(r.predicted == q for r, q in side) / len(side) > 0.98
    assert _auc([r.score for r, _ in side], [q == 1 for _, q in side]) > 0.99


def test_the_prior_is_estimated(spark, tables):
    rows, docs, labels = tables
    model = Q.learn(stored(Q._described(docs, "doc_id", "text"), "test"), labels)
    assert abs(model.prior - np.mean([q for *_, q in rows])) < 0.08


def test_negative_labels_are_not_learned_from(spark, tables):
    rows, docs, labels = tables
    described = stored(Q._described(docs, "doc_id", "text"), "test")
    one, two = Q.learn(described, labels), Q.learn(described, labels.filter("quality = 1"))
    assert np.allclose(one.weights, two.weights) and one.prior == pytest.approx(two.prior)


def test_risk_equals_numpy(spark, tables):
    rows, docs, labels = tables
    described = stored(Q._described(docs, "doc_id", "text"), "test").filter("NOT held_out")
    flagged = described.selectExpr("id % 5 = 1 AS positive", "x")
    scale = Q._scale(flagged)
    weights = np.random.default_rng(3).normal(size=len(Q.NAMES) + 1)
    (loss_u, grad_u, curve), (loss_p, loss_not_p, grad_not_p, mean_p) = Q._terms(flagged, scale, weights)
    got = flagged.collect()
    x, p = np.array([r.x for r in got], float), np.array([r.positive for r in got])
    assert np.allclose(scale[0], x[~p].mean(0)) and np.allclose(scale[1], x[~p].std(0) + 1e-3, atol=1e-4)
    x = np.c_[np.ones(len(x)), np.clip((x - scale[0]) / scale[1], -Q.REACH, Q.REACH)]
    z = x @ weights
    s = 1 / (1 + np.exp(-z))
    assert loss_u == pytest.approx(np.log1p(np.exp(z[~p])).mean()) and loss_p == pytest.approx(np.log1p(np.exp(-z[p])).mean())
    assert loss_not_p == pytest.approx(np.log1p(np.exp(z[p])).mean())
    assert np.allclose(grad_u, (x[~p] * s[~p, None]).mean(0)) and np.allclose(grad_not_p, (x[p] * s[p, None]).mean(0))
    assert np.allclose(curve, np.einsum("ni,nj,n->ij", x[~p], x[~p], (s * (1 - s))[~p]) / (~p).sum()) and np.allclose(mean_p, x[p].mean(0))


def test_a_prior_that_is_too_large_backs_up(spark, tables):
    """The risk on junk estimated with the kept weights stays non-negative, or the risk is that of a step before."""
    rows, docs, labels = tables
    described = stored(Q._described(docs, "doc_id", "text"), "test").filter("NOT held_out")
    good = spark.createDataFrame([(i,) for i, _, q in rows if q], "good long")
    flagged = described.selectExpr("false AS positive", "x").unionByName(
        described.join(good, described.id == good.good).selectExpr("true AS positive", "x"))
    scale = Q._scale(flagged)
    found = Q._fit(flagged, scale, np.zeros(len(Q.NAMES) + 1), 0.97, Q.RIDGE)
    (loss_u, *_), (loss_p, loss_not_p, *_) = Q._terms(flagged, scale, found)
    risk = 0.97 * loss_p + max(0, loss_u - 0.97 * loss_not_p)
    assert risk <= np.log(2) + 1e-9 and np.isfinite(found).all()


def test_defined_cases(spark, tables):
    _, docs, labels = tables
    odd = spark.createDataFrame([(None, None, 1, 1, "", 0.0), (9, "", 1, 1, "", 0.0), (9, " \n\t", 1, 1, "", 0.0),
                                 (10, "x" * 200_000, 1, 1, "", 0.0), (10, "x " * 50_000, 1, 1, "", 0.0)], SCHEMA)
    got = Q.classify(docs.unionByName(odd), labels).collect()
    assert len(got) == 3005 and [r.held_out for r in got if r.doc_id is None] == [True]
    assert all(0 <= r.score <= 1 for r in got)
    blind = Q.classify(docs, labels.filter("quality = 0")).collect()
    assert len(blind) == 3000 and all((r.score, r.predicted) == (0.5, 1) for r in blind)
    assert Q.classify(docs.limit(0), labels.limit(0)).count() == 0
