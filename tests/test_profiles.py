import random

import numpy as np
import pytest

from concilia.operators.profiling import exact_quantiles, numeric_summary, value_topk

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def quantiles(df, cols=("x",), probs=PROBS):
    return {r["column"]: list(r["q"]) for r in exact_quantiles(df, list(cols), probs).collect()}


def test_exact_quantiles_brute_force(spark):
    rnd = random.Random(11)
    data = [rnd.choice([rnd.random() * 100, float(rnd.randint(0, 5))]) for _ in range(20000)] + [None, float("nan")]
    df = spark.createDataFrame([(x,) for x in data], "x double").repartition(4)
    clean = np.array([x for x in data if x is not None and x == x])
    assert np.allclose(quantiles(df)["x"], np.quantile(clean, PROBS), rtol=0, atol=1e-12)


@pytest.mark.parametrize("expr", [
    "CAST(id AS double)",
    "7.0",                                              # one value for all rows
    "IF(id % 2 = 0, 5.0, id / 3)",                      # half of the rows on one value
    "pow(10.0, (id * 7919 % 200001) / 400.0 - 250)",    # 500 powers of ten
    "-1e15 + (id * 31 % 1009) / 8",                     # far from zero, close together
])
def test_exact_quantiles_of_many_rows(spark, expr):
    df = spark.range(200001).selectExpr(f"CAST({expr} AS double) AS x")
    want = np.quantile(df.toPandas()["x"].to_numpy(), PROBS)
    assert np.allclose(quantiles(df)["x"], want, rtol=1e-14, atol=0)


def test_exact_quantiles_of_several_columns_and_none(spark):
    df = spark.createDataFrame([(1.0, 5, None), (None, 7, None), (2.0, 9, None)], "x double, `y.z` int, w double")
    got = quantiles(df, ("x", "y.z", "w"), (0.25, 0.5))
    assert got == {"x": [1.25, 1.5], "y.z": [6.0, 7.0]}
    assert quantiles(df.limit(0)) == {}


def test_exact_quantiles_keep_infinite_values(spark):
    df = spark.createDataFrame([(x,) for x in (float("-inf"), -1.0, 2.0, float("inf"), float("inf"))], "x double")
    assert quantiles(df, probs=(0.0, 0.25, 0.5, 0.75, 1.0))["x"] == [float("-inf"), -1.0, 2.0, float("inf"), float("inf")]


def test_numeric_summary_takes_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    r = numeric_summary(df, ["x"]).first()
    assert (r["count"], r["mean"], r["std"], r["min"], r["max"], r["q50"]) == (1, 1.0, None, 1.0, 1.0, 1.0)


def test_numeric_summary_starts_no_job_while_built(spark):
    df = spark.range(100).selectExpr("CAST(id AS double) AS x")
    sc = spark.sparkContext
    sc.setJobGroup("summary-build", "building only")
    try:
        summary = numeric_summary(df, ["x"])
        assert not sc.statusTracker().getJobIdsForGroup("summary-build")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert summary.count() == 1


def test_topk_ties_broken_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "f string")
    rows = value_topk(df, ["f"], k=2).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("c", 2), ("a", 1)]
    assert rows[0]["n_distinct"] == 3
