"""Joins with per-key aggregates: with half of all rows on one key and many
on NULL, AQE splits the hot partition and results stay the same."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from concilia.operators.matching import tag_tax
from concilia.operators.register import map_register
from concilia.operators.setops import duplicate_keys
from concilia.operators.skew import join_unique
from concilia.plans.reconciliation import reconcile
from tests.test_report import LED, TAX, ReconConfig

SETTINGS = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _register(spark, n=40000):
    i = F.col("id")
    k = F.when(i % 2 == 0, F.lit("HOT")).when(i % 10 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("K"), i % 3000))
    return spark.range(n).repartition(8).select(
        k.alias("k"), (i % 5).cast("double").alias("a"), (i % 3).cast("string").alias("n"), F.lit("VALIDA").alias("st"),
        F.lit("2").alias("m"), F.lit("01").alias("s"), F.lit("0").alias("b"), F.md5(i.cast("string")).alias("i"))


def _largest_share(df, hot):
    """Largest part of the hot key's rows that one task of the last stage holds (all columns are carried)."""
    got = Counter(r[0] for r in df.select(F.spark_partition_id(), F.expr(hot), F.xxhash64("*")).collect() if r[1])
    return max(got.values()) / sum(got.values())


def test_hot_keys_are_split(skewed):
    tax = _register(skewed)
    led = skewed.range(3000).select(F.concat(F.lit("K"), "id").alias("k"), F.lit(1.0).alias("a"), F.lit("1").alias("n"),
                                    F.lit(0).alias("b"), F.col("id").alias("i"), F.lit("note").alias("glosa")) \
        .unionByName(skewed.range(5).select(F.lit("HOT").alias("k"), F.lit(2.0).alias("a"), F.lit("1").alias("n"),
                                            F.lit(0).alias("b"), F.col("id").alias("i"), F.lit("hot note").alias("glosa")))
    cfg = ReconConfig(tax=TAX, ledger=LED)
    tagged = tag_tax(tax, led, cfg)
    assert _largest_share(tagged, "k = 'HOT'") < 0.25
    assert tagged.filter("k = 'HOT'").agg(F.min("n_ledger"), F.max("n_ledger"), F.count(F.lit(1))).first() == (5, 5, 20000)
    copies = duplicate_keys(tax, "k")
    assert _largest_share(copies, "k = 'HOT'") < 0.25
    assert copies.filter("k = 'HOT'").agg(F.min("copies"), F.count(F.lit(1))).first() == (20000, 20000)
    mapped = map_register(tax, (("k", "authorization_code"), ("i", "customer_name")), only_tax=tax.filter("k = 'K1'"),
                          only_tax_key="k", ledger=led, ledger_key="k", ledger_glosa="glosa", ledger_order=("i",))
    assert _largest_share(mapped, "authorization_code = 'HOT'") < 0.25
    assert mapped.count() == tax.count()
    assert mapped.filter("authorization_code = 'HOT'").select("obs").distinct().collect() == [("hot note",)]
    assert mapped.filter("authorization_code IS NULL").filter("obs IS NOT NULL").count() == 0


def test_join_unique_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (3, "d")], "k int, v string")
    one = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k IS NOT NULL AND k < 3")
    got = join_unique(rows, one, "k")
    assert got.columns == ["k", "v", "n"]
    assert sorted(got.collect(), key=lambda r: r["v"]) == [(1, "a", 2), (1, "b", 2), (None, "c", None), (3, "d", None)]
    assert join_unique(rows, one, "k", "inner").count() == 2


def test_statistics_form_no_pairs(skewed):
    """Counts over n x m copies come from reduced sides: 20000 x 20000
    copies of a key would be 400 million pair rows."""
    tax = _register(skewed).withColumn("i", F.lit("1"))
    led = _register(skewed).select("k", "a", "n", F.lit(0).alias("b"), F.lit(1).cast("bigint").alias("i"))
    got = reconcile(tax, led, ReconConfig(tax=TAX, ledger=LED)).stats().first()
    t = [r for r in tax.select("k", "a", "n").collect() if r["k"] is not None]
    sides = Counter((r["k"], r["a"], r["n"]) for r in t)
    by_key = {}
    for (k, a, n), c in sides.items():
        by_key.setdefault(k, []).append((a, n, c))
    pairs = [(x, y) for v in by_key.values() for x in v for y in v]
    assert got["amount_mismatch_count"] == sum(x[2] * y[2] for x, y in pairs if x[0] != y[0])
    assert got["customer_mismatch_count"] == sum(x[2] * y[2] for x, y in pairs if x[1] != y[1])
    assert got["matched_count"] == sum(x[2] * y[2] for x, y in pairs if x[:2] == y[:2])
