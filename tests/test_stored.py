"""Stored registers: no exchange of a register, hot codes apart, the same results as the lazy path."""

import os
import random
import re

import pytest

from concilia.config import LedgerColumns, ReconConfig, TaxColumns
from concilia.plans.reconciliation import reconcile, reconcile_stored
from concilia.sinks.report import sheet_rows
from concilia.sources.stored import bucket_count, store_registers

TAX = TaxColumns(key="k", amount="a", nit="n", status="st", modality="m", sector="s", branch="b", invoice="i")
LED = LedgerColumns(key="k", amount="a", nit="n", branch="b", invoice="i", order=("i",))
CFG = ReconConfig(tax=TAX, ledger=LED)
TAX_SCHEMA = "k string, a string, n string, st string, m string, s string, b string, i string"
LED_SCHEMA = "k string, a double, n string, b int, i bigint"


def _registers(spark, seed, hot=True, tax_rows=300):
    rng = random.Random(seed)
    code = lambda: rng.choice([None, "HOT", "HOT"] if hot and rng.random() < 0.4 else [f"C{rng.randrange(150)}"])
    tax = [(code(), str(rng.choice([10, 20.5, "x", ""])), str(rng.randrange(3)), rng.choice(["VALIDA", "VALIDA", "ANULADA"]), rng.choice("22223"),
            rng.choice(["01", "02", None]), rng.choice(["0", "5", None, "z"]), str(rng.randrange(4))) for _ in range(tax_rows)]
    led = [(code() or rng.choice([None, "L1"]), rng.choice([10.0, 20.5, None]), str(rng.randrange(3)), rng.choice([0, 5, 6, None]),
            rng.randrange(4)) for _ in range(300)]
    return spark.createDataFrame(tax, TAX_SCHEMA), spark.createDataFrame(led, LED_SCHEMA)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("seed,hot,tax_rows", [(1, True, 300), (2, False, 300), (3, True, 0)])
def test_stored_equals_lazy(spark, scratch, seed, hot, tax_rows):
    tax, led = _registers(spark, seed, hot, tax_rows)
    kept = store_registers(tax, led, CFG, os.path.join(scratch, "reg"), buckets=5, hot_rows=20)
    assert (kept.hot is not None) == hot
    one, two = reconcile(tax, led, CFG), reconcile_stored(kept, CFG)
    for get in ("stats", "status", "gate", "branch_report"):
        assert _rows(getattr(one, get)()) == _rows(getattr(two, get)()), get
    for rows in ("only_tax", "only_ledger", "pairs", "ledger_valid", "tax", "ledger"):
        assert _rows(getattr(one, rows)) == _rows(getattr(two, rows)), rows


def test_an_empty_tax_register_counts_all_ledger_branches(spark):
    _, led = _registers(spark, 5)
    r = reconcile(spark.createDataFrame([], TAX_SCHEMA), led, CFG)
    total = r.stats().first()["total_ledger_amount"]
    assert led.filter("k IS NULL AND a IS NOT NULL AND b IS NOT NULL").count() > 0
    in_branches = sum(x["inv_amount"] for x in r.branch_report().collect())
    assert float(in_branches) == led.filter("b IS NOT NULL").agg({"a": "sum"}).first()[0] and float(total) >= float(in_branches)


def test_no_exchange_of_a_register(spark, scratch):
    tax, led = _registers(spark, 9, hot=False)
    kept = store_registers(tax, led, CFG, os.path.join(scratch, "plan"), buckets=5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = reconcile_stored(kept, CFG)
        exchanges = lambda df: re.findall(r"Exchange hashpartitioning\((\w+)", df._jdf.queryExecution().executedPlan().toString())
        assert exchanges(r.stats()) == [] and exchanges(r.parts[0].tax_tagged) == [] and exchanges(r.parts[0].pairs) == []
        assert set(exchanges(r.status())) == {"branch_code"} and len(exchanges(r.status())) <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_grow_with_the_registers(spark, monkeypatch):
    from concilia.fixtures import views

    few, many = spark.range(30), spark.range(1000)
    assert [bucket_count(a, b, 16, 100) for a, b in ((few, few), (many, many), (many, few))] == [16, 20, 16]
    assert bucket_count(many, many, rows=30) == 67
    monkeypatch.setattr(views, "bucket_count", lambda tax, ledger, least: bucket_count(tax, ledger, least, 150))
    t = views.Tables(spark, "/root/testdata/sf0.001/.")  # a path that no other test keeps registers of
    kept = views.stored_registers(t)
    want = -(-(views.v_tax(t).count() + views.v_ledger(t).count()) // 150)
    assert want > views.BUCKETS
    for df in kept.main:
        assert len(df.inputFiles()) == want  # a file a bucket


def test_derived_tables_are_written_where_they_are_made(spark):
    from concilia.fixtures.views import Tables, materialized

    got = materialized(Tables(spark, "/root/testdata/sf0.001/."), "probe", lambda t: spark.range(0, 90, 1, 3))
    assert got.count() == 90 and len(got.inputFiles()) == 3


@pytest.mark.parametrize("hot", [True, False])
def test_sheets_of_stored_registers(spark, scratch, hot):
    tax, led = _registers(spark, 11, hot)
    kept = store_registers(tax, led, CFG, os.path.join(scratch, "sheets"), buckets=5, hot_rows=20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sheet_rows(reconcile_stored(kept, CFG))
        assert _rows(rows) == _rows(sheet_rows(reconcile(tax, led, CFG))) and not rows.isEmpty()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert hot or "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
