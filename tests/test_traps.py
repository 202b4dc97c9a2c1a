"""Semantic traps of the reconciliation, one small frame each."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concilia.config import LedgerColumns, ReconConfig, TaxColumns
from concilia.functions import text as X
from concilia.functions.predicates import is_canceled
from concilia.operators.branches import branch_breakdown
from concilia.operators.register import glosa_lookup
from concilia.plans.reconciliation import reconcile

TAX = TaxColumns(key="cuf", amount="amt", nit="nit", status="ESTADO", modality="mod", sector="sec",
                 branch="suc", invoice="inv")
LED = LedgerColumns(key="cuf", amount="total", nit="nit", branch="suc", invoice="inv",
                    order=("fecha", "inv", "id"))
CFG = ReconConfig(tax=TAX, ledger=LED)
TAX_SCHEMA = "cuf string, amt string, nit string, ESTADO string, mod string, sec string, suc string, inv string"
LED_SCHEMA = "cuf string, total double, nit string, suc int, inv bigint, estado int"


def tax(spark, rows):
    return spark.createDataFrame(rows, TAX_SCHEMA)


def led(spark, rows):
    return spark.createDataFrame(rows, LED_SCHEMA)


def stats(spark, t, lg, cfg=CFG):
    return reconcile(tax(spark, t), led(spark, lg), cfg).stats().first().asDict()


def test_t1_same_name_different_case_columns(spark):
    # tax ESTADO and ledger estado coexist; reconciliation prefixes both sides
    r = reconcile(tax(spark, [("A", "10", "1", "VALIDA", "2", "01", "0", "1")]),
                  led(spark, [("A", 10.0, "1", 0, 1, 1)]), CFG)
    cols = r.pairs.columns
    assert "tax_ESTADO" in cols and "inv_estado" in cols
    assert r.pairs.count() == 1


def test_t3_canceled_predicate(spark):
    df = spark.createDataFrame([(" valida ",), ("VALIDA",), ("ANULADA",), (None,), ("nan",)], "s string")
    got = [r[0] for r in df.select(is_canceled(F.col("s"))).collect()]
    assert got == [False, False, True, True, True]


def test_t4_t5_amount_tolerance_and_unparsable(spark):
    t = [("A", "100.01", "1", "VALIDA", "2", "01", "0", "1"),
         ("B", "100.005", "1", "VALIDA", "2", "01", "0", "2"),
         ("C", "n/a", "1", "VALIDA", "2", "01", "0", "3"),
         ("D", "NaN", "1", "VALIDA", "2", "01", "0", "4")]
    lg = [("A", 100.00, "1", 0, 1, 0), ("B", 100.0, "1", 0, 2, 0), ("C", 1.0, "1", 0, 3, 0), ("D", 1.0, "1", 0, 4, 0)]
    s = stats(spark, t, lg)
    assert s["amount_mismatch_count"] == 1  # only 100.01 vs 100.00


def test_t6_t7_invoice_and_nit(spark):
    t = [("A", "1", " 12-3.4 ", "VALIDA", "2", "01", "0", "0000000007"),
         ("B", "1", None, "VALIDA", "2", "01", "x", ""),
         ("C", "1", "5", "VALIDA", "2", "01", "2", "8")]
    lg = [("A", 1.0, "1234", 0, 7, 0), ("B", 1.0, None, 0, 9, 0), ("C", 1.0, "5", 2, 9, 0)]
    r = reconcile(tax(spark, t), led(spark, lg), CFG)
    p = {row["match_key"]: row for row in r.pairs.collect()}
    assert not p["A"]["customer_mismatch"] and not p["A"]["other_mismatch"]
    assert not p["B"]["customer_mismatch"]          # NULL vs NULL: both ''
    assert not p["B"]["other_mismatch"]             # unparsable never mismatches
    assert p["C"]["other_mismatch"] and p["C"]["invoice_mismatch"] and not p["C"]["branch_mismatch"]


def test_t8_t9_decimal_half_even_and_default(spark):
    df = spark.createDataFrame([("1.005",), ("1.015",), (" 12.345 ",), ("",), (None,), ("1,234.50",),
                                ("1e3",), ("999999999999999",)], "s string")
    v, w = X.to_decimal(F.col("s"))
    got = [(r[0], r[1]) for r in df.select(v, w).collect()]
    assert got[0] == (Decimal("1.00"), False)
    assert got[1] == (Decimal("1.02"), False)
    assert got[2] == (Decimal("12.34"), False)
    assert got[3] == (Decimal("0.00"), False) and got[4] == (Decimal("0.00"), False)
    assert got[5] == (Decimal("0.00"), True)
    assert got[6] == (Decimal("1000.00"), False)
    assert got[7] == (None, True)  # beyond decimal(14,2): flagged, never silently 0


def test_t10_date_formats_in_order(spark):
    df = spark.createDataFrame([("2025-01-05",), ("05/01/2025",), ("2025/01/05",), ("05-01-2025",),
                                ("2025-02-30",), ("2025-01-05 10:11:12",), ("",), ("junk",)], "s string")
    v, w = X.to_date_multi(F.col("s"))
    got = [(str(r[0]) if r[0] else None, r[1]) for r in df.select(v, w).collect()]
    assert [g[0] for g in got[:4]] == ["2025-01-05"] * 4
    assert got[4] == (None, True)
    assert got[5][0] == "2025-01-05"
    assert got[6] == (None, False)
    assert got[7] == (None, True)


def test_t11_t12_duplicates_and_null_keys(spark):
    t = [("A", "1", "1", "VALIDA", "2", "01", "0", "1"), ("A", "1", "1", "VALIDA", "2", "01", "0", "1"),
         (None, "5", "1", "VALIDA", "2", "01", "0", "1"), ("Z", "1", "1", "ANULADA", "2", "01", "0", "1")]
    lg = [("A", 1.0, "1", 0, 1, 0), ("A", 1.0, "1", 0, 1, 0), ("Q", 3.0, "1", 0, 1, 0)]
    s = stats(spark, t, lg)
    assert s["total_tax"] == 4                 # NULL-key row still counted
    assert s["merged_count"] == 4              # 2 x 2 pairs
    assert s["only_tax_count"] == 1 and s["only_tax_canceled_count"] == 1
    assert s["only_ledger_count"] == 1
    assert s["total_tax_amount"] == Decimal("7.0000")  # includes the NULL-key valid row (T13)
    assert s["total_ledger_amount"] == Decimal("2.0000")  # only ledger rows valid in tax


def test_t14_empty_tax_side_keeps_ledger_total(spark):
    s = stats(spark, [("A", "1", "1", "VALIDA", "3", "01", "0", "1")],  # filtered out by modality
              [("A", 4.0, "1", 0, 1, 0), ("B", 6.0, "1", 0, 2, 0)])
    assert s["total_tax"] == 0 and s["total_ledger_amount"] == Decimal("10.0000")


def test_t15_t16_gate_and_status(spark):
    t = [("A", "100", "1", "VALIDA", "2", "01", "0", "1"), ("B", "5", "1", "VALIDA", "2", "01", "0", "2")]
    lg = [("A", 100.0, "1", 0, 1, 0)]
    r = reconcile(tax(spark, t), led(spark, lg), CFG)
    g = r.gate().first()
    st = r.status().first()
    assert g["passed"] is False           # 5% total difference
    assert st["status"] == "CRITICAL" and st["status_reason"] == "valid_only_in_tax"
    empty = reconcile(tax(spark, t), led(spark, []), CFG).stats().first()
    assert empty["amount_difference_pct"] == 0.0  # empty ledger "passes" (parity)


def test_t2_t18_branch_keys(spark):
    df = spark.createDataFrame([("0", 1.0, "VALIDA"), ("0000", 2.0, "VALIDA"), ("5", 3.0, "ANULADA"),
                                ("x", 4.0, "VALIDA"), (None, 9.0, "VALIDA")], "b string, a double, s string")
    rows = {r["branch_code"]: r for r in
            branch_breakdown(df, "b", "a", is_canceled(F.col("s"))).collect()}
    assert rows["0"]["count"] == 2 and float(rows["0"]["amount"]) == 3.0
    assert rows["5"]["count"] == 0 and rows["5"]["canceled_count"] == 1   # only-canceled branch appears
    assert "unknown" in rows and None not in rows


def test_t19_glosa_oldest_wins_and_empty_is_null(spark):
    df = spark.createDataFrame([("A", "new", "2025-02-01", 2, 2), ("A", "old", "2025-01-01", 1, 1),
                                ("B", "", "2025-01-01", 1, 3), ("B", "later", "2025-03-01", 1, 4),
                                ("C", None, "2025-01-01", 1, 5)],
                               "cuf string, glosa string, fecha string, inv int, id int")
    got = {r[0]: r[1] for r in glosa_lookup(df, "cuf", "glosa", ("fecha", "inv", "id")).collect()}
    assert got == {"A": "old", "B": None}


def test_t23_t25_scalar_rules(spark):
    df = spark.createDataFrame([(None, "0000", "0000006737", None), (" ab-1.2 ", "0005", "000", "")],
                               "nit string, suc string, inv string, ctl string")
    nit, _ = X.clean_nit_text(F.col("nit"))
    inv, _ = X.normalize_invoice(F.col("inv"))
    rows = df.select(nit.alias("nit"), X.normalize_code(F.col("suc")).alias("suc"), inv.alias("inv"),
                     X.normalize_control(F.col("ctl")).alias("ctl")).collect()
    assert rows[0]["nit"] == "" and rows[0]["suc"] == "0" and rows[0]["inv"] == "6737" and rows[0]["ctl"] == "0"
    assert rows[1]["nit"] == "AB12" and rows[1]["suc"] == "5" and rows[1]["inv"] == "000"


@pytest.mark.parametrize("bad", ["cuf_missing"])
def test_p3_required_columns(spark, bad):
    with pytest.raises(ValueError):
        reconcile(spark.createDataFrame([(1,)], "x int"), led(spark, []), CFG)
