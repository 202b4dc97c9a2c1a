import os

from concilia.config import LedgerColumns, ReconConfig, TaxColumns
from concilia.plans.reconciliation import reconcile
from concilia.sinks.report import formatted_summary, summary_table, write_csv, write_report

TAX = TaxColumns(key="k", amount="a", nit="n", status="st", modality="m", sector="s", branch="b", invoice="i")
LED = LedgerColumns(key="k", amount="a", nit="n", branch="b", invoice="i", order=("i",))


def _recon(spark):
    tax = spark.createDataFrame([("A", "1000.5", "1", "VALIDA", "2", "01", "0", "1"),
                                 ("B", "20", "2", "ANULADA", "2", "01", "5", "2")],
                                "k string, a string, n string, st string, m string, s string, b string, i string")
    led = spark.createDataFrame([("A", 1000.5, "1", 0, 1), ("C", 3.0, "9", 6, 3)],
                                "k string, a double, n string, b int, i bigint")
    return reconcile(tax, led, ReconConfig(tax=TAX, ledger=LED))


def test_summary_sheet_and_formatting(spark):
    s = {r["metric"]: r["value"] for r in summary_table(_recon(spark).stats()).collect()}
    assert s["tax rows compared"] == 2 and s["rows in ledger only"] == 1 and s["pairs without a difference"] == 1
    txt = {r["metric"]: r["text"] for r in formatted_summary(summary_table(_recon(spark).stats())).collect()}
    assert txt["valid tax amount"] == "1,000.50" and txt["tax rows compared"] == "2"
    assert txt["match rate, percent"] == "50.00" and txt["difference of amounts, percent"] == "0.0000"


def test_write_report_skips_empty_sheets(spark, scratch):
    root = os.path.join(scratch, "report")
    written = write_report(_recon(spark), root)
    assert "summary" in written and "branch_breakdown" in written and "only_in_ledger" in written
    assert "amount_mismatches" not in written  # empty sheet omitted
    assert spark.read.parquet(os.path.join(root, "report=summary")).count() == 14
    write_csv(spark.read.parquet(os.path.join(root, "report=summary")), os.path.join(scratch, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(scratch, "csv"))
    assert back.count() == 14 and "metric" in back.columns


def test_second_run_leaves_no_old_rows(spark, scratch):
    root = os.path.join(scratch, "report")
    assert "only_in_ledger" in write_report(_recon(spark), root)
    r = _recon(spark)
    again = reconcile(r.tax, r.ledger.filter("k = 'A'"), r.cfg)
    assert "only_in_ledger" not in write_report(again, root)
    assert spark.read.schema(again.only_ledger.schema).parquet(os.path.join(root, "report=only_in_ledger")).isEmpty()


def test_row_sheets(spark):
    from concilia.sinks.report import sheet_rows

    got = sorted((x.report, x.match_key) for x in sheet_rows(_recon(spark)).collect())
    assert got == [("only_in_ledger", "C"), ("only_in_tax", "B"), ("perfect_matches", "A")]


def test_counts_of_sheets_are_observed(spark, scratch):
    root = os.path.join(scratch, "counted")
    written = write_report(_recon(spark), root)
    assert written == ["summary", "branch_breakdown", "only_in_tax", "only_in_ledger", "perfect_matches"]
    assert "tax_n" in spark.read.parquet(os.path.join(root, "report=only_in_tax")).columns
    written = write_report(_recon(spark), os.path.join(scratch, "as_csv"), fmt="csv")
    assert spark.read.option("header", True).csv(os.path.join(scratch, "as_csv", "report=only_in_ledger")).first()["inv_k"] == "C"
