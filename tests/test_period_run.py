from concilia.config import LedgerColumns, ReconConfig, TaxColumns
from concilia.plans.period_run import run_period
from concilia.sinks.snapshot import committed_versions, read_current

TAX = TaxColumns(key="code", amount="amount", nit="nit", status="status", modality="mod", sector="sec",
                 branch="branch", invoice="inv")
LED = LedgerColumns(key="cuf", amount="total", nit="nit", branch="suc", invoice="inv", order=("inv",))
CFG = ReconConfig(tax=TAX, ledger=LED)
MAP = (("date", "invoice_date"), ("code", "authorization_code"), ("nit", "customer_nit"),
       ("name", "customer_name"), ("amount", "total_sale_amount"), ("status", "status"),
       ("inv", "invoice_number"), ("branch", "branch_office"), ("sec", "sector"), ("mod", "modality"))


def _frames(spark, amounts=(100.0, 50.0)):
    tax = spark.createDataFrame(
        [("A", "2025-01-02", "1", "ACME", str(amounts[0]), "VALIDA", "0000000001", "0000", "01", "2"),
         ("B", "2025-01-03", "2", "FOO", str(amounts[1]), "VALIDA", "0000000002", "0000", "01", "2")],
        "code string, date string, nit string, name string, amount string, status string, inv string, "
        "branch string, sec string, mod string")
    led = spark.createDataFrame([("A", 100.0, "1", 0, 1, None), ("B", 50.0, "2", 0, 2, "nota")],
                                "cuf string, total double, nit string, suc int, inv bigint, glosa string")
    return tax, led


def test_period_run_dry_then_load(spark, scratch):
    tax, led = _frames(spark)
    res = run_period(tax, led, CFG, MAP, target_root=f"{scratch}/reg", report_root=f"{scratch}/rep")
    assert res.passed and res.status["status"] == "PERFECT" and not res.issues
    assert res.load["exact_inserts"] == 2 and "summary" in res.report_sheets
    res = run_period(tax, led, CFG, MAP, target_root=f"{scratch}/reg", load=True)
    assert res.synced and res.load["insert"] == 2
    assert committed_versions(spark, f"{scratch}/reg") == [1]
    row = {r["authorization_code"]: r for r in read_current(spark, f"{scratch}/reg").collect()}["B"]
    assert row["invoice_number"] == "2"


def test_gate_blocks_load(spark, scratch):
    tax, led = _frames(spark, amounts=(130.0, 50.0))
    res = run_period(tax, led, CFG, MAP, target_root=f"{scratch}/reg", load=True)
    assert not res.passed and not res.synced and res.status["status"] == "CRITICAL"


def test_statistics_are_computed_once(spark, scratch, monkeypatch):
    from concilia.plans import reconciliation as R

    calls = []
    original = R.reconcile_stats
    monkeypatch.setattr(R, "reconcile_stats", lambda r: calls.append(1) or original(r))
    tax, led = _frames(spark)
    res = run_period(tax, led, CFG, MAP, target_root=f"{scratch}/reg", report_root=f"{scratch}/rep", load=True)
    assert len(calls) == 1 and res.load == {"insert": 2, "update": 0, "keep": 0, "rows_written": 2}
    res = run_period(tax, led, CFG, MAP, target_root=f"{scratch}/reg", load=True)
    assert res.load == {"insert": 0, "update": 2, "keep": 0, "rows_written": 2}
    want = R.reconcile(tax, led, CFG).stats().first().asDict()
    assert res.stats == want
