"""The default configuration on the export's real headers, end to end:
CSV (with an unquoted comma in a company name) -> repair -> decode ->
reconcile -> map -> validate -> load."""

import os

from concilia.config import ReconConfig
from concilia.functions.cuf import decode_codes
from concilia.plans.period_run import run_period
from concilia.sinks.snapshot import read_current
from concilia.sources.registers import read_register

HEADER = ["NRO.", "FECHA DE LA FACTURA", "Nro. DE LA FACTURA", "CODIGO DE AUTORIZACIÓN", "NIT / CI CLIENTE",
          "COMPLEMENTO", "NOMBRE O RAZON SOCIAL", "IMPORTE TOTAL DE LA VENTA", "IMPORTE ICE", "IMPORTE IEHD",
          "IMPORTE IPJ", "TASAS", "OTROS NO SUJETOS AL IVA", "EXPORTACIONES Y OPERACIONES EXENTAS",
          "VENTAS GRAVADAS A TASA CERO", "SUBTOTAL", "DESCUENTOS BONIFICACIONES Y REBAJAS SUJETAS AL IVA",
          "IMPORTE GIFT CARD", "IMPORTE BASE PARA DEBITO FISCAL", "DEBITO FISCAL", "ESTADO", "CODIGO DE CONTROL",
          "TIPO DE VENTA", "ESTADO CONSOLIDACION"]
# the first 42 hex characters decode to branch 0000, modality 2, sector 01,
# invoice 0000009587; what follows them only makes the codes distinct
CODE = "447D97004336A8D7C85C2495A6D872EA2398A919E1"


def _line(nro, code, name, amount, status="VALIDA"):
    amounts = [amount, "0", "0", "0", "0", "0", "0", "0", amount, "0", "0", amount, "13.00"]
    return ",".join([str(nro), "15/11/2025", "9587", code, "1234567", "", name, *amounts, status, "", "", ""])


def test_export_to_register(spark, scratch):
    src = os.path.join(scratch, "export")
    os.makedirs(src)
    lines = [_line(1, CODE + "AA", "ACME S.A.", "100.00"),
             _line(2, CODE + "BB", "FOO, BAR Y CIA", "50.00"),      # repaired: extra comma in the name
             _line(3, CODE + "CC", "BAZ", "10.00", "ANULADA")]
    with open(os.path.join(src, "ventas.csv"), "w", encoding="utf-8") as f:
        f.write(",".join(HEADER) + "\n" + "\n".join(lines) + "\n")
    tax = decode_codes(read_register(spark, src), "CODIGO DE AUTORIZACIÓN")
    ledger = spark.createDataFrame(
        [(CODE + "AA", 100.0, "1234567", 0, 9587, "2025-11-15", 1, "nota"),
         (CODE + "BB", 50.0, "1234567", 0, 9587, "2025-11-15", 2, None)],
        "cuf string, total double, ClienteNit string, codigoSucursal int, numeroFactura bigint, "
        "fechaFac string, idFactura bigint, glosa string")
    root = os.path.join(scratch, "register")
    res = run_period(tax, ledger, ReconConfig(), target_root=root, load=True, order_by="NRO.")
    assert res.stats["total_tax"] == 3 and res.stats["matched_count"] == 2
    assert res.stats["only_tax_canceled_count"] == 1 and res.status["status"] == "ACCEPTABLE"
    assert res.synced and not res.issues
    rows = {r["authorization_code"]: r for r in read_current(spark, root).collect()}
    b = rows[CODE + "BB"]
    assert b["customer_name"] == "FOO, BAR Y CIA" and b["invoice_number"] == "9587"
    assert (b["branch_office"], b["modality"], b["sector"]) == ("0", "2", "1")
    assert str(b["invoice_date"]) == "2025-11-15" and float(b["debit_tax"]) == 13.0
    assert rows[CODE + "AA"]["right_to_tax_credit"] == 1
    assert rows[CODE + "CC"]["observations"] == "No existe en inventarios"
