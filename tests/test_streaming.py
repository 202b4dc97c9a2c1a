import os

from concilia.sinks.snapshot import committed_versions, read_current
from concilia.streaming.loader import load_stream

HEADER = ["CODIGO DE AUTORIZACIÓN", "FECHA DE LA FACTURA", "NIT / CI CLIENTE", "COMPLEMENTO", "ESTADO",
          "TIPO DE VENTA", "NOMBRE O RAZON SOCIAL", "IMPORTE TOTAL DE LA VENTA"]


def _write(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(HEADER) + "\n" + "\n".join(rows) + "\n")


def test_stream_loads_and_replays_idempotently(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    target = os.path.join(scratch, "register")
    _write(os.path.join(src, "a.csv"), ["A1,2025-01-02,100,,VALIDA,X,ACME,10.50",
                                        "B2,03/01/2025,101,,VALIDA,X,FOO, S.R.L.,20.00"])
    q = load_stream(spark, src, target, HEADER, name="t1")
    q.awaitTermination(120)
    assert committed_versions(spark, target) == [1]
    _write(os.path.join(src, "b.csv"), ["B2,03/01/2025,101,,VALIDA,X,FOO, S.R.L.,25.00"])
    q = load_stream(spark, src, target, HEADER, name="t1")
    q.awaitTermination(120)
    cur = {r["authorization_code"]: r for r in read_current(spark, target).collect()}
    assert len(cur) == 2 and float(cur["B2"]["total_sale_amount"]) == 25.0
    assert cur["B2"]["customer_name"] == "FOO, S.R.L."
