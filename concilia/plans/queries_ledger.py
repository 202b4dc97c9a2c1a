"""Registered ledger-extract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import present, register
from ..fixtures.star import STAR_SQL, extract_sql, star
from ..fixtures.views import Tables
from ..operators.audit import ledger_summary
from ..operators.filters import resolve_period
from ..operators.ledger import extract_ledger

MONTH = resolve_period(1998, "noviembre")
ALL = ("1990-01-01", "2030-12-31")
COLS = ("codigoSucursal", "codigoPuntoVenta", "idFactura", "lote", "manual", "numeroFactura", "fechaFac",
        "ClienteNit", "emailCliente", "ClienteFactura", "sigla", "total", "vendedor", "estado", "fecha",
        "glosa", "idPago", "numPago", "pagada", "idAlmacen", "pedido_cliente", "moneda", "pagadaF", "emisor",
        "tipoPago", "codigoRecepcion", "cuf", "cafc", "pedido_siat", "metodoPago", "leyenda",
        "fechaEmisionSiat", "almacen")


def _sql_cols(alias: str = "x") -> str:
    out = []
    for c in COLS:
        if c == "fechaFac":
            out.append(f"strftime({alias}.{c}, '%Y-%m-%d') AS {c}")
        elif c in ("fecha", "fechaEmisionSiat"):
            out.append(f"strftime({alias}.{c}, '%Y-%m-%d %H:%M:%S') AS {c}")
        elif c in ("codigoSucursal", "codigoPuntoVenta", "lote", "manual", "estado", "pagada", "idAlmacen",
                   "numPago"):
            out.append(f"CAST({alias}.{c} AS BIGINT) AS {c}")
        else:
            out.append(f"{alias}.{c}")
    return ", ".join(out)


def _with_star(body: str) -> str:
    return f"WITH {STAR_SQL}\n{body}"


@register("ledger_extract", _with_star(f"SELECT {_sql_cols()} FROM ({extract_sql(*MONTH)}) x"))
def q_ledger_extract(spark, sf_dir):
    return present(extract_ledger(star(Tables(spark, sf_dir)), *MONTH).select(*COLS))


@register("ledger_extract_all", _with_star(f"SELECT {_sql_cols()} FROM ({extract_sql(*ALL)}) x"))
def q_ledger_extract_all(spark, sf_dir):
    return present(extract_ledger(star(Tables(spark, sf_dir)), *ALL, order=False).select(*COLS))


@register("ledger_labels", _with_star(
    f"SELECT idFactura, moneda, pagadaF, vendedor, emisor FROM ({extract_sql(*ALL)}) x"))
def q_ledger_labels(spark, sf_dir):
    return extract_ledger(star(Tables(spark, sf_dir)), *ALL, order=False) \
        .select("idFactura", "moneda", "pagadaF", "vendedor", "emisor")


@register("composite_join", _with_star(
    """SELECT fs.factura_id, CAST(fs.codigoSucursal AS BIGINT) AS codigoSucursal,
      CAST(fs.codigoPuntoVenta AS BIGINT) AS codigoPuntoVenta
    FROM factura_siat fs JOIN siat_cuis cuis ON cuis.sucursal = fs.codigoSucursal
      AND cuis.codigoPuntoVenta = fs.codigoPuntoVenta AND cuis.active = 1"""))
def q_composite_join(spark, sf_dir):
    s = star(Tables(spark, sf_dir))
    fs, cuis = s["factura_siat"].alias("fs"), s["siat_cuis"].alias("cuis")
    on = ((F.col("cuis.sucursal") == F.col("fs.codigoSucursal"))
          & (F.col("cuis.codigoPuntoVenta") == F.col("fs.codigoPuntoVenta"))
          & (F.col("cuis.active") == 1))
    j = fs.join(cuis, on)
    return present(j.select("fs.factura_id", "fs.codigoSucursal", "fs.codigoPuntoVenta"))


@register("dedup_invoice", _with_star(
    """SELECT fe.idFactura, count(*) AS joined_rows,
      arg_min(e.idegresos, {'d': e.idegresos, 'p': p.idPago}) AS idegresos,
      arg_min(p.idPago, {'d': e.idegresos, 'p': p.idPago}) AS idPago
    FROM factura_egresos fe JOIN egresos e ON e.idegresos = fe.idegresos
      LEFT JOIN pago_factura pf ON fe.idFactura = pf.idFactura LEFT JOIN pago p ON p.idPago = pf.idPago
    GROUP BY fe.idFactura"""))
def q_dedup_invoice(spark, sf_dir):
    from ..operators.ledger import pick_one_per_invoice
    s = star(Tables(spark, sf_dir))
    return pick_one_per_invoice(s)


@register("ledger_summary", _with_star(
    f"""SELECT count(DISTINCT numeroFactura) AS distinct_invoices,
      CAST(round(coalesce(sum(CAST(total AS DECIMAL(24,4))), 0), 2) AS DOUBLE) AS total_amount,
      count(cuf) AS rows_with_key, count(*) AS rows FROM ({extract_sql(*ALL)}) x"""))
def q_ledger_summary(spark, sf_dir):
    led = extract_ledger(star(Tables(spark, sf_dir)), *ALL, order=False)
    return present(ledger_summary(led, "numeroFactura", "total", "cuf"))

