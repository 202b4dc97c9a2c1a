"""DuckDB text of the derived views (same rules as ``fixtures/views.py``).

``with_views(body, *names)`` prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim(CAST({x} AS VARCHAR), {WS})"


def canceled(x: str) -> str:
    return f"(coalesce(upper({strip(x)}), '') <> 'VALIDA')"


def as_double(x: str) -> str:
    return f"try_cast({strip(x)} AS DOUBLE)"


def as_int(x: str) -> str:
    return f"CAST(trunc({as_double(x)}) AS BIGINT)"


def clean_nit(x: str) -> str:
    return (f"replace(replace(replace(upper({strip(f'coalesce(CAST({x} AS VARCHAR), {chr(39)}{chr(39)})')}),"
            " ' ', ''), '-', ''), '.', '')")


def code(k: str) -> str:
    return (f"substr(md5('a' || CAST({k} AS VARCHAR)) || md5('b' || CAST({k} AS VARCHAR)), 1, 42)")


ORDER_STAR = """order_star AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate,
         c.c_custkey, c.c_name, c.c_nationkey, n.n_regionkey
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

TAX_BASE = f"""tax_base AS (
  SELECT o_orderkey AS nro,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {code('o_orderkey')} END AS cuf,
    CAST(o_orderdate AS DATE) AS fecha,
    CAST(c_custkey AS VARCHAR) AS nit,
    c_name AS nombre,
    o_totalprice AS importe,
    CASE WHEN o_orderstatus = 'F' THEN 'ANULADA' WHEN o_orderkey % 11 = 0 THEN ' valida ' ELSE 'VALIDA' END AS estado,
    CASE WHEN o_orderkey % 50 = 0 THEN '3' ELSE '2' END AS modalidad,
    CASE WHEN o_orderkey % 50 = 1 THEN '02' WHEN o_orderkey % 50 = 2 THEN '35'
         WHEN o_orderkey % 50 = 3 THEN NULL ELSE '01' END AS sector,
    lpad(CAST(n_regionkey AS VARCHAR), 4, '0') AS sucursal,
    CASE WHEN o_orderkey % 71 = 0 THEN '0000000000' ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS num_factura,
    CASE WHEN o_orderkey % 89 = 0 THEN 'sin fecha'
         WHEN o_orderkey % 4 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')
         WHEN o_orderkey % 4 = 1 THEN strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y')
         WHEN o_orderkey % 4 = 2 THEN strftime(CAST(o_orderdate AS DATE), '%Y/%m/%d')
         ELSE strftime(CAST(o_orderdate AS DATE), '%d-%m-%Y') END AS fecha_txt,
    CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN 'n/a'
         WHEN o_orderkey % 61 = 0 THEN ' 12.345 '
         ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) END AS importe_txt,
    CASE WHEN o_orderkey % 10 = 0 THEN '0' ELSE CAST(o_orderkey % 997 AS VARCHAR) || '.50' END AS debito_txt,
    CASE WHEN o_orderkey % 9 = 0 THEN '1A' ELSE NULL END AS complemento,
    CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL
         ELSE 'C-' || CAST(o_orderkey AS VARCHAR) END AS control,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'OTROS' END AS tipo_venta,
    CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'CONSOLIDADO' END AS consolidacion,
    '1' AS tipo_emision,
    '1' AS tipo_factura
  FROM order_star
)"""

V_TAX = """v_tax AS (
  SELECT * FROM tax_base UNION ALL SELECT * FROM tax_base WHERE nro % 501 = 0
)"""


def _ledger_select(cuf: str, idf: str, where: str) -> str:
    nit = "CAST(c_custkey AS VARCHAR)"
    return f"""SELECT {cuf} AS cuf, {idf} AS id_factura, o_orderkey AS numero_factura,
    CAST(o_orderdate AS DATE) AS fecha_fac,
    CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN o_totalprice + 1
         WHEN o_orderkey % 19 = 0 THEN o_totalprice + 0.005 ELSE o_totalprice END AS total,
    CASE WHEN o_orderkey % 37 = 0 THEN 'Z9'
         WHEN o_orderkey % 13 = 0 THEN ' ' || substr({nit}, 1, 1) || '-' || substr({nit}, 2)
         ELSE {nit} END AS cliente_nit,
    n_regionkey + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS codigo_sucursal,
    CASE WHEN o_orderkey % 5 = 0 THEN 'nota ' || CAST(o_orderkey AS VARCHAR)
         WHEN o_orderkey % 5 = 1 THEN '' ELSE NULL END AS glosa,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS estado
  FROM order_star WHERE {where}"""


V_LEDGER = f"""v_ledger AS (
  {_ledger_select(code('o_orderkey'), 'o_orderkey * 2', 'o_orderkey % 17 <> 0')}
  UNION ALL
  {_ledger_select("'X' || CAST(o_orderkey AS VARCHAR)", 'o_orderkey * 2 + 1', 'o_orderkey % 31 = 0')}
)"""

# Filtered tax register as reconciled (modality 2, sector not 02).
TAX_F = """tax_f AS (
  SELECT * FROM v_tax WHERE modalidad = '2' AND sector IS DISTINCT FROM '02'
)"""

VIEWS = {
    "order_star": (ORDER_STAR, ()),
    "tax_base": (TAX_BASE, ("order_star",)),
    "v_tax": (V_TAX, ("tax_base",)),
    "v_ledger": (V_LEDGER, ("order_star",)),
    "tax_f": (TAX_F, ("v_tax",)),
}


def register_view(name: str, text: str, deps: tuple = ()) -> None:
    VIEWS[name] = (text, tuple(deps))


def with_views(body: str, *names: str, ctes: tuple = ()) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (dependencies first),
    followed by the query's own ``ctes``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [VIEWS[n][0] for n in order] + list(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body
