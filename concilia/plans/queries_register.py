"""Registered accounting-register queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import present, register
from ..config import DECIMAL_TARGETS, OBS_DOLLAR, OBS_NOT_IN_LEDGER, OBS_RENTAL, REGISTER_COLUMN_MAP
from ..fixtures import sql as S
from ..fixtures.views import FIXTURE_REGISTER_MAP, Tables, v_ledger, v_tax
from ..functions import text as X
from ..operators import register as R
from .queries_core import CFG, LK, TAX_TAG, run


def mapped(spark, sf_dir, with_lookups: bool = True):
    t = Tables(spark, sf_dir)
    tax = v_tax(t)
    if not with_lookups:
        return R.map_register(tax, FIXTURE_REGISTER_MAP, keep=("nro",))
    r = run(spark, sf_dir)
    return R.map_register(tax, FIXTURE_REGISTER_MAP, only_tax=r.only_tax, only_tax_key="cuf",
                          ledger=r.ledger, ledger_order=CFG.ledger.order, keep=("nro",))


# ---- SQL mirrors of the scalar rules ----------------------------------------
def blank(x):
    return f"({x} IS NULL OR CAST({x} AS VARCHAR) = '')"


def sql_decimal(x):
    p = f"try_cast({S.strip(x)} AS DECIMAL(38,10))"
    return (f"CASE WHEN {blank(x)} THEN CAST(0 AS DECIMAL(14,2)) WHEN {p} IS NULL THEN CAST(0 AS DECIMAL(14,2)) "
            f"ELSE try_cast(round_even({p}, 2) AS DECIMAL(14,2)) END")


def sql_decimal_warn(x):
    p = f"try_cast({S.strip(x)} AS DECIMAL(38,10))"
    return f"(NOT {blank(x)} AND ({p} IS NULL OR try_cast(round_even({p}, 2) AS DECIMAL(14,2)) IS NULL))"


def sql_date(x):
    fmts = ("%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y")
    tries = ", ".join(f"CAST(try_strptime({x}, '{f}') AS DATE)" for f in fmts)
    return f"CASE WHEN {blank(x)} THEN NULL ELSE coalesce({tries}, CAST(try_cast({x} AS TIMESTAMP) AS DATE)) END"


def sql_trunc(x, n):
    return f"CASE WHEN {blank(x)} THEN NULL ELSE nullif(left({S.strip(x)}, {n}), '') END"


def sql_trunc_warn(x, n):
    return f"(NOT {blank(x)} AND length({S.strip(x)}) > {n})"


def _nit_raw(x):
    return f"replace(replace(replace(upper({S.strip(x)}), ' ', ''), '-', ''), '.', '')"


def sql_nit(x, n=15):
    return f"CASE WHEN {blank(x)} THEN '' ELSE left({_nit_raw(x)}, {n}) END"


def sql_nit_warn(x, n=15):
    return f"(NOT {blank(x)} AND length({_nit_raw(x)}) > {n})"


def _z(x):
    return f"regexp_replace({S.strip(x)}, '^0+', '')"


def sql_invoice(x, n=15):
    return f"CASE WHEN {blank(x)} THEN '' WHEN {_z(x)} = '' THEN {S.strip(x)} ELSE left({_z(x)}, {n}) END"


def sql_invoice_warn(x, n=15):
    return f"(NOT {blank(x)} AND {_z(x)} <> '' AND length({_z(x)}) > {n})"


def sql_control(x):
    return f"CASE WHEN {blank(x)} THEN '0' ELSE {S.strip(x)} END"


def sql_code(x):
    return f"CASE WHEN {blank(x)} THEN '' WHEN {_z(x)} = '' THEN '0' ELSE {_z(x)} END"


def _i(flag):
    return f"CASE WHEN {flag} THEN 1 ELSE 0 END"


MAPPED_SQL = f"""mapped AS (SELECT nro,
  {sql_date('fecha_txt')} AS invoice_date,
  {sql_trunc('cuf', 64)} AS authorization_code,
  {sql_nit('nit')} AS customer_nit,
  {sql_trunc('complemento', 5)} AS complement,
  {sql_trunc('nombre', 240)} AS customer_name,
  {sql_decimal('importe_txt')} AS total_sale_amount,
  {sql_decimal('debito_txt')} AS debit_tax,
  coalesce(estado, '') AS status,
  {sql_control('control')} AS control_code,
  coalesce(tipo_venta, '') AS sale_type,
  coalesce(consolidacion, '') AS consolidation_status,
  {sql_invoice('num_factura')} AS invoice_number,
  {sql_code('sucursal')} AS branch_office,
  {sql_trunc('modalidad', 10)} AS modality,
  {sql_trunc('tipo_emision', 10)} AS emission_type,
  {sql_trunc('tipo_factura', 10)} AS invoice_type,
  {sql_code('sector')} AS sector,
  {S.strip('sector')} AS sector_raw, cuf,
  {' + '.join(_i(w) for w in (
      f"(NOT {blank('fecha_txt')} AND ({sql_date('fecha_txt')}) IS NULL)",
      sql_trunc_warn('cuf', 64), sql_nit_warn('nit'), sql_trunc_warn('complemento', 5),
      sql_trunc_warn('nombre', 240), sql_decimal_warn('importe_txt'), sql_decimal_warn('debito_txt'),
      sql_invoice_warn('num_factura'), sql_trunc_warn('modalidad', 10), sql_trunc_warn('tipo_emision', 10),
      sql_trunc_warn('tipo_factura', 10)))} AS warnings
FROM v_tax)"""

GLOSA_SQL = """glosa AS (SELECT cuf AS authorization_code,
  nullif(arg_min(CAST(glosa AS VARCHAR), {'a': fecha_fac, 'b': numero_factura, 'c': id_factura}), '') AS obs
  FROM v_ledger WHERE cuf IS NOT NULL AND glosa IS NOT NULL GROUP BY cuf)"""

TARGETS = ("invoice_date", "authorization_code", "customer_nit", "complement", "customer_name",
           "total_sale_amount", "debit_tax", "status", "control_code", "sale_type",
           "consolidation_status", "invoice_number", "branch_office", "modality", "emission_type",
           "invoice_type", "sector")


def _present_sql(cols):
    out = []
    for c in cols:
        if c == "invoice_date":
            out.append("strftime(invoice_date, '%Y-%m-%d') AS invoice_date")
        elif c in ("total_sale_amount", "debit_tax"):
            out.append(f"CAST(round({c}, 2) AS DOUBLE) AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


@register("register_map", S.with_views(
    f"""SELECT nro, {_present_sql(TARGETS)},
      CASE WHEN debit_tax > 0 THEN 1 ELSE 0 END AS right_to_tax_credit, 'concilia' AS author, warnings
    FROM mapped""", "v_tax", ctes=(MAPPED_SQL,)))
def q_register_map(spark, sf_dir):
    m = mapped(spark, sf_dir, with_lookups=False)
    return present(m.select("nro", *TARGETS, "right_to_tax_credit", "author", "warnings"))


@register("observations", S.with_views(
    f"""SELECT m.nro, m.authorization_code,
      CASE WHEN m.sector_raw = '02' THEN '{OBS_RENTAL}' WHEN m.sector_raw = '35' THEN '{OBS_DOLLAR}'
           WHEN ot.cuf IS NOT NULL THEN '{OBS_NOT_IN_LEDGER}' END AS observations, g.obs
    FROM mapped m
    LEFT JOIN (SELECT DISTINCT cuf FROM tax_tag WHERE n_ledger = 0) ot ON m.cuf = ot.cuf
    LEFT JOIN glosa g ON m.cuf = g.authorization_code""",
    "v_tax", "tax_f", "v_ledger", ctes=(MAPPED_SQL, LK, TAX_TAG, GLOSA_SQL)))
def q_observations(spark, sf_dir):
    return mapped(spark, sf_dir).select("nro", "authorization_code", "observations", "obs")


@register("glosa_lookup", S.with_views("SELECT authorization_code, obs FROM glosa", "v_ledger",
                                       ctes=(GLOSA_SQL,)))
def q_glosa_lookup(spark, sf_dir):
    return R.glosa_lookup(v_ledger(Tables(spark, sf_dir)), "cuf", "glosa", CFG.ledger.order)


@register("to_decimal", S.with_views(
    f"""SELECT nro, importe_txt, CAST(round({sql_decimal('importe_txt')}, 2) AS DOUBLE) AS amount,
      {sql_decimal_warn('importe_txt')} AS warning FROM v_tax""", "v_tax"))
def q_to_decimal(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir))
    v, w = X.to_decimal(F.col("importe_txt"))
    return present(tax.select("nro", "importe_txt", v.alias("amount"), w.alias("warning")))


@register("to_date_multi", S.with_views(
    f"""SELECT nro, fecha_txt, strftime({sql_date('fecha_txt')}, '%Y-%m-%d') AS invoice_date,
      (NOT {blank('fecha_txt')} AND ({sql_date('fecha_txt')}) IS NULL) AS warning FROM v_tax""", "v_tax"))
def q_to_date_multi(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir))
    v, w = X.to_date_multi(F.col("fecha_txt"))
    return present(tax.select("nro", "fecha_txt", v.alias("invoice_date"), w.alias("warning")))


@register("truncate", f"""SELECT doc_id, length(text) AS n_chars_whole, {sql_trunc('text', 240)} AS truncated,
    {sql_trunc_warn('text', 240)} AS was_cut FROM documents""")
def q_truncate(spark, sf_dir):
    docs = Tables(spark, sf_dir)["documents"]
    v, w = X.truncate(F.col("text"), 240)
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars_whole"),
                       v.alias("truncated"), w.alias("was_cut"))


@register("clean_nit", S.with_views(
    f"SELECT id_factura, cliente_nit, {sql_nit('cliente_nit')} AS customer_nit, "
    f"{sql_nit_warn('cliente_nit')} AS warning FROM v_ledger", "v_ledger"))
def q_clean_nit(spark, sf_dir):
    led = v_ledger(Tables(spark, sf_dir))
    v, w = X.clean_nit_text(F.col("cliente_nit"), 15)
    return led.select("id_factura", "cliente_nit", v.alias("customer_nit"), w.alias("warning"))


@register("norm_invoice", S.with_views(
    f"SELECT nro, num_factura, {sql_invoice('num_factura')} AS invoice_number FROM v_tax", "v_tax"))
def q_norm_invoice(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir))
    return tax.select("nro", "num_factura", X.normalize_invoice(F.col("num_factura"))[0].alias("invoice_number"))


@register("norm_control", S.with_views(
    f"SELECT nro, control, {sql_control('control')} AS control_code FROM v_tax", "v_tax"))
def q_norm_control(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir))
    return tax.select("nro", "control", X.normalize_control(F.col("control")).alias("control_code"))


@register("norm_branch", S.with_views(
    f"SELECT nro, sucursal, sector, {sql_code('sucursal')} AS branch_office, {sql_code('sector')} AS sector_code "
    "FROM v_tax", "v_tax"))
def q_norm_branch(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir))
    return tax.select("nro", "sucursal", "sector", X.normalize_code(F.col("sucursal")).alias("branch_office"),
                      X.normalize_code(F.col("sector")).alias("sector_code"))


def _validate_sql():
    rules = [("not_null", c, f"{c} IS NULL") for c in
             ("invoice_date", "invoice_number", "authorization_code", "customer_nit", "customer_name",
              "total_sale_amount")]
    rules += [("max_length", c, f"length(coalesce(CAST({c} AS VARCHAR), 'None')) > {n}") for c, n in
              (("authorization_code", 64), ("customer_nit", 15), ("customer_name", 240), ("invoice_number", 15))]
    parts = [f"SELECT '{r}' AS rule, '{c}' AS column, count(*) FILTER (WHERE {cond}) AS n_rows FROM mapped"
             for r, c, cond in rules]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_rows > 0"


@register("register_validate", S.with_views(_validate_sql(), "v_tax", ctes=(MAPPED_SQL,)))
def q_register_validate(spark, sf_dir):
    return R.validate_register(mapped(spark, sf_dir, with_lookups=False))


@register("transform_stats", S.with_views(
    "SELECT count(*) AS total_rows, count(*) AS successful, CAST(0 AS BIGINT) AS errors, "
    "CAST(coalesce(sum(warnings), 0) AS BIGINT) AS warnings FROM mapped", "v_tax", ctes=(MAPPED_SQL,)))
def q_transform_stats(spark, sf_dir):
    return R.transform_stats(mapped(spark, sf_dir, with_lookups=False))


# ---- all amounts of the export (P2, A16): blank, unparsable, too large, padded, three decimals ----
AMOUNTS = tuple((header, target) for header, target in REGISTER_COLUMN_MAP if target in DECIMAL_TARGETS)
#: v_tax column behind the export headers that the wide register also has.
WIDE = (("fecha_txt", "FECHA DE LA FACTURA"), ("cuf", "CODIGO DE AUTORIZACIÓN"), ("nit", "NIT / CI CLIENTE"),
        ("nombre", "NOMBRE O RAZON SOCIAL"), ("num_factura", "NUM FACTURA"))
TOO_LARGE = "99999999999999.99"


def _amount_text(j: int):
    k = F.col("nro")
    plain = F.concat((k * j % 99991).cast("string"), F.lit("."), F.lpad((k * (j + 3) % 1000).cast("string"), 3, "0"))
    return (F.when(k % (60 + j) == 0, "").when(k % (70 + j) == 0, "n/a").when(k % (200 + j) == 0, TOO_LARGE)
             .when(k % (80 + j) == 0, F.concat(F.lit(" "), plain, F.lit(" "))).otherwise(plain))


def _amount_sql(j: int) -> str:
    plain = f"CAST(nro * {j} % 99991 AS VARCHAR) || '.' || lpad(CAST(nro * {j + 3} % 1000 AS VARCHAR), 3, '0')"
    return (f"CASE WHEN nro % {60 + j} = 0 THEN '' WHEN nro % {70 + j} = 0 THEN 'n/a' WHEN nro % {200 + j} = 0 THEN '{TOO_LARGE}' "
            f"WHEN nro % {80 + j} = 0 THEN ' ' || {plain} || ' ' ELSE {plain} END")


def wide_tax(spark, sf_dir):
    """The tax register under its export headers, with all thirteen amounts as text."""
    tax = v_tax(Tables(spark, sf_dir))
    return tax.select("nro", *[F.col(c).alias(h) for c, h in WIDE],
                      *[_amount_text(j).alias(h) for j, (h, _) in enumerate(AMOUNTS, 1)])


WIDE_SQL = "wide AS (SELECT nro, fecha_txt, cuf, nit, nombre, num_factura, " + ", ".join(
    f"{_amount_sql(j)} AS t_{t}" for j, (_, t) in enumerate(AMOUNTS, 1)) + " FROM v_tax)"
WIDE_MAPPED_SQL = f"""wide_mapped AS (SELECT nro, {sql_date('fecha_txt')} AS invoice_date, {sql_trunc('cuf', 64)} AS authorization_code,
  {sql_nit('nit')} AS customer_nit, {sql_trunc('nombre', 240)} AS customer_name, {sql_invoice('num_factura')} AS invoice_number,
  {', '.join(f"{sql_decimal(f't_{t}')} AS {t}" for _, t in AMOUNTS)},
  {' + '.join(_i(w) for w in (
      f"(NOT {blank('fecha_txt')} AND ({sql_date('fecha_txt')}) IS NULL)", sql_trunc_warn('cuf', 64), sql_nit_warn('nit'),
      sql_trunc_warn('nombre', 240), sql_invoice_warn('num_factura'), *[sql_decimal_warn(f't_{t}') for _, t in AMOUNTS]))} AS warnings
FROM wide)"""


@register("register_amounts", S.with_views(
    f"""SELECT nro, {', '.join(f'CAST(round({t}, 2) AS DOUBLE) AS {t}' for _, t in AMOUNTS)},
      CASE WHEN debit_tax > 0 THEN 1 ELSE 0 END AS right_to_tax_credit, warnings FROM wide_mapped""",
    "v_tax", ctes=(WIDE_SQL, WIDE_MAPPED_SQL)))
def q_register_amounts(spark, sf_dir):
    """All amounts of the map, read under the export's own headers."""
    m = R.map_register(wide_tax(spark, sf_dir), keep=("nro",))
    return present(m.select("nro", *[t for _, t in AMOUNTS], "right_to_tax_credit", "warnings"))


def _validate_amounts_sql() -> str:
    rules = [("not_null", c, f"{c} IS NULL") for c in ("invoice_date", "invoice_number", "authorization_code", "customer_nit",
                                                       "customer_name", "total_sale_amount")]
    rules += [("overflow", t, f"{t} IS NULL") for _, t in AMOUNTS]
    rules += [("max_length", c, f"length(coalesce(CAST({c} AS VARCHAR), 'None')) > {n}") for c, n in
              (("authorization_code", 64), ("customer_nit", 15), ("customer_name", 240), ("invoice_number", 15))]
    parts = [f"SELECT 'mapped' AS stage, '{r}' AS rule, '{c}' AS column, count(*) FILTER (WHERE {cond}) AS n_rows FROM wide_mapped"
             for r, c, cond in rules]
    parts += [f"SELECT 'text', 'numeric', '{t}', count(*) FILTER (WHERE try_cast(trim(t_{t}) AS DOUBLE) IS NULL) FROM wide"
              for _, t in AMOUNTS]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_rows > 0"


@register("register_validate_amounts", S.with_views(_validate_amounts_sql(), "v_tax", ctes=(WIDE_SQL, WIDE_MAPPED_SQL)))
def q_register_validate_amounts(spark, sf_dir):
    """Rules broken by amounts that do not fit, after the mapping, and by amounts that are no numbers, before it."""
    wide = wide_tax(spark, sf_dir)
    text = wide.select(*[F.col(f"`{h}`").alias(t) for h, t in AMOUNTS])
    issues = lambda df, stage: R.validate_register(df).select(F.lit(stage).alias("stage"), "rule", "column", "n_rows")
    return issues(R.map_register(wide, keep=("nro",)), "mapped").unionByName(issues(text, "text"))
