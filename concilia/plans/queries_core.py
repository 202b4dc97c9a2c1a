"""Registered reconciliation queries (match, compare, totals, status)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import present, register
from ..fixtures import sql as S
from ..fixtures.views import FIXTURE_CONFIG, Tables, stored_registers, v_ledger, v_tax
from ..session import ensure_checkpoint_dir
from ..sinks.report import PAIR_SHEETS, ROUNDING, ROW_SHEETS, SHEET, SUMMARY_ROWS, formatted_summary, summary_table, write_report
from .reconciliation import reconcile_stored

CFG = FIXTURE_CONFIG


def run(spark, sf_dir):
    """Reconciliation of the derived registers, stored by code once per application like these."""
    return reconcile_stored(stored_registers(Tables(spark, sf_dir)), CFG)


# ---- SQL building blocks shared by the oracle texts ------------------------
CANCEL = S.canceled("estado")
TK = f"""tk AS (SELECT cuf, count(*) AS n_tax,
  count(*) FILTER (WHERE NOT {CANCEL}) AS n_tax_valid
  FROM tax_f WHERE cuf IS NOT NULL GROUP BY cuf)"""
LK = """lk AS (SELECT cuf, count(*) AS n_ledger FROM v_ledger WHERE cuf IS NOT NULL GROUP BY cuf)"""
PAIRS = f"""pairs AS (
  SELECT t.nro, t.cuf, t.importe, t.nit, t.num_factura, t.sucursal, t.estado AS tax_estado,
    l.id_factura, l.total, l.cliente_nit, l.numero_factura, l.codigo_sucursal,
    coalesce(abs(t.importe - l.total) > 0.01, false) AS amount_mismatch,
    {S.clean_nit('t.nit')} <> {S.clean_nit('l.cliente_nit')} AS customer_mismatch,
    coalesce({S.as_int('t.num_factura')} <> {S.as_int('l.numero_factura')}, false) AS invoice_mismatch,
    coalesce({S.as_int('t.sucursal')} <> {S.as_int('l.codigo_sucursal')}, false) AS branch_mismatch
  FROM tax_f t JOIN v_ledger l ON t.cuf = l.cuf
), pairs_f AS (
  SELECT *, invoice_mismatch OR branch_mismatch AS other_mismatch,
    NOT (amount_mismatch OR customer_mismatch OR invoice_mismatch OR branch_mismatch) AS perfect_match
  FROM pairs
)"""
LEDGER_SCOPE = """led_scope AS (
  SELECT l.*, (tk.n_tax_valid > 0) IS TRUE AS in_scope, coalesce(tk.n_tax, 0) AS n_tax
  FROM v_ledger l LEFT JOIN tk ON l.cuf = tk.cuf
)"""
TAX_TAG = """tax_tag AS (
  SELECT t.*, coalesce(lk.n_ledger, 0) AS n_ledger
  FROM tax_f t LEFT JOIN lk ON t.cuf = lk.cuf WHERE t.cuf IS NOT NULL
)"""


def _dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(24,4))"


def _r2(x: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE)"


STATS_SQL = S.with_views(f"""SELECT
  (SELECT count(*) FROM tax_f) AS total_tax,
  (SELECT count(*) FROM v_ledger) AS total_ledger,
  (SELECT count(*) FROM pairs_f) AS merged_count,
  (SELECT count(*) FROM pairs_f WHERE perfect_match) AS matched_count,
  (SELECT count(*) FROM tax_tag WHERE n_ledger = 0) AS only_tax_count,
  (SELECT count(*) FROM led_scope WHERE cuf IS NOT NULL AND n_tax = 0) AS only_ledger_count,
  (SELECT count(*) FROM pairs_f WHERE amount_mismatch) AS amount_mismatch_count,
  (SELECT count(*) FROM pairs_f WHERE customer_mismatch) AS customer_mismatch_count,
  (SELECT count(*) FROM pairs_f WHERE other_mismatch) AS other_mismatch_count,
  (SELECT count(*) FROM tax_tag WHERE n_ledger = 0 AND NOT {CANCEL}) AS only_tax_valid_count,
  (SELECT count(*) FROM tax_tag WHERE n_ledger = 0 AND {CANCEL}) AS only_tax_canceled_count,
  (SELECT {_r2(f"coalesce(sum({_dec('importe')}), 0)")} FROM tax_tag WHERE n_ledger = 0 AND NOT {CANCEL})
    AS only_tax_valid_amount,
  s.total_tax_amount, s.total_ledger_amount,
  {_r2('abs(s.ta - s.tl)')} AS amount_difference,
  round(CASE WHEN s.tl > 0 THEN CAST(abs(s.ta - s.tl) AS DOUBLE) / CAST(s.tl AS DOUBLE) * 100 ELSE 0.0 END, 6)
    AS amount_difference_pct,
  round(CASE WHEN (SELECT count(*) FROM tax_f) > 0 THEN
    (SELECT count(*) FROM pairs_f WHERE perfect_match) / (SELECT count(*) FROM tax_f) * 100 ELSE 0.0 END, 6)
    AS match_rate,
  (SELECT count(*) FROM tax_tag WHERE n_ledger = 0) + (SELECT count(*) FROM led_scope WHERE cuf IS NOT NULL AND n_tax = 0)
   + (SELECT count(*) FROM pairs_f WHERE amount_mismatch) + (SELECT count(*) FROM pairs_f WHERE customer_mismatch)
   + (SELECT count(*) FROM pairs_f WHERE other_mismatch) AS total_issues
FROM (SELECT ta, tl, {_r2('ta')} AS total_tax_amount, {_r2('tl')} AS total_ledger_amount FROM
  (SELECT (SELECT coalesce(sum({_dec('importe')}), 0) FROM tax_f WHERE NOT {CANCEL}) AS ta,
          (SELECT coalesce(sum({_dec('total')}), 0) FROM led_scope WHERE in_scope) AS tl)) s""",
    "tax_f", "v_ledger", ctes=(TK, LK, PAIRS, LEDGER_SCOPE, TAX_TAG))

STATS_COLS = ("total_tax", "total_ledger", "merged_count", "matched_count", "only_tax_count",
              "only_ledger_count", "amount_mismatch_count", "customer_mismatch_count",
              "other_mismatch_count", "only_tax_valid_count", "only_tax_canceled_count",
              "only_tax_valid_amount", "total_tax_amount", "total_ledger_amount",
              "amount_difference", "amount_difference_pct", "match_rate", "total_issues")


@register("reconcile_stats", STATS_SQL)
def q_reconcile_stats(spark, sf_dir):
    st = run(spark, sf_dir).stats()
    return present(st.select(*STATS_COLS), ratio_cols=("amount_difference_pct", "match_rate"))


# ---- J1-J3, J5, J12, O1: key matching ----------------------------------------
@register("match_matched", S.with_views(
    "SELECT nro, cuf FROM tax_f t WHERE cuf IS NOT NULL AND EXISTS (SELECT 1 FROM v_ledger l WHERE l.cuf = t.cuf)",
    "tax_f", "v_ledger"))
def q_match_matched(spark, sf_dir):
    t = Tables(spark, sf_dir)
    from ..operators.filters import reconcilable
    from ..operators.matching import matched
    return present(matched(reconcilable(v_tax(t), CFG), v_ledger(t), CFG).select("nro", "cuf"))


@register("match_only_tax", S.with_views(
    "SELECT nro, cuf FROM tax_f t WHERE cuf IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.cuf = t.cuf)",
    "tax_f", "v_ledger"))
def q_match_only_tax(spark, sf_dir):
    return present(run(spark, sf_dir).only_tax.select("nro", "cuf"))


@register("match_only_ledger", S.with_views(
    "SELECT id_factura, cuf FROM v_ledger l WHERE cuf IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tax_f t WHERE t.cuf = l.cuf)",
    "tax_f", "v_ledger"))
def q_match_only_ledger(spark, sf_dir):
    return present(run(spark, sf_dir).only_ledger.select("id_factura", "cuf"))


@register("ledger_valid", S.with_views(
    f"SELECT id_factura, cuf, total FROM v_ledger l WHERE EXISTS (SELECT 1 FROM tax_f t WHERE t.cuf = l.cuf AND NOT {CANCEL})",
    "tax_f", "v_ledger"))
def q_ledger_valid(spark, sf_dir):
    return present(run(spark, sf_dir).ledger_valid.select("id_factura", "cuf", "total"))


@register("match_tagged", S.with_views(
    """SELECT coalesce(tk.cuf, lk.cuf) AS match_key,
      CASE WHEN tk.n_tax > 0 AND lk.n_ledger > 0 THEN 'both' WHEN tk.n_tax > 0 THEN 'tax_only' ELSE 'ledger_only' END AS side,
      coalesce(tk.n_tax, 0) AS n_tax, coalesce(lk.n_ledger, 0) AS n_ledger
    FROM tk FULL OUTER JOIN lk ON tk.cuf = lk.cuf""", "tax_f", "v_ledger", ctes=(TK, LK)))
def q_match_tagged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    from ..operators.filters import reconcilable
    from ..operators.matching import key_sets
    return present(key_sets(reconcilable(v_tax(t), CFG), v_ledger(t), CFG))


@register("key_intersect", S.with_views(
    "SELECT cuf FROM tax_f WHERE cuf IS NOT NULL INTERSECT SELECT cuf FROM v_ledger WHERE cuf IS NOT NULL",
    "tax_f", "v_ledger"))
def q_key_intersect(spark, sf_dir):
    t = Tables(spark, sf_dir)
    from ..operators.filters import reconcilable
    from ..operators.setops import key_intersect
    return key_intersect(reconcilable(v_tax(t), CFG), "cuf", v_ledger(t), "cuf")


@register("key_except", S.with_views(
    """SELECT 'tax_only' AS side, cuf FROM (SELECT cuf FROM tax_f WHERE cuf IS NOT NULL EXCEPT SELECT cuf FROM v_ledger)
    UNION ALL
    SELECT 'ledger_only' AS side, cuf FROM (SELECT cuf FROM v_ledger WHERE cuf IS NOT NULL EXCEPT SELECT cuf FROM tax_f)""",
    "tax_f", "v_ledger"))
def q_key_except(spark, sf_dir):
    t = Tables(spark, sf_dir)
    from ..operators.filters import reconcilable
    from ..operators.setops import key_except_both
    return key_except_both(reconcilable(v_tax(t), CFG), "cuf", v_ledger(t), "cuf")


# ---- J4, C2-C6: field comparison --------------------------------------------
@register("field_compare", S.with_views(
    """SELECT nro, id_factura, cuf AS match_key, amount_mismatch, customer_mismatch, other_mismatch, perfect_match
    FROM pairs_f""", "tax_f", "v_ledger", ctes=(PAIRS,)))
def q_field_compare(spark, sf_dir):
    p = run(spark, sf_dir).pairs
    return present(p.select(F.col("tax_nro").alias("nro"), F.col("inv_id_factura").alias("id_factura"),
                            "match_key", "amount_mismatch", "customer_mismatch", "other_mismatch",
                            "perfect_match"))


@register("amount_mismatch", S.with_views(
    f"""SELECT nro, id_factura, {_r2(_dec('importe'))} AS tax_amount, {_r2(_dec('total'))} AS inv_amount,
      {_r2(f"{_dec('importe')} - {_dec('total')}")} AS amount_diff
    FROM pairs_f WHERE amount_mismatch""", "tax_f", "v_ledger", ctes=(PAIRS,)))
def q_amount_mismatch(spark, sf_dir):
    from ..functions.predicates import money
    p = run(spark, sf_dir).amount_mismatches
    return present(p.select(F.col("tax_nro").alias("nro"), F.col("inv_id_factura").alias("id_factura"),
                            money(F.col("tax_importe")).alias("tax_amount"),
                            money(F.col("inv_total")).alias("inv_amount"),
                            (money(F.col("tax_importe")) - money(F.col("inv_total"))).alias("amount_diff")))


@register("customer_mismatch", S.with_views(
    f"""SELECT nro, id_factura, nit AS tax_nit, cliente_nit AS inv_nit,
      {S.clean_nit('nit')} AS tax_nit_clean, {S.clean_nit('cliente_nit')} AS inv_nit_clean
    FROM pairs_f WHERE customer_mismatch""", "tax_f", "v_ledger", ctes=(PAIRS,)))
def q_customer_mismatch(spark, sf_dir):
    from ..functions.predicates import clean_nit
    p = run(spark, sf_dir).customer_mismatches
    return present(p.select(F.col("tax_nro").alias("nro"), F.col("inv_id_factura").alias("id_factura"),
                            F.col("tax_nit").alias("tax_nit"), F.col("inv_cliente_nit").alias("inv_nit"),
                            clean_nit(F.col("tax_nit")).alias("tax_nit_clean"),
                            clean_nit(F.col("inv_cliente_nit")).alias("inv_nit_clean")))


@register("other_mismatch", S.with_views(
    """SELECT nro, id_factura, invoice_mismatch, branch_mismatch FROM pairs_f WHERE other_mismatch""",
    "tax_f", "v_ledger", ctes=(PAIRS,)))
def q_other_mismatch(spark, sf_dir):
    p = run(spark, sf_dir).other_mismatches
    return present(p.select(F.col("tax_nro").alias("nro"), F.col("inv_id_factura").alias("id_factura"),
                            "invoice_mismatch", "branch_mismatch"))


@register("perfect_match", S.with_views(
    "SELECT nro, id_factura, cuf AS match_key FROM pairs_f WHERE perfect_match", "tax_f", "v_ledger", ctes=(PAIRS,)))
def q_perfect_match(spark, sf_dir):
    p = run(spark, sf_dir).perfect
    return present(p.select(F.col("tax_nro").alias("nro"), F.col("inv_id_factura").alias("id_factura"),
                            "match_key"))


@register("mismatch_exploded", S.with_views(
    """SELECT nro, id_factura, 'amount' AS mismatch_type FROM pairs_f WHERE amount_mismatch
    UNION ALL SELECT nro, id_factura, 'customer' FROM pairs_f WHERE customer_mismatch
    UNION ALL SELECT nro, id_factura, 'other' FROM pairs_f WHERE other_mismatch""",
    "tax_f", "v_ledger", ctes=(PAIRS,)))
def q_mismatch_exploded(spark, sf_dir):
    from ..operators.matching import mismatch_exploded
    p = mismatch_exploded(run(spark, sf_dir).pairs)
    return present(p.select(F.col("tax_nro").alias("nro"), F.col("inv_id_factura").alias("id_factura"),
                            "mismatch_type"))


@register("only_tax_split", S.with_views(
    f"""SELECT count(*) FILTER (WHERE NOT {CANCEL}) AS only_tax_valid_count,
      count(*) FILTER (WHERE {CANCEL}) AS only_tax_canceled_count,
      {_r2(f"coalesce(sum({_dec('importe')}) FILTER (WHERE NOT {CANCEL}), 0)")} AS only_tax_valid_amount
    FROM tax_tag WHERE n_ledger = 0""", "tax_f", "v_ledger", ctes=(LK, TAX_TAG)))
def q_only_tax_split(spark, sf_dir):
    from ..operators.summary import only_tax_split
    r = run(spark, sf_dir)
    return present(only_tax_split(r.only_tax, CFG))


# ---- A1, A2, A5, C7, C8 -------------------------------------------------------
@register("totals", S.with_views(
    f"""SELECT (SELECT {_r2(f"coalesce(sum({_dec('importe')}), 0)")} FROM tax_f WHERE NOT {CANCEL}) AS total_tax_amount,
      (SELECT {_r2(f"coalesce(sum({_dec('total')}), 0)")} FROM led_scope WHERE in_scope) AS total_ledger_amount""",
    "tax_f", "v_ledger", ctes=(TK, LEDGER_SCOPE)))
def q_totals(spark, sf_dir):
    st = run(spark, sf_dir).stats()
    return present(st.select("total_tax_amount", "total_ledger_amount"))


GATE_SQL = S.with_views(
    """SELECT (amount_difference_pct <= 0.5 AND amount_mismatch_count = 0) AS passed,
      (amount_difference_pct <= 0.5 AND amount_mismatch_count = 0) OR false AS should_sync
    FROM stats""", ctes=(f"stats AS ({STATS_SQL})",))


@register("gate", GATE_SQL)
def q_gate(spark, sf_dir):
    return run(spark, sf_dir).gate(force=False)


# ---- A3, A4, O2: branches -----------------------------------------------------
def _branch_sql(src: str, amount: str, branch: str, cancel: str) -> str:
    key = f"""CASE WHEN {branch} IS NULL THEN NULL ELSE coalesce(CAST({S.as_int(branch)} AS VARCHAR), 'unknown') END"""
    return f"""SELECT {key} AS branch_code,
      count(*) FILTER (WHERE NOT {cancel}) AS count,
      coalesce(sum({_dec(amount)}) FILTER (WHERE NOT {cancel}), 0) AS amount,
      count(*) FILTER (WHERE {cancel}) AS canceled_count
    FROM {src} WHERE {branch} IS NOT NULL GROUP BY 1"""


TAX_BR = f"tax_br AS ({_branch_sql('tax_f', 'importe', 'sucursal', CANCEL)})"
LED_BR = f"led_br AS ({_branch_sql('(SELECT * FROM led_scope WHERE in_scope)', 'total', 'codigo_sucursal', 'false')})"
BRANCH_REPORT = """branch_report AS (
  SELECT coalesce(t.branch_code, l.branch_code) AS branch_code,
    coalesce(t.count, 0) AS tax_count, coalesce(t.canceled_count, 0) AS tax_canceled,
    coalesce(t.amount, 0) AS tax_amount, coalesce(l.count, 0) AS inv_count, coalesce(l.amount, 0) AS inv_amount,
    t.branch_code IS NOT NULL AS in_tax
  FROM tax_br t FULL OUTER JOIN led_br l ON t.branch_code = l.branch_code
), branch_report2 AS (
  SELECT *, tax_count - inv_count AS count_diff, tax_amount - inv_amount AS amount_diff,
    CASE WHEN inv_amount > 0 THEN CAST(tax_amount - inv_amount AS DOUBLE) / CAST(inv_amount AS DOUBLE) * 100
         ELSE 0.0 END AS amount_diff_pct
  FROM branch_report
)"""


@register("branch_breakdown", S.with_views(
    f"SELECT branch_code, count, {_r2('amount')} AS amount, canceled_count FROM tax_br",
    "tax_f", ctes=(TAX_BR,)))
def q_branch_breakdown(spark, sf_dir):
    return present(run(spark, sf_dir).tax_branches())


@register("report_branch", S.with_views(
    f"""SELECT branch_code,
      CASE branch_code WHEN '0' THEN 'CENTRAL' WHEN '5' THEN 'SANTA CRUZ' WHEN '6' THEN 'POTOSI'
           ELSE 'Branch ' || branch_code END AS branch_name,
      tax_count, tax_canceled, {_r2('tax_amount')} AS tax_amount, inv_count, {_r2('inv_amount')} AS inv_amount,
      count_diff, {_r2('amount_diff')} AS amount_diff, round(amount_diff_pct, 6) AS amount_diff_pct,
      CASE WHEN abs(amount_diff_pct) <= 0.5 THEN 'OK' ELSE 'WARNING' END AS status, in_tax
    FROM branch_report2""", "tax_f", "v_ledger", ctes=(TK, LEDGER_SCOPE, TAX_BR, LED_BR, BRANCH_REPORT)))
def q_report_branch(spark, sf_dir):
    return present(run(spark, sf_dir).branch_report(), ratio_cols=("amount_diff_pct",))


@register("status", S.with_views(
    """SELECT CASE WHEN reason IN ('valid_only_in_tax', 'branch_over_threshold', 'total_over_threshold',
                                  'amount_mismatch') THEN 'CRITICAL'
                 WHEN reason = 'no_discrepancy' THEN 'PERFECT' WHEN reason = 'minor_issues' THEN 'MINOR ISSUES'
                 ELSE 'ACCEPTABLE' END AS status,
      reason AS status_reason, branches_with_issues, other_issues
    FROM (SELECT *, CASE WHEN only_tax_valid_count > 0 THEN 'valid_only_in_tax'
        WHEN branches_with_issues > 0 THEN 'branch_over_threshold'
        WHEN amount_difference_pct > 0.5 THEN 'total_over_threshold'
        WHEN amount_mismatch_count > 0 THEN 'amount_mismatch'
        WHEN only_tax_count > 0 AND only_tax_valid_count = 0 AND only_tax_canceled_count > 0
             AND amount_difference_pct <= 0.5 THEN 'only_canceled_in_tax'
        WHEN other_issues = 0 THEN 'no_discrepancy'
        WHEN other_issues <= 5 THEN 'few_minor' ELSE 'minor_issues' END AS reason
      FROM (SELECT s.*, s.only_ledger_count + s.customer_mismatch_count + s.other_mismatch_count AS other_issues,
              (SELECT count(*) FROM branch_report2 WHERE in_tax AND inv_amount > 0 AND abs(amount_diff_pct) > 0.5)
                AS branches_with_issues
            FROM stats s))""",
    "tax_f", "v_ledger", ctes=(TK, LEDGER_SCOPE, TAX_BR, LED_BR, BRANCH_REPORT, f"stats AS ({STATS_SQL})")))
def q_status(spark, sf_dir):
    return run(spark, sf_dir).status()


@register("branch_union", S.with_views(
    f"""SELECT DISTINCT CAST({S.as_int('sucursal')} AS VARCHAR) AS branch_code FROM tax_f WHERE sucursal IS NOT NULL
    UNION SELECT DISTINCT CAST({S.as_int('codigo_sucursal')} AS VARCHAR) FROM v_ledger WHERE codigo_sucursal IS NOT NULL""",
    "tax_f", "v_ledger"))
def q_branch_union(spark, sf_dir):
    from ..operators.branches import branch_union
    r = run(spark, sf_dir)
    return branch_union((r.tax, "sucursal"), (r.ledger, "codigo_sucursal"))


# ---- F1-F3 ---------------------------------------------------------------------
@register("modality_filter", S.with_views(
    "SELECT nro, modalidad FROM v_tax WHERE modalidad = '2'", "v_tax"))
def q_modality_filter(spark, sf_dir):
    from ..operators.filters import modality_filter
    return present(modality_filter(v_tax(Tables(spark, sf_dir)), "modalidad", "2").select("nro", "modalidad"))


@register("sector_exclude", S.with_views(
    "SELECT nro, sector FROM v_tax WHERE sector IS DISTINCT FROM '02'", "v_tax"))
def q_sector_exclude(spark, sf_dir):
    from ..operators.filters import sector_exclude
    return present(sector_exclude(v_tax(Tables(spark, sf_dir)), "sector", "02").select("nro", "sector"))


@register("validity_split", S.with_views(
    f"SELECT {CANCEL} AS canceled, count(*) AS n FROM v_tax GROUP BY 1", "v_tax"))
def q_validity_split(spark, sf_dir):
    from ..functions.predicates import is_canceled
    tax = v_tax(Tables(spark, sf_dir))
    return (tax.groupBy(is_canceled(F.col("estado")).alias("canceled"))
               .agg(F.count(F.lit(1)).alias("n")))


# ---- K3: the six row sheets, written in one pass and read back ---------------
def _row_sheet(name: str, flag: str) -> str:
    return (f"SELECT '{name}' AS report, cuf AS match_key, CAST(nro AS BIGINT) AS nro, CAST(id_factura AS BIGINT) AS id_factura, "
            f"{_r2(_dec('importe'))} AS tax_amount, {_r2(_dec('total'))} AS inv_amount, "
            "concat_ws('+', CASE WHEN amount_mismatch THEN 'amount' END, CASE WHEN customer_mismatch THEN 'customer' END, "
            f"CASE WHEN other_mismatch THEN 'other' END) AS mismatch_types FROM pairs_f WHERE {flag}")


@register("report_rows", S.with_views(" UNION ALL ".join([
    *(_row_sheet(name, flag) for name, flag in PAIR_SHEETS),
    f"SELECT 'only_in_tax', cuf, CAST(nro AS BIGINT), NULL, {_r2(_dec('importe'))}, NULL, NULL FROM tax_tag WHERE n_ledger = 0",
    f"SELECT 'only_in_ledger', cuf, NULL, CAST(id_factura AS BIGINT), NULL, {_r2(_dec('total'))}, NULL FROM led_scope "
    "WHERE cuf IS NOT NULL AND n_tax = 0"]), "tax_f", "v_ledger", ctes=(TK, LK, PAIRS, LEDGER_SCOPE, TAX_TAG)))
def q_report_rows(spark, sf_dir):
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports/{uuid.uuid4().hex}"
    written = write_report(run(spark, sf_dir), root)
    rows = spark.read.option("basePath", root).option("mergeSchema", True).parquet(
        *[f"{root}/{SHEET}={n}" for n in ROW_SHEETS if n in written])
    money = lambda c: F.round(F.col(c).cast("decimal(24,4)"), 2).cast("double")
    return rows.select("report", "match_key", F.col("tax_nro").cast("bigint").alias("nro"),
                       F.col("inv_id_factura").cast("bigint").alias("id_factura"), money("tax_importe").alias("tax_amount"),
                       money("inv_total").alias("inv_amount"), F.array_join("mismatch_types", "+").alias("mismatch_types"))


_PLACED = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{label}' AS metric, round(CAST({c} AS DOUBLE), {ROUNDING.get(c, 0)}) AS value, "
    f"{ROUNDING.get(c, 0)} AS places FROM stats" for i, (label, c) in enumerate(SUMMARY_ROWS))


@register("report_text", S.with_views(
    "SELECT position, metric, value, CASE places WHEN 0 THEN format('{:,.0f}', value) WHEN 2 THEN format('{:,.2f}', value) "
    f"ELSE format('{{:,.4f}}', value) END AS text FROM ({_PLACED})", ctes=(f"stats AS ({STATS_SQL})",)))
def q_report_text(spark, sf_dir):
    """The summary sheet as text: thousands separators, places per statistic."""
    return present(formatted_summary(summary_table(run(spark, sf_dir).stats())))
