"""Registered upsert queries (K5, K6, J11) and audit queries over the
accounting register (S8, S9, F7, A15, L2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import present, register
from ..config import OBS_NOT_IN_LEDGER
from ..fixtures import sql as S
from ..fixtures.views import Tables, v_accounting
from ..operators import upsert as U
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sinks.snapshot import commit_load, commit_snapshot, read_current
from .queries_core import LK, TAX_TAG
from .queries_register import GLOSA_SQL, MAPPED_SQL, mapped

NOW = "2025-01-01 00:00:00"

TARGET_SQL = f"""tgt AS (
  SELECT authorization_code, invoice_number, invoice_date, total_sale_amount - 1 AS total_sale_amount,
    'manual' AS author, CASE WHEN sector_raw = '02' THEN 'Factura de alquiler'
      WHEN sector_raw = '35' THEN 'Factura en dólares - SIAT desktop' END AS observations,
    TIMESTAMP '2020-01-01 00:00:00' AS created_at, TIMESTAMP '2020-01-01 00:00:00' AS updated_at
  FROM (SELECT DISTINCT ON (nro) * FROM mapped WHERE nro % 3 = 0 AND authorization_code IS NOT NULL)
), src AS (
  SELECT * FROM mapped WHERE authorization_code IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY authorization_code ORDER BY nro DESC) = 1
)"""


def target(spark, sf_dir):
    return v_accounting(Tables(spark, sf_dir)).filter(F.col("authorization_code").isNotNull())


def source(spark, sf_dir):
    return mapped(spark, sf_dir, with_lookups=False)


@register("upsert_result", S.with_views(
    f"""SELECT coalesce(t.authorization_code, s.authorization_code) AS authorization_code,
      CASE WHEN t.authorization_code IS NOT NULL AND s.authorization_code IS NOT NULL THEN 'update'
           WHEN s.authorization_code IS NOT NULL THEN 'insert' ELSE 'keep' END AS action,
      CASE WHEN t.authorization_code IS NOT NULL THEN t.author ELSE s.author END AS author,
      CAST(round(CASE WHEN s.authorization_code IS NOT NULL THEN s.total_sale_amount
                      ELSE t.total_sale_amount END, 2) AS DOUBLE) AS total_sale_amount,
      CASE WHEN s.authorization_code IS NOT NULL THEN s.invoice_number ELSE t.invoice_number END AS invoice_number,
      strftime(CASE WHEN t.authorization_code IS NOT NULL THEN t.created_at ELSE TIMESTAMP '{NOW}' END,
               '%Y-%m-%d %H:%M:%S') AS created_at,
      strftime(CASE WHEN s.authorization_code IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE t.updated_at END,
               '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM tgt t FULL OUTER JOIN (SELECT *, 'concilia' AS author FROM src) s
      ON t.authorization_code = s.authorization_code""",
    "v_tax", ctes=(MAPPED_SQL, TARGET_SQL)))
def q_upsert_result(spark, sf_dir):
    plan = U.merge_plan(target(spark, sf_dir), source(spark, sf_dir), "authorization_code",
                        now=F.lit(NOW).cast("timestamp"), order_by="nro")
    return present(plan.select("authorization_code", "action", "author", "total_sale_amount",
                               "invoice_number", "created_at", "updated_at"))


@register("upsert_counts", S.with_views(
    """SELECT count(*) FILTER (WHERE NOT e) AS inserted,
      CAST(coalesce(sum(CASE WHEN e THEN c ELSE c - 1 END), 0) AS BIGINT) AS updated,
      CAST(coalesce(sum(c), 0) AS BIGINT) AS total_processed
    FROM (SELECT m.authorization_code, count(*) AS c,
            bool_or(EXISTS (SELECT 1 FROM tgt WHERE tgt.authorization_code = m.authorization_code)) AS e
          FROM mapped m WHERE m.authorization_code IS NOT NULL GROUP BY 1)""",
    "v_tax", ctes=(MAPPED_SQL, TARGET_SQL)))
def q_upsert_counts(spark, sf_dir):
    return U.upsert_counts(target(spark, sf_dir), source(spark, sf_dir))


@register("upsert_dry_run", S.with_views(
    """SELECT r.rows, c.exact_inserts, c.exact_updates, p.existing_ratio,
      CAST(floor(r.rows * p.existing_ratio) AS BIGINT) AS estimated_updates,
      CAST(r.rows - floor(r.rows * p.existing_ratio) AS BIGINT) AS estimated_inserts
    FROM (SELECT count(*) AS rows FROM mapped) r,
      (SELECT count(*) FILTER (WHERE NOT e) AS exact_inserts,
              CAST(coalesce(sum(CASE WHEN e THEN c ELSE c - 1 END), 0) AS BIGINT) AS exact_updates
       FROM (SELECT m.authorization_code, count(*) AS c,
               bool_or(EXISTS (SELECT 1 FROM tgt WHERE tgt.authorization_code = m.authorization_code)) AS e
             FROM mapped m WHERE m.authorization_code IS NOT NULL GROUP BY 1)) c,
      (SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM tgt WHERE tgt.authorization_code = h.authorization_code))
              / count(*) AS existing_ratio
       FROM (SELECT authorization_code FROM mapped ORDER BY nro ASC NULLS LAST, authorization_code ASC NULLS LAST
             LIMIT 10) h) p""",
    "v_tax", ctes=(MAPPED_SQL, TARGET_SQL)))
def q_upsert_dry_run(spark, sf_dir):
    return U.dry_run(target(spark, sf_dir), source(spark, sf_dir), sample=10, sample_order="nro")


# ---- audit over the loaded register (S8, S9, F7, A15, L2) ------------------
def loaded(spark, sf_dir):
    """The register after the load: merge plan of the mapped tax rows
    (with observations) into the existing register."""
    src = mapped(spark, sf_dir)
    return U.merge_plan(target(spark, sf_dir), src, "authorization_code",
                        now=F.lit(NOW).cast("timestamp"), order_by="nro")


LOADED_SQL = f"""obs_src AS (
  SELECT m.*, CASE WHEN m.sector_raw = '02' THEN 'Factura de alquiler'
      WHEN m.sector_raw = '35' THEN 'Factura en dólares - SIAT desktop'
      WHEN ot.cuf IS NOT NULL THEN '{OBS_NOT_IN_LEDGER}' END AS observations
  FROM mapped m LEFT JOIN (SELECT DISTINCT cuf FROM tax_tag WHERE n_ledger = 0) ot ON m.cuf = ot.cuf
  WHERE m.authorization_code IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY m.authorization_code ORDER BY m.nro DESC) = 1
), loaded AS (
  SELECT coalesce(t.authorization_code, s.authorization_code) AS authorization_code,
    CASE WHEN s.authorization_code IS NOT NULL THEN s.invoice_date ELSE t.invoice_date END AS invoice_date,
    CASE WHEN s.authorization_code IS NOT NULL THEN s.invoice_number ELSE t.invoice_number END AS invoice_number,
    CASE WHEN s.authorization_code IS NOT NULL THEN s.observations ELSE t.observations END AS observations
  FROM tgt t FULL OUTER JOIN obs_src s ON t.authorization_code = s.authorization_code
)"""
AUDIT_CTES = (MAPPED_SQL, TARGET_SQL, LK, TAX_TAG, GLOSA_SQL, LOADED_SQL)


@register("key_uniqueness", S.with_views(
    "SELECT count(*) AS rows, count(DISTINCT authorization_code) AS distinct_keys, "
    "count(*) = count(DISTINCT authorization_code) AS is_unique FROM loaded",
    "v_tax", "tax_f", "v_ledger", ctes=AUDIT_CTES))
def q_key_uniqueness(spark, sf_dir):
    from ..operators.audit import key_uniqueness
    return key_uniqueness(loaded(spark, sf_dir), "authorization_code")


@register("observation_audit", S.with_views(
    f"""SELECT authorization_code, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, invoice_number, observations
    FROM loaded WHERE observations LIKE '%No existe%' AND year(invoice_date) = 1998 AND month(invoice_date) = 11""",
    "v_tax", "tax_f", "v_ledger", ctes=AUDIT_CTES))
def q_observation_audit(spark, sf_dir):
    from ..operators.audit import observation_audit
    return present(observation_audit(loaded(spark, sf_dir), "invoice_date", "observations",
                                     "No existe", 1998, 11)
                   .select("authorization_code", "invoice_date", "invoice_number", "observations"))


@register("observation_by_month", S.with_views(
    f"""SELECT year(invoice_date) AS year, month(invoice_date) AS month, count(*) AS n
    FROM loaded WHERE observations = '{OBS_NOT_IN_LEDGER}' GROUP BY 1, 2""",
    "v_tax", "tax_f", "v_ledger", ctes=AUDIT_CTES))
def q_observation_by_month(spark, sf_dir):
    from ..operators.audit import observation_counts
    return present(observation_counts(loaded(spark, sf_dir), "invoice_date", "observations",
                                      OBS_NOT_IN_LEDGER, by="month"))


@register("observation_by_day", S.with_views(
    f"""SELECT strftime(invoice_date, '%Y-%m-%d') AS day, month(invoice_date) AS month, year(invoice_date) AS year,
      count(*) AS n FROM loaded WHERE observations = '{OBS_NOT_IN_LEDGER}' GROUP BY 1, 2, 3""",
    "v_tax", "tax_f", "v_ledger", ctes=AUDIT_CTES))
def q_observation_by_day(spark, sf_dir):
    from ..operators.audit import observation_counts
    return present(observation_counts(loaded(spark, sf_dir), "invoice_date", "observations",
                                      OBS_NOT_IN_LEDGER, by="day"))


@register("latest_observed", S.with_views(
    f"""SELECT authorization_code, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, invoice_number FROM loaded
    WHERE observations = '{OBS_NOT_IN_LEDGER}' ORDER BY invoice_date DESC NULLS LAST, authorization_code DESC
    LIMIT 10""", "v_tax", "tax_f", "v_ledger", ctes=AUDIT_CTES))
def q_latest_observed(spark, sf_dir):
    from ..operators.audit import latest
    df = loaded(spark, sf_dir).filter(F.col("observations") == OBS_NOT_IN_LEDGER)
    return present(latest(df, ["invoice_date", "authorization_code"], 10)
                   .select("authorization_code", "invoice_date", "invoice_number"))


# ---- a load into the stored register, buckets, every column read back (K5) ----
LOAD_EVERY, LOAD_BUCKETS = 7, 16
#: Register columns that the derived tax rows have; the key, ``author`` and the stamps follow rules of their own.
WRITTEN = ("invoice_date", "invoice_number", "customer_nit", "complement", "customer_name", "total_sale_amount", "debit_tax", "status",
           "control_code", "sale_type", "right_to_tax_credit", "consolidation_status", "branch_office", "modality", "emission_type",
           "invoice_type", "sector", "observations")


def stored_target(spark, sf_dir):
    """The existing register with an ``id`` and a note, which no load writes."""
    code = F.col("authorization_code")
    return target(spark, sf_dir).drop("warnings").withColumn("id", F.conv(F.substring(code, 1, 8), 16, 10).cast("bigint")).withColumn(
        "obs", F.when(F.substring(code, 1, 1) < "8", F.concat(F.lit("note "), F.substring(code, 1, 4))))


_STORED_SQL = f"""credit AS (SELECT *, CASE WHEN debit_tax > 0 THEN 1 ELSE 0 END AS right_to_tax_credit,
    CASE WHEN sector_raw = '02' THEN 'Factura de alquiler' WHEN sector_raw = '35' THEN 'Factura en dólares - SIAT desktop' END AS observations
  FROM mapped WHERE authorization_code IS NOT NULL
), old AS (SELECT DISTINCT ON (nro) * REPLACE (total_sale_amount - 1 AS total_sale_amount), 'manual' AS author,
    CAST('0x' || substr(authorization_code, 1, 8) AS BIGINT) AS id,
    CASE WHEN substr(authorization_code, 1, 1) < '8' THEN 'note ' || substr(authorization_code, 1, 4) END AS obs
  FROM credit WHERE nro % 3 = 0
), new AS (SELECT DISTINCT ON (nro) * FROM credit WHERE nro % {LOAD_EVERY} = 0)"""


def _written_sql(c: str) -> str:
    value = f"CASE WHEN s.authorization_code IS NOT NULL THEN s.{c} ELSE t.{c} END"
    if c == "invoice_date":
        value = f"strftime({value}, '%Y-%m-%d')"
    if c in ("total_sale_amount", "debit_tax"):
        value = f"CAST(round({value}, 2) AS DOUBLE)"
    return f"{value} AS {c}"


@register("load_register", S.with_views(
    f"""SELECT coalesce(t.authorization_code, s.authorization_code) AS authorization_code, {', '.join(map(_written_sql, WRITTEN))},
      t.id, t.obs, CASE WHEN t.authorization_code IS NOT NULL THEN t.author ELSE 'concilia' END AS author,
      CASE WHEN t.authorization_code IS NOT NULL THEN '2020-01-01 00:00:00' ELSE '{NOW}' END AS created_at,
      CASE WHEN s.authorization_code IS NOT NULL THEN '{NOW}' ELSE '2020-01-01 00:00:00' END AS updated_at
    FROM old t FULL OUTER JOIN new s ON t.authorization_code = s.authorization_code""",
    "v_tax", ctes=(MAPPED_SQL, _STORED_SQL)))
def q_load_register(spark, sf_dir):
    """The register after a load of every seventh row, all columns, read back from its buckets."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registers/{uuid.uuid4().hex}"
    commit_snapshot(stored_target(spark, sf_dir), root, key="authorization_code", buckets=LOAD_BUCKETS)
    rows = cut_lineage(source(spark, sf_dir).filter(F.col("nro") % LOAD_EVERY == 0))
    merge = lambda old, new: U.merge_plan(old, new, now=F.lit(NOW).cast("timestamp"), order_by="nro").drop("action")
    commit_load(rows, root, "authorization_code", merge)
    return present(read_current(spark, root).select(
        "authorization_code", *WRITTEN, "id", "obs", "author", "created_at", "updated_at"))
