"""Registered profile, set-operation, preview, period, report and source
queries (A9, A10, A14, L3, L4, O3, O4, P1, P6, P7, F6, X17, K3, S2, S3)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import present, register
from ..config import MONTH_NAMES
from ..fixtures import sql as S
from ..fixtures.files import write_files
from ..fixtures.views import Tables, v_ledger, v_tax
from ..operators import audit as AU
from ..operators import profiling as P
from ..operators.filters import period_bounds_of
from ..operators.setops import duplicate_keys, snapshot_diffs
from ..sinks.report import SUMMARY_ROWS, ROUNDING, read_csv, summary_table, write_csv
from ..session import ensure_checkpoint_dir
from ..sinks.periods import newest, read_periods, save_snapshot, write_periods
from ..sources.registers import (file_catalog, latest_snapshot, load_register, read_register, read_zip_register,
                                 repair_lines)
from .queries_core import STATS_SQL, run

SCHEMA_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@register("profile_nulls", S.with_views(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 6) AS null_pct, count(*) AS rows FROM v_tax"
        for c, t in (("nro", "bigint"), ("cuf", "string"), ("fecha", "date"), ("nit", "string"),
                     ("nombre", "string"), ("importe", "double"), ("estado", "string"), ("modalidad", "string"),
                     ("sector", "string"), ("sucursal", "string"), ("num_factura", "string"))), "v_tax"))
def q_profile_nulls(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir)).select("nro", "cuf", "fecha", "nit", "nombre", "importe", "estado",
                                              "modalidad", "sector", "sucursal", "num_factura")
    return present(P.profile_nulls(tax), ratio_cols=("null_pct",))


@register("profile_dates", """SELECT 'o_orderdate' AS column,
    strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_value,
    strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_value FROM orders
  UNION ALL SELECT 'l_shipdate', strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S'),
    strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem""")
def q_profile_dates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = P.profile_dates(t["orders"].select("o_orderdate"))
    b = P.profile_dates(t["lineitem"].select("l_shipdate"))
    return a.unionByName(b)


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("profile_moments", " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count,
      CAST(sum(CAST({c} AS DECIMAL(38,8))) AS DOUBLE) / count({c}) AS mean, round(stddev_samp({c}), 6) AS std,
      min({c}) AS min, max({c}) AS max FROM lineitem""" for c in NUMERIC))
def q_profile_moments(spark, sf_dir):
    li = Tables(spark, sf_dir)["lineitem"]
    return present(P.numeric_profile(li, list(NUMERIC), quartiles=False), ratio_cols=("std",))


@register("profile_numeric", " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count,
      CAST(sum(CAST({c} AS DECIMAL(38,8))) AS DOUBLE) / count({c}) AS mean, round(stddev_samp({c}), 6) AS std,
      min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25,
      round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"""
    for c in NUMERIC))
def q_profile_numeric(spark, sf_dir):
    """Count, mean, std, min, exact quartiles (linear interpolation), max."""
    li = Tables(spark, sf_dir)["lineitem"]
    return present(P.numeric_summary(li, list(NUMERIC)), ratio_cols=("std", "q25", "q50", "q75"))


@register("value_topk_orders", """SELECT field, n_distinct, rnk AS rank, value, n, round(n / rows * 100, 6) AS share_pct
  FROM (SELECT c.*, d.n_distinct, (SELECT count(*) FROM orders) AS rows,
          row_number() OVER (PARTITION BY c.field ORDER BY c.n DESC, c.value ASC) AS rnk
        FROM (SELECT field, value, count(*) AS n FROM (
                SELECT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders
                UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
                UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders)
              WHERE value IS NOT NULL GROUP BY 1, 2) c
        JOIN (SELECT 'o_orderstatus' AS field, count(DISTINCT o_orderstatus) AS n_distinct FROM orders
              UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
              UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders) d USING (field))
  WHERE rnk <= 3""")
def q_value_topk_orders(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"]
    return present(P.value_topk(o, ["o_orderstatus", "o_orderpriority", "o_custkey"], k=3),
                   ratio_cols=("share_pct",))


@register("duplicate_keys", S.with_views(
    """SELECT nro, cuf, count(*) OVER (PARTITION BY cuf) AS copies FROM v_tax
    WHERE cuf IS NOT NULL QUALIFY count(*) OVER (PARTITION BY cuf) > 1""", "v_tax"))
def q_duplicate_keys(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir)).select("nro", "cuf")
    return present(duplicate_keys(tax, "cuf"))


@register("top_invoices", S.with_views(
    "SELECT nro, cuf, importe FROM v_tax ORDER BY importe DESC NULLS LAST, nro ASC LIMIT 10", "v_tax"))
def q_top_invoices(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir)).select("nro", "cuf", "importe")
    return AU.top_by_amount(tax, "importe", "nro", 10)


#: Snapshots for the diff: the new one lost some rows, repeats some under new numbers, and renumbers a few codes.
_SNAPSHOT_SQL = """old AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS nro, 'C' || CAST(o_orderkey AS VARCHAR) AS code, o_totalprice FROM orders
  ), new AS (
    SELECT CASE WHEN o_orderkey % 503 = 0 THEN 'R' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS nro,
      'C' || CAST(o_orderkey AS VARCHAR) AS code, o_totalprice FROM orders WHERE o_orderkey % 101 <> 0
    UNION ALL SELECT CAST(o_orderkey + 10000000 AS VARCHAR), 'D' || CAST(o_orderkey AS VARCHAR), o_totalprice FROM orders
    WHERE o_orderkey % 997 = 0)"""


def _diff_sql(key: str, one: str, other: str, direction: str) -> str:
    return f"""SELECT nro, code, o_totalprice, '{direction}' AS direction,
    CAST(CASE WHEN regexp_full_match(nro, '[0-9]+') THEN TRY_CAST(nro AS BIGINT) ELSE 0 END AS BIGINT) AS number_order,
    '{key}' AS key_kind FROM {one} WHERE {key} NOT IN (SELECT {key} FROM {other})"""


@register("missing_rows", f"WITH {_SNAPSHOT_SQL} " + " UNION ALL ".join(
    _diff_sql(k, *way) for k in ("nro", "code") for way in (("old", "new", "lost"), ("new", "old", "new"))))
def q_missing_rows(spark, sf_dir):
    """Differences of two snapshots by row number and by code."""
    k, amount = F.col("o_orderkey"), F.col("o_totalprice")
    o = Tables(spark, sf_dir)["orders"].select(k, amount)
    nro, code = k.cast("string").alias("nro"), F.concat(F.lit("C"), k.cast("string")).alias("code")
    renumbered = F.when(k % 503 == 0, F.concat(F.lit("R"), k.cast("string"))).otherwise(k.cast("string")).alias("nro")
    new = o.filter(k % 101 != 0).select(renumbered, code, amount).unionByName(
        o.filter(k % 997 == 0).select((k + F.lit(10000000)).cast("string").alias("nro"),
                                      F.concat(F.lit("D"), k.cast("string")).alias("code"), amount))
    diff = snapshot_diffs(o.select(nro, code, amount), new, ("nro", "code"), ("o_totalprice",), number="nro")
    return present(diff.withColumn("number_order", F.col("number_order").cast("bigint")))


@register("preview", S.with_views(
    """SELECT * FROM (SELECT nro, cuf, importe, 'head' AS part FROM v_tax ORDER BY nro ASC LIMIT 5)
    UNION ALL SELECT * FROM (SELECT nro, cuf, importe, 'tail' AS part FROM v_tax ORDER BY nro DESC LIMIT 5)""",
    "v_tax"))
def q_preview(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir)).select("nro", "cuf", "importe")
    return AU.preview(tax, "nro", 5)


@register("min_rows", S.with_views(
    """SELECT least(count(*), 1000) AS rows_seen, count(*) >= 1000 AS has_min_rows,
      CAST(1000 AS BIGINT) AS min_rows FROM v_tax""", "v_tax"))
def q_min_rows(spark, sf_dir):
    return AU.min_rows(v_tax(Tables(spark, sf_dir)), 1000)


# export headers for a few derived-view columns (P1 input)
HEADERS = (("nro", "NRO."), ("fecha", "FECHA DE LA FACTURA"), ("nit", "NIT / CI CLIENTE"),
           ("nombre", "NOMBRE O RAZON SOCIAL"), ("importe", "IMPORTE TOTAL DE LA VENTA"),
           ("estado", "ESTADO"), ("control", "CODIGO DE CONTROL"), ("num_factura", "Nro. DE LA FACTURA"))


@register("clean_names", S.with_views(
    "SELECT " + ", ".join(
        f"{src} AS {AU.clean_name(h)}" if src != "fecha" else f"strftime(fecha, '%Y-%m-%d') AS {AU.clean_name(h)}"
        for src, h in HEADERS) + " FROM v_tax", "v_tax"))
def q_clean_names(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir)).select(*[F.col(s).alias(h) for s, h in HEADERS])
    return present(AU.clean_names(tax))


_MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + "]"


@register("period_range", f"""SELECT year, lower(list_extract({_MONTHS_SQL}, month)) AS month_name,
    strftime(make_date(year, month, 1), '%Y-%m-%d') AS period_start,
    strftime(last_day(make_date(year, month, 1)), '%Y-%m-%d') AS period_end, n
  FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, month(o_orderdate) AS month, count(*) AS n
        FROM orders GROUP BY 1, 2)""")
def q_period_range(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"]
    return present(period_bounds_of(o, "o_orderdate"))


def _summary_sql() -> str:
    parts = []
    for i, (label, col) in enumerate(SUMMARY_ROWS):
        parts.append(f"SELECT {i} AS position, '{label}' AS metric, "
                     f"round(CAST({col} AS DOUBLE), {ROUNDING.get(col, 0)}) AS value FROM stats")
    return "WITH stats AS (" + STATS_SQL + ")\n" + " UNION ALL ".join(parts)


@register("report_summary", _summary_sql())
def q_report_summary(spark, sf_dir):
    st = run(spark, sf_dir).stats()
    return summary_table(st).withColumn("position", F.col("position").cast("bigint"))


# ---- S2/S3: row repair of delimited lines derived from `customer` --------------
HEADER = ["NRO", "FECHA", "FACTURA", "CODIGO", "NIT", "COMPLEMENTO", "NOMBRE", "IMPORTE"]


def _lines(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"]
    k = F.col("c_custkey")
    name = (F.when(k % 7 == 1, F.concat(F.col("c_name"), F.lit(",SRL")))
             .when(k % 7 == 2, F.concat(F.col("c_name"), F.lit(",A,B"))).otherwise(F.col("c_name")))
    full = F.concat_ws(",", k.cast("string"), F.lit("2025-01-01"), k.cast("string"),
                       F.md5(k.cast("string")), k.cast("string"), F.lit(""), name,
                       F.col("c_acctbal").cast("decimal(14,2)").cast("string"))
    short = F.concat_ws(",", k.cast("string"), F.lit("2025-01-01"), k.cast("string"), F.lit("X"))
    return c.select(k.alias("line_no"), F.when(k % 41 == 0, short).otherwise(full).alias("line"))


_LINES_SQL = """lines AS (SELECT c_custkey AS line_no,
  CASE WHEN c_custkey % 41 = 0 THEN concat_ws(',', CAST(c_custkey AS VARCHAR), '2025-01-01', CAST(c_custkey AS VARCHAR), 'X')
  ELSE concat_ws(',', CAST(c_custkey AS VARCHAR), '2025-01-01', CAST(c_custkey AS VARCHAR), md5(CAST(c_custkey AS VARCHAR)),
    CAST(c_custkey AS VARCHAR), '',
    CASE WHEN c_custkey % 7 = 1 THEN c_name || ',SRL' WHEN c_custkey % 7 = 2 THEN c_name || ',A,B' ELSE c_name END,
    CAST(CAST(c_acctbal AS DECIMAL(14,2)) AS VARCHAR)) END AS line
  FROM customer
), parts AS (SELECT line_no, string_split(line, ',') AS p FROM lines
), fixed AS (SELECT line_no, len(p) AS n_fields,
  CASE WHEN len(p) = 8 THEN 'ok' WHEN len(p) > 8 THEN 'fixed' ELSE 'skipped' END AS repair_status,
  CASE WHEN len(p) = 8 THEN p WHEN len(p) > 8 THEN list_concat(p[1:6], [array_to_string(p[7:7 + len(p) - 8], ',')],
    p[8 + len(p) - 8:]) END AS f FROM parts)"""


@register("csv_repair", f"""WITH {_LINES_SQL}
  SELECT line_no, repair_status, n_fields, f[1] AS NRO, f[4] AS CODIGO, f[6] AS COMPLEMENTO, f[7] AS NOMBRE,
    f[8] AS IMPORTE FROM fixed""")
def q_csv_repair(spark, sf_dir):
    out = repair_lines(_lines(spark, sf_dir), "line", HEADER, merge_at=6)
    return out.select("line_no", "repair_status", F.col("n_fields").cast("bigint"), "NRO", "CODIGO",
                      "COMPLEMENTO", "NOMBRE", "IMPORTE")


_EXPORT_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS NRO, CAST(c_custkey AS VARCHAR) || ', x' AS COMPLEMENTO,
    CASE c_custkey % 7 WHEN 1 THEN c_name || ', SRL' WHEN 3 THEN 'La "' || c_name || '"' WHEN 4 THEN c_name || chr(10) || chr(10) || 'Branch, 2'
      WHEN 5 THEN c_name || ', SA' ELSE c_name END AS NOMBRE,
    CAST(CAST(c_acctbal AS DECIMAL(14,2)) AS VARCHAR) AS IMPORTE, 'ok' AS repair_status
  FROM customer WHERE c_custkey % 41 <> 0 AND c_custkey % 7 <> 2
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), '', c_name || ',A,B', CAST(CAST(c_acctbal AS DECIMAL(14,2)) AS VARCHAR), 'fixed'
  FROM customer WHERE c_custkey % 41 <> 0 AND c_custkey % 7 = 2"""
EXPORT_FILES = 4


def _export_lines(spark, sf_dir):
    """(file, nth, line): customers as lines of export files, a header line
    first, with quoted line breaks, escapes in quotes and outside, and surplus
    commas; a file's lines lie in order in one partition."""
    c = Tables(spark, sf_dir)["customer"]
    k, name, nro = F.col("c_custkey"), F.col("c_name"), F.col("c_custkey").cast("string")
    shown = (F.when(k % 7 == 1, F.concat(F.lit('"'), name, F.lit(', SRL"')))
              .when(k % 7 == 2, F.concat(name, F.lit(",A,B")))
              .when(k % 7 == 3, F.concat(F.lit('"La \\"'), name, F.lit('\\""')))
              .when(k % 7 == 4, F.concat(F.lit('"'), name, F.lit('\n\nBranch, 2"')))
              .when(k % 7 == 5, F.concat(name, F.lit("\\, SA"))).otherwise(name))
    extra = F.when(k % 7 == 2, F.lit("")).otherwise(F.concat(F.lit('"'), nro, F.lit(', x"')))
    full = F.concat_ws(",", nro, F.lit("2025-01-01"), nro, F.lit("X"), nro, extra, shown,
                       F.col("c_acctbal").cast("decimal(14,2)").cast("string"))
    line = F.when(k % 41 == 0, F.concat_ws(",", nro, F.lit("2025-01-01"))).otherwise(full)
    rows = c.select(F.pmod(k, F.lit(EXPORT_FILES)).cast("int").alias("file"), k.cast("bigint").alias("nth"), line.alias("line"))
    heads = spark.range(EXPORT_FILES).select(F.col("id").cast("int").alias("file"), F.lit(-1).cast("bigint").alias("nth"),
                                             F.lit(",".join(HEADER)).alias("line"))
    return rows.unionByName(heads).repartitionById(EXPORT_FILES, "file").sortWithinPartitions("nth")


def _scratch(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def _export(spark, sf_dir) -> str:
    path = _scratch(spark, "exports")
    _export_lines(spark, sf_dir).select("line").write.text(path)
    return path


@register("quoted_export", _EXPORT_SQL)
def q_quoted_export(spark, sf_dir):
    """An export with quotes, escapes and line breaks in its fields, read back."""
    return read_register(spark, _export(spark, sf_dir)).select("NRO", "COMPLEMENTO", "NOMBRE", "IMPORTE", "repair_status")


@register("load_counts", f"""SELECT repair_status, count(*) AS n FROM ({_EXPORT_SQL}) GROUP BY 1
  UNION ALL SELECT 'skipped', count(*) FROM customer WHERE c_custkey % 41 = 0 HAVING count(*) > 0""")
def q_load_counts(spark, sf_dir):
    """Lines that loading the same export took as they are, repaired and skipped."""
    _, counts = load_register(spark, _export(spark, sf_dir))
    return counts.groupBy("repair_status").agg(F.sum("n").cast("bigint").alias("n"))


@register("archive_register", _EXPORT_SQL)
def q_archive_register(spark, sf_dir):
    """The same export inside ZIP archives, streamed back."""
    root = _scratch(spark, "archives")
    lines = _export_lines(spark, sf_dir).select(F.format_string("ventas-%02d.zip", "file").alias("name"), "line")
    write_files(lines, root, archive=True)
    return read_zip_register(spark, root).select("NRO", "COMPLEMENTO", "NOMBRE", "IMPORTE", "repair_status")


@register("table_profile", " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, row_number() OVER () - 1 AS position, column_name AS column,
      CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
        ELSE lower(column_type) END AS dtype, CAST(count AS BIGINT) AS rows, round(CAST(null_percentage AS DOUBLE), 1) AS null_pct
    FROM (SUMMARIZE {t})""" for t in SCHEMA_TABLES))
def q_table_profile(spark, sf_dir):
    """Columns and types of the source tables, with their rows and the share of missing values."""
    t = Tables(spark, sf_dir)
    parts = []
    for name in SCHEMA_TABLES:
        schema, nulls = AU.table_schema(t[name]), P.profile_nulls(t[name])
        parts.append(schema.join(nulls.select("column", "rows", F.round("null_pct", 1).alias("null_pct")), "column").select(
            F.lit(name).alias("table_name"), F.col("position").cast("bigint"), "column", "dtype", "rows", "null_pct"))
    return reduce(DataFrame.unionByName, parts)


# ---- S5, S6: metadata of files that a query has written, times set from the data ----
def _written_files(spark, sf_dir) -> str:
    """A file per nation of one line per supplier; its time follows the nation's key."""
    t = Tables(spark, sf_dir)
    name = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "inventory_").when(F.col("n_nationkey") % 5 == 1, "processed_").otherwise(""),
                    F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit(".csv"))
    s = t["supplier"].select("s_nationkey", "s_suppkey", "s_name")
    lines = t["nation"].join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        "n_nationkey", "s_suppkey", name.alias("name"), F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name").alias("text"))
    lines = lines.select("*", F.when(F.col("s_suppkey").isNotNull(), F.col("text")).alias("line"))
    root = _scratch(spark, "files")
    write_files(lines.repartition("name").sortWithinPartitions("name", "s_suppkey"), root)
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in lines.select("n_nationkey", "name").distinct().toLocalIterator():  # one per nation
        days = r["n_nationkey"] * 7 % 25
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{r['name']}"), 1_577_836_800_000 + 86_400_000 * days, -1)
    return root


_FILES_SQL = """files AS (SELECT CASE n_nationkey % 5 WHEN 0 THEN 'inventory_' WHEN 1 THEN 'processed_' ELSE '' END
    || lower(replace(n_name, ' ', '_')) || '.csv' AS name,
    CAST(coalesce(sum(strlen(CAST(s_suppkey AS VARCHAR) || ',' || s_name) + 1), 0) AS BIGINT) AS size_bytes,
    TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(n_nationkey * 7 % 25 AS INTEGER)) AS modified
  FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name)"""


@register("file_catalog", f"""WITH {_FILES_SQL} SELECT name, size_bytes, round(size_bytes / 1048576, 2) AS size_mb,
    strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified, size_bytes > 0 AS usable FROM files""")
def q_file_catalog(spark, sf_dir):
    return present(file_catalog(spark, _written_files(spark, sf_dir)).drop("path"))


@register("latest_file", f"""WITH {_FILES_SQL} SELECT name, size_bytes, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified FROM files
  WHERE name NOT LIKE '%inventory\\_%' ESCAPE '\\' AND name NOT LIKE '%processed\\_%' ESCAPE '\\'
  ORDER BY files.modified DESC, name DESC LIMIT 1""")
def q_latest_file(spark, sf_dir):
    return present(latest_snapshot(file_catalog(spark, _written_files(spark, sf_dir))).select("name", "size_bytes", "modified"))


# ---- K2, S5: ledger rows stored by period, one period written again ----------
PERIODS = [(1997, 3), (1997, 4)]


def _of_periods(spark, sf_dir):
    led = v_ledger(Tables(spark, sf_dir)).select("id_factura", "cuf", "fecha_fac", "numero_factura")
    return led.filter((F.col("fecha_fac") >= "1997-03-01") & (F.col("fecha_fac") < "1997-05-01"))


_STORED_PERIODS_SQL = S.with_views("""SELECT CAST(id_factura AS BIGINT) AS id_factura, cuf,
    CAST(CASE WHEN month(fecha_fac) = 4 THEN -numero_factura ELSE numero_factura END AS BIGINT) AS numero_factura,
    CAST(year(fecha_fac) AS BIGINT) AS year, CAST(month(fecha_fac) AS BIGINT) AS month
  FROM v_ledger WHERE fecha_fac >= DATE '1997-03-01' AND fecha_fac < DATE '1997-05-01'
    AND NOT (month(fecha_fac) = 4 AND numero_factura % 2 = 0)""", "v_ledger")


def _april_again(rows):
    return rows.filter((F.month("fecha_fac") == 4) & (F.col("numero_factura") % 2 != 0)).withColumn("numero_factura", -F.col("numero_factura"))


@register("period_store", _STORED_PERIODS_SQL)
def q_period_store(spark, sf_dir):
    """Two periods written, one of them again with other rows, both read back through pruned folders."""
    root, rows = _scratch(spark, "periods"), _of_periods(spark, sf_dir)
    write_periods(rows, root, "fecha_fac")
    write_periods(_april_again(rows), root, "fecha_fac")
    return present(read_periods(spark, root, PERIODS).drop("fecha_fac"))


@register("period_snapshots", _STORED_PERIODS_SQL.replace("AS month\n", "AS month, CAST(CASE WHEN month(fecha_fac) = 4 THEN 2 ELSE 1 END AS BIGINT) AS snapshot\n"))
def q_period_snapshots(spark, sf_dir):
    """The newest snapshot of each of two periods, one of which was saved twice."""
    root, rows = _scratch(spark, "snapshots"), _of_periods(spark, sf_dir)
    for year, month in PERIODS:
        save_snapshot(rows.filter((F.year("fecha_fac") == year) & (F.month("fecha_fac") == month)), root, year, month)
    save_snapshot(_april_again(rows), root, 1997, 4)
    return present(newest(spark, root, PERIODS).drop("fecha_fac"))


# ---- K1: the processed register as CSV, read back ----
@register("csv_sink", S.with_views("SELECT CAST(nro AS BIGINT) AS nro, cuf, strftime(fecha, '%Y-%m-%d') AS fecha, importe_txt, nombre, estado FROM v_tax",
                                   "v_tax"))
def q_csv_sink(spark, sf_dir):
    """Missing values, empty texts and texts with spaces survive the CSV that is written."""
    path = _scratch(spark, "csv")
    write_csv(v_tax(Tables(spark, sf_dir)).select("nro", "cuf", "fecha", "importe_txt", "nombre", "estado"), path)
    return read_csv(spark, path, "nro bigint, cuf string, fecha string, importe_txt string, nombre string, estado string")
