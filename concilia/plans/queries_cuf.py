"""Registered decode and profile queries."""

from __future__ import annotations

from ..catalog import present, register
from ..config import CODE_FIELDS
from ..fixtures import sql as S
from ..fixtures.views import Tables, v_tax
from ..functions.cuf import decode_codes, field_names, snake
from ..operators import profiling as P

PREFIX = "cuf_"
FIELDS = field_names(PREFIX, "snake")


def decoded(spark, sf_dir):
    return decode_codes(v_tax(Tables(spark, sf_dir)), "cuf", prefix=PREFIX, names="snake")


# ---- DuckDB decode: base-10^18 HUGEINT limbs, Horner over hex chunks --------
def _decode_ctes(src: str) -> tuple[list[str], str]:
    b = 10 ** 18
    two32 = 1 << 32
    ok = ("coalesce(length(cuf) >= 42, false) AND "
          "coalesce(regexp_full_match(substr(cuf, 1, 42), '[0-9A-Fa-f]{42}'), false)")

    def chunk(start: int, length: int) -> str:
        return f"CASE WHEN ok THEN try_cast('0x' || substr(cuf, {start}, {length}) AS HUGEINT) ELSE 0 END"

    ctes = [f"dec0 AS (SELECT *, {chunk(1, 2)} AS l0, CAST(0 AS HUGEINT) AS l1, CAST(0 AS HUGEINT) AS l2 "
            f"FROM (SELECT *, {ok} AS ok FROM {src}))"]
    for step, start in enumerate(range(3, 43, 8), start=1):
        prev = f"dec{step - 1}"
        v0 = f"(l0 * {two32} + {chunk(start, 8)})"
        v1 = f"(l1 * {two32} + {v0} // {b})"
        ctes.append(f"dec{step} AS (SELECT * REPLACE ({v0} % {b} AS l0, {v1} % {b} AS l1, "
                    f"l2 * {two32} + {v1} // {b} AS l2) FROM {prev})")
    last = f"dec{len(ctes) - 1}"
    digits = (f"CAST(l2 AS VARCHAR) || lpad(CAST(l1 AS VARCHAR), 18, '0') || lpad(CAST(l0 AS VARCHAR), 18, '0')")
    fields = []
    for name, start, end in CODE_FIELDS:
        fields.append(f"CASE WHEN decode_status = 'ok' THEN substr(substr(digits, 28), {start + 1}, {end - start}) "
                      f"ELSE '' END AS {PREFIX}{snake(name)}")
    ctes.append(f"""digits_t AS (SELECT *, CASE WHEN ltrim({digits}, '0') = '' THEN '0'
        ELSE ltrim({digits}, '0') END AS digits FROM {last})""")
    ctes.append(f"""decoded AS (SELECT * EXCLUDE (ok, l0, l1, l2, digits), {', '.join(fields)} FROM (
      SELECT *, CASE WHEN NOT coalesce(length(cuf) >= 42, false) THEN 'short_code'
        WHEN NOT ok THEN 'not_hex' WHEN length(digits) <= 27 THEN 'short_decimal'
        WHEN length(digits) - 27 < 24 THEN 'short_tail' ELSE 'ok' END AS decode_status FROM digits_t))""")
    return ctes, "decoded"


DEC_CTES, _ = _decode_ctes("v_tax")
FIELD_LIST = ", ".join(FIELDS)


@register("cuf_decode", S.with_views(f"SELECT nro, cuf, decode_status, {FIELD_LIST} FROM decoded",
                                     "v_tax", ctes=tuple(DEC_CTES)))
def q_cuf_decode(spark, sf_dir):
    return decoded(spark, sf_dir).select("nro", "cuf", "decode_status", *FIELDS)


def _fill_sql() -> str:
    parts = [f"""SELECT '{f}' AS field, count(*) AS total_rows,
        count(*) FILTER (WHERE length({f}) > 0) AS populated_rows,
        count(*) FILTER (WHERE NOT coalesce(length({f}) > 0, false)) AS empty_rows,
        round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE length({f}) > 0) / count(*) * 100 ELSE 0 END, 6)
          AS fill_rate FROM decoded""" for f in FIELDS]
    return "\nUNION ALL\n".join(parts)


@register("fill_rate", S.with_views(_fill_sql(), "v_tax", ctes=tuple(DEC_CTES)))
def q_fill_rate(spark, sf_dir):
    return present(P.fill_rate(decoded(spark, sf_dir), FIELDS), ratio_cols=("fill_rate",))


@register("decode_stats", S.with_views(
    """SELECT decode_status, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share_pct,
      decode_status = 'ok' AS decoded FROM decoded GROUP BY decode_status""", "v_tax", ctes=tuple(DEC_CTES)))
def q_decode_stats(spark, sf_dir):
    return present(P.decode_stats(decoded(spark, sf_dir)), ratio_cols=("share_pct",))


def _topk_sql(k: int = 3) -> str:
    unions = " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM decoded" for f in FIELDS)
    return f"""SELECT field, n_distinct, rnk AS rank, value, n, round(n / rows * 100, 6) AS share_pct FROM (
      SELECT c.*, d.n_distinct, (SELECT count(*) FROM decoded) AS rows,
        row_number() OVER (PARTITION BY c.field ORDER BY c.n DESC, c.value ASC) AS rnk
      FROM (SELECT field, value, count(*) AS n FROM ({unions}) WHERE value IS NOT NULL GROUP BY 1, 2) c
      JOIN (SELECT field, count(DISTINCT value) AS n_distinct FROM ({unions}) GROUP BY 1) d USING (field))
    WHERE rnk <= {k}"""


@register("value_topk", S.with_views(_topk_sql(), "v_tax", ctes=tuple(DEC_CTES)))
def q_value_topk(spark, sf_dir):
    return present(P.value_topk(decoded(spark, sf_dir), FIELDS, k=3), ratio_cols=("share_pct",))


@register("sales_by_branch", S.with_views(
    """SELECT sucursal, sector, count(*) AS n,
      CAST(round(coalesce(sum(CAST(importe AS DECIMAL(24,4))), 0), 2) AS DOUBLE) AS total,
      CAST(sum(CAST(importe AS DECIMAL(24,4))) AS DOUBLE) / count(importe) AS mean
    FROM v_tax GROUP BY sucursal, sector""", "v_tax"))
def q_sales_by_branch(spark, sf_dir):
    tax = v_tax(Tables(spark, sf_dir))
    return present(P.group_summary(tax, ["sucursal", "sector"], "importe"))


@register("fill_blank", S.with_views(
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) FILTER (WHERE {S.strip(c)} = '') AS blank_rows FROM v_tax"
        for c in ("importe_txt", "control", "fecha_txt")), "v_tax"))
def q_fill_blank(spark, sf_dir):
    return P.blank_counts(v_tax(Tables(spark, sf_dir)), ["importe_txt", "control", "fecha_txt"])

