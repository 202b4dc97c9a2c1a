"""Row filters of the reconciliation (F1-F8) and the period resolver."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MONTH_NAMES, ReconConfig
from ..functions.predicates import col


def modality_filter(df: DataFrame, column: str, modality: str | None = "2") -> DataFrame:
    """Keep rows whose modality equals ``modality``; a missing column or a
    ``None`` modality passes every row."""
    if modality is None or column not in df.columns:
        return df
    return df.filter(col(column) == F.lit(modality))


def sector_exclude(df: DataFrame, column: str, sector: str | None = "02") -> DataFrame:
    """Drop rows of one sector; NULL sectors stay (null-safe inequality)."""
    if sector is None or column not in df.columns:
        return df
    return df.filter(~col(column).eqNullSafe(F.lit(sector)))


def reconcilable(tax: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Tax rows that take part in the reconciliation (F1 then F2)."""
    out = modality_filter(tax, cfg.tax.modality, cfg.modality)
    return sector_exclude(out, cfg.tax.sector, cfg.excluded_sector)


def resolve_period(year: int, month_name: str) -> tuple[str, str]:
    """First and last day of a month given by its Spanish name in any case,
    as ISO dates for filter literals (no Spark job)."""
    wanted = month_name.strip().upper()
    month = next((i for i, known in enumerate(MONTH_NAMES, 1) if known == wanted), None)
    if month is None:
        raise ValueError(f"{month_name!r} is no month; expected one of {list(MONTH_NAMES)}")
    first = date(year, month, 1)
    after = date(year + month // 12, month % 12 + 1, 1)
    return first.isoformat(), (after - timedelta(days=1)).isoformat()


def period_bounds_of(df: DataFrame, date_col: str) -> DataFrame:
    """F6/X17 over data: every (year, month) present in ``date_col`` with
    its Spanish month name, first and last day, and row count. The bounds
    are resolved back from the name (case-insensitive), as a caller would."""
    names_arr = F.array(*[F.lit(n) for n in MONTH_NAMES])
    by_month = (df.groupBy(F.year(date_col).cast("bigint").alias("year"), F.month(date_col).alias("__m"))
                  .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    named = by_month.withColumn("month_name", F.lower(F.element_at(names_arr, F.col("__m"))))
    lookup = F.create_map(*[x for i, n in enumerate(MONTH_NAMES, 1) for x in (F.lit(n), F.lit(i))])
    start = F.make_date(F.col("year").cast("int"), F.element_at(lookup, F.upper(F.btrim("month_name"))), F.lit(1))
    return named.select("year", "month_name", start.alias("period_start"),
                        F.last_day(start).alias("period_end"), "n")
