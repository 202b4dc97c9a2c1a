"""Registered queries over the supplied tables and their DuckDB oracles.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
columns are presented in comparison-friendly types (decimals rounded to
two places as double, dates as ISO text, integers as bigint). The oracle
text builds the same derived views (``fixtures/sql.py``) and applies the
same rules in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def present(df: DataFrame, ratio_cols: tuple = ()) -> DataFrame:
    """Cast result columns to comparison-friendly types."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if f.name in ratio_cols:
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, T.DecimalType):
            c = F.round(c, 2).cast("double")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.FloatType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def load_all() -> None:
    """Import the query modules (they register on import)."""
    from .plans import queries_core, queries_cuf, queries_register, queries_upsert, queries_ledger, queries_misc  # noqa: F401
