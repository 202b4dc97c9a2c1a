"""Row predicates over Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# characters Python's str.strip() removes in practice from register text
WHITESPACE = " \t\r\n\x0b\x0c"


def col(name: str) -> Column:
    """A column by its exact name: register headers may contain dots or
    spaces ("NRO."), which ``F.col`` would read as a struct path."""
    return F.col(name if name.startswith("`") else f"`{name}`")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_canceled(status: Column | None, valid_word: str = "VALIDA") -> Column:
    """True unless the status, trimmed and upper-cased, is the valid word.

    NULL counts as canceled (it is not the valid word). Without a status
    column nothing is canceled.
    """
    if status is None:
        return F.lit(False)
    return F.coalesce(F.upper(strip(status.cast("string"))), F.lit("")) != F.lit(valid_word)


def as_double(c: Column) -> Column:
    """``float(x)`` with failures as NULL (NaN is also NULL)."""
    d = strip(c.cast("string")).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def as_int_trunc(c: Column) -> Column:
    """``int(float(x))`` with failures as NULL (truncates toward zero)."""
    return as_double(c).try_cast("bigint")


def clean_nit(c: Column) -> Column:
    """Customer id normalised for comparison: trim, upper, drop ' ', '-', '.'.

    NULL is treated as the empty string.
    """
    return F.translate(F.upper(strip(F.coalesce(c.cast("string"), F.lit("")))), " -.", "")


def numeric(df, name: str) -> Column:
    """``float(x)`` for a column of ``df``: numeric columns are cast
    directly, text goes through the lenient parse (NaN becomes NULL)."""
    from pyspark.sql.types import NumericType

    dtype = df.schema[name].dataType
    if isinstance(dtype, NumericType):
        d = col(name).cast("double")
        return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
    return as_double(col(name))


def money(c: Column) -> Column:
    """Amount as an exact decimal for sums: partition order cannot change
    the total (floating sums would). An amount that does not fit is NULL,
    like one that cannot be parsed."""
    return c.try_cast("decimal(24,4)")


def round2(c: Column) -> Column:
    return F.round(c, 2).cast("double")
