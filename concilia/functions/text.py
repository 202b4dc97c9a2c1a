"""Scalar cleaning functions of the accounting-register mapping (X3-X11,
X17, X18). Each returns a Column (value) or a pair (value, warning flag);
all are built-in expressions, evaluated inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import WHITESPACE, strip

# Date layouts tried in order before the lenient timestamp cast, each
# with the text shape it can parse (a layout is only tried on its shape,
# so non-matching layouts cost a regex test, not a parse failure).
DATE_PATTERNS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
)


def is_null_or_empty(c: Column) -> Column:
    """NULL or the empty string (before trimming)."""
    return c.isNull() | (c.cast("string") == F.lit(""))


_blank = is_null_or_empty


def to_decimal(c: Column, precision: int = 14, scale: int = 2) -> tuple[Column, Column]:
    """Text or number to decimal(p, s), rounding half to even.

    Blank -> 0.00 without warning; unparsable -> 0.00 with warning; a value
    that does not fit decimal(p, s) -> NULL with warning (never silently 0).
    """
    s = strip(c.cast("string"))
    parsed = s.try_cast("decimal(38,10)")
    rounded = F.bround(parsed, scale).try_cast(f"decimal({precision},{scale})")
    zero = F.lit(0).cast(f"decimal({precision},{scale})")
    value = (F.when(_blank(c), zero)
              .when(parsed.isNull(), zero)
              .otherwise(rounded))
    warn = ~_blank(c) & (parsed.isNull() | rounded.isNull())
    return value, warn


def to_date_multi(c: Column, patterns: tuple = DATE_PATTERNS) -> tuple[Column, Column]:
    """First layout that parses wins, then a lenient timestamp cast.
    Blank -> NULL without warning; unparsable -> NULL with warning."""
    s = c.cast("string")
    tries = [F.when(s.rlike(shape), F.try_to_date(s, p)) for p, shape in patterns]
    value = F.when(_blank(c), F.lit(None).cast("date")).otherwise(
        F.coalesce(*tries, F.to_date(s.try_cast("timestamp"))))
    return value, ~_blank(c) & value.isNull()


def truncate(c: Column, n: int) -> tuple[Column, Column]:
    """Trim, cut to n characters, empty -> NULL; warning when cut."""
    s = strip(c.cast("string"))
    value = F.when(_blank(c), F.lit(None).cast("string")).otherwise(F.nullif(F.left(s, F.lit(n)), F.lit("")))
    return value, ~_blank(c) & (F.length(s) > n)


def clean_nit_text(c: Column, n: int = 15) -> tuple[Column, Column]:
    """Trim, upper, drop ' ', '-', '.', cut to n; NULL/blank -> ''."""
    s = F.translate(F.upper(strip(c.cast("string"))), " -.", "")
    value = F.when(_blank(c), F.lit("")).otherwise(F.left(s, F.lit(n)))
    return value, ~_blank(c) & (F.length(s) > n)


def _strip_zeros(s: Column) -> Column:
    return F.regexp_replace(s, "^0+", "")


def normalize_invoice(c: Column, n: int = 15) -> tuple[Column, Column]:
    """Drop leading zeros; all zeros keeps the trimmed original; cut n."""
    s = strip(c.cast("string"))
    z = _strip_zeros(s)
    value = (F.when(_blank(c), F.lit(""))
              .when(z == "", s)
              .otherwise(F.left(z, F.lit(n))))
    return value, ~_blank(c) & (z != "") & (F.length(z) > n)


def normalize_control(c: Column) -> Column:
    """Blank control code -> '0', otherwise trimmed."""
    return F.when(_blank(c), F.lit("0")).otherwise(strip(c.cast("string")))


def normalize_code(c: Column) -> Column:
    """Branch or sector without leading zeros; all zeros -> '0';
    NULL/blank -> ''."""
    z = _strip_zeros(strip(c.cast("string")))
    return F.when(_blank(c), F.lit("")).when(z == "", F.lit("0")).otherwise(z)


def text_or_empty(c: Column) -> Column:
    """X11: NULL -> '' (value kept as is otherwise)."""
    return F.coalesce(c.cast("string"), F.lit(""))


def is_blank(c: Column) -> Column:
    """Empty after trimming."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE)) == F.lit("")
