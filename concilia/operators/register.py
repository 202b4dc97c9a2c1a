"""Mapping of the tax register to the typed accounting register (P2-P5,
X3-X11, J9, J10), its validation (A16) and transform statistics (A17).

The lookups by code (note, tax-only flag) are one aggregate with a row per
code (``min_by`` and ``max``, map-side combined) and one left join, which
AQE can split at a hot code or at the NULL codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import (DECIMAL_TARGETS, DEFAULT_AUTHOR, LENGTH_LIMITS, OBS_DOLLAR, OBS_NOT_IN_LEDGER,
                      OBS_RENTAL, REGISTER_COLUMN_MAP, REQUIRED_TARGETS)
from ..functions import text as X
from ..functions.predicates import col, strip
from .skew import join_unique

# target column -> (kind, arg)
_RULES = {
    "invoice_date": ("date", None),
    "customer_name": ("trunc", 240),
    "customer_nit": ("nit", 15),
    "authorization_code": ("trunc", 64),
    "invoice_number": ("invoice", 15),
    "complement": ("trunc", 5),
    "control_code": ("control", None),
    "status": ("text", None),
    "sale_type": ("text", None),
    "consolidation_status": ("text", None),
    "branch_office": ("code", None),
    "sector": ("code", None),
    "modality": ("trunc", 10),
    "emission_type": ("trunc", 10),
    "invoice_type": ("trunc", 10),
}


def map_column(target: str, c: Column) -> tuple[Column, Column | None]:
    """Value and warning flag (or None) for one target column."""
    if target in DECIMAL_TARGETS:
        return X.to_decimal(c)
    kind, arg = _RULES.get(target, ("plain", None))
    if kind == "date":
        return X.to_date_multi(c)
    if kind == "trunc":
        return X.truncate(c, arg)
    if kind == "nit":
        return X.clean_nit_text(c, arg)
    if kind == "invoice":
        return X.normalize_invoice(c, arg)
    if kind == "control":
        return X.normalize_control(c), None
    if kind == "text":
        return X.text_or_empty(c), None
    if kind == "code":
        return X.normalize_code(c), None
    return c.cast("string"), None


def _prepare(target: str, c: Column, h: str) -> list[Column]:
    """Phase 1 of the mapping: the trimmed / parsed form of a source column
    that both the value and its warning read (named ``h`` + suffix)."""
    raw = c.cast("string")
    out = [X.is_null_or_empty(c).alias(f"{h}_b")]
    kind = "decimal" if target in DECIMAL_TARGETS else _RULES.get(target, ("plain", None))[0]
    if kind == "decimal":
        out.append(strip(raw).try_cast("decimal(38,10)").alias(f"{h}_p"))
    elif kind == "date":
        out.append(X.to_date_multi(c)[0].alias(f"{h}_d"))
    elif kind in ("trunc", "control", "code", "invoice"):
        out.append(strip(raw).alias(f"{h}_s"))
    elif kind == "nit":
        out.append(F.translate(F.upper(strip(raw)), " -.", "").alias(f"{h}_s"))
    return out


def _finish(target: str, c: Column, h: str) -> tuple[Column, Column | None]:
    """Phase 2: value and warning from the phase-1 columns (same rules as
    ``functions.text``)."""
    blank = F.col(f"{h}_b")
    kind, arg = ("decimal", None) if target in DECIMAL_TARGETS else _RULES.get(target, ("plain", None))
    if kind == "decimal":
        parsed = F.col(f"{h}_p")
        rounded = F.bround(parsed, 2).try_cast("decimal(14,2)")
        zero = F.lit(0).cast("decimal(14,2)")
        return (F.when(blank | parsed.isNull(), zero).otherwise(rounded),
                ~blank & (parsed.isNull() | rounded.isNull()))
    if kind == "date":
        d = F.col(f"{h}_d")
        return d, ~blank & d.isNull()
    if kind in ("trunc", "nit", "invoice", "control", "code"):
        st = F.col(f"{h}_s")
        if kind == "trunc":
            return (F.when(blank, F.lit(None).cast("string")).otherwise(F.nullif(F.left(st, F.lit(arg)), F.lit(""))),
                    ~blank & (F.length(st) > arg))
        if kind == "nit":
            return F.when(blank, F.lit("")).otherwise(F.left(st, F.lit(arg))), ~blank & (F.length(st) > arg)
        if kind == "control":
            return F.when(blank, F.lit("0")).otherwise(st), None
        z = F.regexp_replace(st, "^0+", "")
        if kind == "code":
            return F.when(blank, F.lit("")).when(z == "", F.lit("0")).otherwise(z), None
        return (F.when(blank, F.lit("")).when(z == "", st).otherwise(F.left(z, F.lit(arg))),
                ~blank & (z != "") & (F.length(z) > arg))
    return map_column(target, c)


def glosa_lookup(ledger: DataFrame, key: str = "cuf", glosa: str = "glosa",
                 order: tuple = ("fechaFac", "numeroFactura", "idFactura")) -> DataFrame:
    """One note per code. Among ledger rows with a non-null note, the
    one that came last in the source order (newest first) wins, i.e. the
    oldest by ``order``; an empty note then reads as NULL."""
    rows = ledger.filter(col(key).isNotNull() & col(glosa).isNotNull())
    pick = F.min_by(col(glosa).cast("string"), F.struct(*[col(c) for c in order]))
    return (rows.groupBy(col(key).alias("authorization_code"))
                .agg(F.nullif(pick, F.lit("")).alias("obs")))


def _no_order(ledger: DataFrame | None, order: tuple) -> list:
    """NULLs in place of the ledger's order columns."""
    if ledger is None:
        return []
    return [F.lit(None).cast(ledger.select(col(c)).schema[0].dataType).alias(f"__o{i}") for i, c in enumerate(order)]


def map_register(tax: DataFrame, column_map: tuple = REGISTER_COLUMN_MAP,
                 only_tax: DataFrame | None = None, only_tax_key: str | None = None,
                 ledger: DataFrame | None = None, ledger_key: str = "cuf", ledger_glosa: str = "glosa",
                 ledger_order: tuple = ("fechaFac", "numeroFactura", "idFactura"),
                 author: str = DEFAULT_AUTHOR, keep: tuple = ()) -> DataFrame:
    """Typed accounting-register rows, one per tax row.

    Source columns missing from ``tax`` are skipped. Adds ``author``,
    ``right_to_tax_credit``, ``obs`` (ledger note), ``observations`` and
    per-row ``warnings`` (count of lenient conversions). ``keep`` columns
    of ``tax`` are passed through unchanged.
    """
    sources = {t: s for s, t in column_map if s in tax.columns}
    if "authorization_code" not in sources:
        raise ValueError("tax register has no authorization code column")
    code_src = sources["authorization_code"]
    sector_src = sources.get("sector")
    # two projections: parse/trim each source once, then values and flags
    # (phase-1 columns are read twice, so the optimizer keeps them apart)
    helpers = {t: f"__m{i}" for i, t in enumerate(sources)}
    staged = tax.select(
        *[F.col(f"`{k}`") for k in keep],
        *[F.col(f"`{src}`").alias(f"{helpers[t]}_raw") for t, src in sources.items()],
        *[x for t, src in sources.items() for x in _prepare(t, F.col(f"`{src}`"), helpers[t])],
        F.col(f"`{code_src}`").cast("string").alias("__code"),
        (strip(F.col(f"`{sector_src}`").cast("string")) if sector_src else F.lit(None).cast("string"))
        .alias("__sector"))
    cols, warns = [], []
    for target in sources:
        v, w = _finish(target, F.col(f"{helpers[target]}_raw"), helpers[target])
        cols.append(v.alias(target))
        if w is not None:
            warns.append(F.when(w, 1).otherwise(0))
    base = staged.select(
        *[F.col(f"`{k}`") for k in keep], *cols, "__code", "__sector",
        (sum(warns[1:], warns[0]) if warns else F.lit(0)).alias("warnings"))

    # one lookup row per code: the flag and the note arrive with one join
    lookups = []
    if only_tax is not None:
        key = only_tax_key or code_src
        lookups.append(only_tax.select(F.col(f"`{key}`").cast("string").alias("__code"), F.lit(True).alias("__only_tax"),
                                       F.lit(None).cast("string").alias("__note"), *_no_order(ledger, ledger_order)))
    if ledger is not None:
        noted = ledger.filter(col(ledger_key).isNotNull() & col(ledger_glosa).isNotNull())
        lookups.append(noted.select(col(ledger_key).cast("string").alias("__code"), F.lit(None).cast("boolean").alias("__only_tax"),
                                    col(ledger_glosa).cast("string").alias("__note"),
                                    *[col(c).alias(f"__o{i}") for i, c in enumerate(ledger_order)]))
    if lookups:
        rows = lookups[0] if len(lookups) == 1 else lookups[0].unionByName(lookups[1])
        aggs = [F.max("__only_tax").alias("__only_tax")]
        if ledger is not None:
            order = F.when(F.col("__note").isNotNull(), F.struct(*[f"__o{i}" for i in range(len(ledger_order))]))
            aggs.append(F.nullif(F.min_by("__note", order), F.lit("")).alias("obs"))
        found = rows.filter(F.col("__code").isNotNull()).groupBy("__code").agg(*aggs)
        base = join_unique(base, found, "__code")
    if only_tax is None and "__only_tax" not in base.columns:
        base = base.withColumn("__only_tax", F.lit(None).cast("boolean"))
    if ledger is None:
        base = base.withColumn("obs", F.lit(None).cast("string"))

    debit = F.col("debit_tax") if "debit_tax" in sources else F.lit(0).cast("decimal(14,2)")
    observations = (F.when(F.col("__sector") == "02", F.lit(OBS_RENTAL))
                     .when(F.col("__sector") == "35", F.lit(OBS_DOLLAR))
                     .when(F.coalesce(F.col("__only_tax"), F.lit(False)), F.lit(OBS_NOT_IN_LEDGER)))
    return (base.withColumn("right_to_tax_credit", F.when(debit > 0, 1).otherwise(0))
                .withColumn("author", F.lit(author))
                .withColumn("observations", observations)
                .drop("__code", "__sector", "__only_tax"))


def validate_register(df: DataFrame) -> DataFrame:
    """One row per violated rule (rule, column, n_rows); empty means
    valid. Rules: required not null, amounts that fit their decimal, numeric
    amounts where they come as text, length limits.
    One aggregation pass, then unpivot and filter."""
    rules = []
    for c in REQUIRED_TARGETS:
        if c in df.columns:
            rules.append(("not_null", c, col(c).isNull()))
    for c in DECIMAL_TARGETS:
        if c in df.columns:
            # the mapping writes 0 for blank or unparsable amounts; NULL is left by one that does not fit
            rules.append(("overflow", c, col(c).isNull()))
            if not isinstance(df.schema[c].dataType, NumericType):
                rules.append(("numeric", c, col(c).isNotNull() & col(c).cast("string").try_cast("double").isNull()))
    for c, n in LENGTH_LIMITS:
        if c in df.columns:
            rules.append(("max_length", c, F.length(F.coalesce(col(c).cast("string"), F.lit("None"))) > n))
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, column string, n_rows bigint")
    one = df.agg(*[F.count(F.when(cond, 1)).alias(f"__r{i}") for i, (_, _, cond) in enumerate(rules)])
    stack = ", ".join(f"'{r}', '{c}', `__r{i}`" for i, (r, c, _) in enumerate(rules))
    return (one.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, column, n_rows)")
               .withColumn("n_rows", F.col("n_rows").cast("bigint"))
               .filter(F.col("n_rows") > 0))


def is_valid(issues: DataFrame) -> DataFrame:
    """One row: True when no rule is violated (gate for the load)."""
    return issues.agg((F.count(F.lit(1)) == 0).alias("is_valid"))


def transform_stats(mapped: DataFrame) -> DataFrame:
    """Rows, rows mapped, rows failed (always 0: no row can fail a
    Column expression) and lenient-conversion warnings."""
    return mapped.agg(F.count(F.lit(1)).cast("bigint").alias("total_rows"),
                      F.count(F.lit(1)).cast("bigint").alias("successful"),
                      F.lit(0).cast("bigint").alias("errors"),
                      F.coalesce(F.sum("warnings"), F.lit(0)).cast("bigint").alias("warnings"))
