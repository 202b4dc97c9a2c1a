"""Report tables (K1-K4): one DataFrame per sheet of the reconciliation
report, written as ``<root>/report=<sheet>/`` directories. Numbers stay
numeric; text formatting happens only in ``formatted`` views."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M

# Summary sheet rows: label and the statistic behind it.
SUMMARY_ROWS = (
    ("tax rows compared", "total_tax"),
    ("ledger rows", "total_ledger"),
    ("pairs without a difference", "matched_count"),
    ("match rate, percent", "match_rate"),
    ("valid tax amount", "total_tax_amount"),
    ("ledger amount", "total_ledger_amount"),
    ("difference of amounts", "amount_difference"),
    ("difference of amounts, percent", "amount_difference_pct"),
    ("rows in tax only", "only_tax_count"),
    ("rows in ledger only", "only_ledger_count"),
    ("pairs with another amount", "amount_mismatch_count"),
    ("pairs with another customer", "customer_mismatch_count"),
    ("pairs with another invoice or branch", "other_mismatch_count"),
    ("issues in all", "total_issues"),
)
ROUNDING = {"match_rate": 2, "amount_difference_pct": 4, "total_tax_amount": 2, "total_ledger_amount": 2,
            "amount_difference": 2}


def summary_table(stats: DataFrame) -> DataFrame:
    """K3 Summary sheet as (position, metric, value) rows."""
    cols = [F.round(F.col(c).cast("double"), ROUNDING.get(c, 0)).alias(f"__v{i}")
            for i, (_, c) in enumerate(SUMMARY_ROWS)]
    stack = ", ".join(f"{i}, '{label}', `__v{i}`" for i, (label, _) in enumerate(SUMMARY_ROWS))
    return stats.select(*cols).selectExpr(f"stack({len(SUMMARY_ROWS)}, {stack}) AS (position, metric, value)")


def formatted_summary(summary: DataFrame) -> DataFrame:
    """K3/X16 text view: thousands separators; counts without decimals,
    amounts and the match rate with two, the difference in percent with four."""
    places = F.lit(0)
    for i, (_, c) in enumerate(SUMMARY_ROWS):
        if c in ROUNDING:
            places = F.when(F.col("position") == i, F.lit(ROUNDING[c])).otherwise(places)
    text = F.when(places == 0, F.format_number("value", 0)).when(places == 2, F.format_number("value", 2)) \
        .otherwise(F.format_number("value", 4))
    return summary.withColumn("text", text)


#: Sheets of register rows and the flag of a pair that puts it there; a row of one register alone has no pair.
PAIR_SHEETS = (("perfect_matches", "perfect_match"), ("amount_mismatches", "amount_mismatch"),
               ("customer_mismatches", "customer_mismatch"), ("other_mismatches", "other_mismatch"))
ROW_SHEETS = ("only_in_tax", "only_in_ledger", *(name for name, _ in PAIR_SHEETS))
SHEET = "report"
#: How CSV is written: values as they are.
CSV = {"header": True, "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def sheet_rows(recon) -> DataFrame:
    """Every row of the six row sheets, with its sheet in ``report``: columns
    of the tax register (``tax_``) and of the ledger (``inv_``), NULL where a
    row has no partner, and the flags of a pair. A pair with two kinds of
    mismatch is in two sheets.

    One left join of the tax register with the ledger gives pairs and tax rows
    without a partner, one anti join the ledger rows without one; AQE splits a
    hot code in both, and the ledger's exchange serves both. Stored registers
    are joined part by part, so that bucketed rows are not moved; rows without
    a code are in no sheet."""
    parts = [p for p in recon.parts if not p.keyless] or [recon]
    return reduce(DataFrame.unionByName, map(_part_rows, parts)).withColumn(SHEET, F.explode(SHEET))


def _part_rows(recon) -> DataFrame:
    """The rows of ``sheet_rows`` for registers of one part, each with the array of its sheets."""
    flags = [F.when(F.col(flag), F.lit(name)) for name, flag in PAIR_SHEETS]
    both = M.compare_pairs(recon.tax, recon.ledger, recon.cfg, how="left")
    alone = F.col(M.PARTNER).isNull()
    both = both.withColumn(SHEET, F.when(alone, F.array(F.lit("only_in_tax"))).otherwise(F.array_compact(F.array(*flags))))
    ledger = M.unpaired_ledger(recon.tax, recon.ledger, recon.cfg).withColumn(SHEET, F.array(F.lit("only_in_ledger")))
    return both.drop(M.PARTNER).unionByName(ledger, allowMissingColumns=True)


def sheets(recon) -> dict[str, DataFrame]:
    """All report sheets; empty ones are dropped at write time."""
    return {"summary": summary_table(recon.stats()), "branch_breakdown": recon.branch_report()} | {
        name: sheet_rows(recon).filter(F.col(SHEET) == name).drop(SHEET) for name in ROW_SHEETS}


def write_report(recon, root: str, fmt: str = "parquet", skip_empty: bool = True, stats: DataFrame | None = None,
                 branches: DataFrame | None = None) -> list[str]:
    """K3/K4: write every sheet under ``root``; returns the sheets that have
    rows. The row sheets are one frame, written in one pass with a folder per
    sheet; how many rows each has is observed while they are written, in the
    stage that writes, so a task that runs again does not count twice. A sheet
    without rows is left out, unless an earlier run left some under the same
    root: these are overwritten, so no old sheet is taken for a new one.
    ``stats`` and ``branches``: the statistics and the branch report, where
    they are known already."""
    root = root.rstrip("/")
    seen = Observation()
    rows = sheet_rows(recon)
    counted = rows.observe(seen, *[F.count(F.when(F.col(SHEET) == n, 1)).alias(n) for n in ROW_SHEETS])
    if fmt == "csv":
        counted = counted.withColumn("mismatch_types", F.array_join("mismatch_types", "+"))
    _writer(counted, fmt).partitionBy(SHEET).option("partitionOverwriteMode", "dynamic").save(root)
    found = seen.get
    written = [n for n in ROW_SHEETS if found[n]]
    for name in ROW_SHEETS:
        path = f"{root}/{SHEET}={name}"
        if not found[name] and (not skip_empty or _exists(rows, path)):
            _writer(rows.filter(F.lit(False)).drop(SHEET), fmt).save(path)
            written += [] if skip_empty else [name]
    small = {"summary": summary_table(recon.stats() if stats is None else stats),
             "branch_breakdown": recon.branch_report() if branches is None else branches}
    for name, df in small.items():
        seen = Observation()
        _writer(df.observe(seen, F.count(F.lit(1)).alias("n")), fmt).save(f"{root}/{SHEET}={name}")
        if seen.get["n"] or not skip_empty:
            written.append(name)
    return [n for n in ("summary", "branch_breakdown", *ROW_SHEETS) if n in written]


def _writer(df: DataFrame, fmt: str):
    w = df.write.mode("overwrite").format(fmt)
    return w.options(**CSV) if fmt == "csv" else w


def _exists(df: DataFrame, path: str) -> bool:
    """Whether an earlier run wrote to ``path``."""
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        return not files.load(path).select("path").isEmpty()
    except AnalysisException:
        return False


def write_csv(df: DataFrame, path: str) -> None:
    """K1/K2: CSV with header, UTF-8 (a byte-order mark is not written);
    values keep the white space around them, and empty texts stay apart from
    missing values."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_csv`` wrote: a field without anything is missing, one of
    two quotes an empty text (Spark takes both for missing unless the text for
    missing values is another one)."""
    return spark.read.options(**CSV).option("nullValue", "\u0001").schema(schema).csv(path)
