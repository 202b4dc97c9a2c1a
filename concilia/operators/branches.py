"""Per-branch breakdown (A3), two-sided branch comparison (A4) and the
union of branch keys (O2). Branch tables are tiny (one row per branch)
after a partially aggregated groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BRANCH_NAMES
from ..functions.predicates import money, numeric


def branch_key(df: DataFrame, branch_col: str) -> Column:
    """Branch code as the text of its integer value ('0000' and '0' are the
    same branch); unparsable codes go to 'unknown'; NULL stays NULL."""
    code = numeric(df, branch_col).try_cast("bigint").cast("string")
    return F.when(F.col(branch_col).isNull(), F.lit(None).cast("string")) \
            .otherwise(F.coalesce(code, F.lit("unknown")))


def branch_breakdown(df: DataFrame, branch_col: str, amount_col: str,
                     canceled: Column | None = None) -> DataFrame:
    """A3: per branch, count and amount of valid rows and count of canceled
    rows. Branches holding only canceled rows still appear; NULL branch
    codes are skipped."""
    c = canceled if canceled is not None else F.lit(False)
    amt = money(numeric(df, amount_col))
    return (df.select(branch_key(df, branch_col).alias("branch_code"), c.alias("_c"), amt.alias("_a"))
              .filter(F.col("branch_code").isNotNull())
              .groupBy("branch_code")
              .agg(F.count(F.when(~F.col("_c"), 1)).alias("count"),
                   F.coalesce(F.sum(F.when(~F.col("_c"), F.col("_a"))), F.lit(0).cast("decimal(24,4)"))
                    .alias("amount"),
                   F.count(F.when(F.col("_c"), 1)).alias("canceled_count")))


def scoped_breakdown(df: DataFrame, branch_col: str, amount_col: str, scoped: str, everything: Column,
                     canceled: Column | None = None) -> DataFrame:
    """``branch_breakdown`` of the rows marked by ``scoped``, or of all rows
    where the scalar ``everything`` is true: one aggregation either way."""
    c = canceled if canceled is not None else F.lit(False)
    rows = df.select(branch_key(df, branch_col).alias("branch_code"), c.alias("_c"), money(numeric(df, amount_col)).alias("_a"),
                     F.col(scoped).alias("_s")).filter(F.col("branch_code").isNotNull())
    zero = F.lit(0).cast("decimal(24,4)")

    def of(name: str, rows_of: Column) -> Column:
        valid = rows_of & ~F.col("_c")
        return F.struct(F.count(F.when(rows_of, 1)).alias("rows"), F.count(F.when(valid, 1)).alias("count"),
                        F.coalesce(F.sum(F.when(valid, F.col("_a"))), zero).alias("amount"),
                        F.count(F.when(rows_of & F.col("_c"), 1)).alias("canceled_count")).alias(name)

    both = rows.groupBy("branch_code").agg(of("_all", F.lit(True)), of("_in", F.col("_s")))
    chosen = both.select("branch_code", F.when(everything, F.col("_all")).otherwise(F.col("_in")).alias("_r"))
    return chosen.filter("_r.rows > 0").select("branch_code", "_r.count", "_r.amount", "_r.canceled_count")


def branch_names(names: dict | None = None) -> Column:
    m = names or BRANCH_NAMES
    lookup = F.create_map(*[x for k, v in sorted(m.items()) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(lookup, F.col("branch_code")),
                      F.concat(F.lit("Branch "), F.col("branch_code")))


def compare_branches(tax_branches: DataFrame, ledger_branches: DataFrame,
                     threshold_pct: float = 0.5, names: dict | None = None) -> DataFrame:
    """A4: full outer join of two breakdowns, missing side = 0, with count
    and amount differences, percent of the ledger amount, OK/WARNING."""
    t = tax_branches.select("branch_code", F.col("count").alias("tax_count"),
                            F.col("canceled_count").alias("tax_canceled"),
                            F.col("amount").alias("tax_amount"), F.lit(True).alias("in_tax"))
    lg = ledger_branches.select("branch_code", F.col("count").alias("inv_count"),
                                F.col("amount").alias("inv_amount"))
    j = t.join(lg, "branch_code", "full_outer")
    zero = F.lit(0).cast("decimal(24,4)")
    tax_amount = F.coalesce(F.col("tax_amount"), zero)
    inv_amount = F.coalesce(F.col("inv_amount"), zero)
    diff = tax_amount - inv_amount
    pct = F.when(inv_amount > 0, diff.cast("double") / inv_amount.cast("double") * 100).otherwise(F.lit(0.0))
    return j.select(
        "branch_code",
        branch_names(names).alias("branch_name"),
        F.coalesce(F.col("tax_count"), F.lit(0)).cast("bigint").alias("tax_count"),
        F.coalesce(F.col("tax_canceled"), F.lit(0)).cast("bigint").alias("tax_canceled"),
        tax_amount.alias("tax_amount"),
        F.coalesce(F.col("inv_count"), F.lit(0)).cast("bigint").alias("inv_count"),
        inv_amount.alias("inv_amount"),
        (F.coalesce(F.col("tax_count"), F.lit(0)) - F.coalesce(F.col("inv_count"), F.lit(0)))
         .cast("bigint").alias("count_diff"),
        diff.alias("amount_diff"),
        pct.alias("amount_diff_pct"),
        F.when(F.abs(pct) <= threshold_pct, F.lit("OK")).otherwise(F.lit("WARNING")).alias("status"),
        F.coalesce(F.col("in_tax"), F.lit(False)).alias("in_tax"),
    )


def branch_issue_count(branch_report: DataFrame, threshold_pct: float = 0.5) -> DataFrame:
    """One row: number of tax branches whose amount differs from a positive
    ledger amount by more than the threshold (status ladder input)."""
    bad = (F.col("in_tax") & (F.col("inv_amount") > 0) &
           (F.abs(F.col("amount_diff_pct")) > threshold_pct))
    return branch_report.agg(F.count(F.when(bad, 1)).cast("bigint").alias("branches_with_issues"))


def branch_union(*frames_and_cols: tuple[DataFrame, str]) -> DataFrame:
    """O2: distinct branch codes seen in any of the given (frame, column)."""
    parts = [df.select(branch_key(df, c).alias("branch_code")) for df, c in frames_and_cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("branch_code").isNotNull()).distinct()
