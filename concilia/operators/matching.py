"""Key matching between the tax register and the ledger
and field comparison of matched pairs (C2-C5).

* Per-key counts of each side are aggregated with map-side partial
  aggregation, so a hot key costs one row per map task, not one per row.
* Every row is tagged by a left join with the other side's key counts
  through ``skew.join_unique``, so AQE can split a hot key's rows.
* Pairs for field comparison join the two registers on the key; counts of
  pairs come from reduced sides with multiplicities instead.

Rows with a NULL key are filtered out before the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReconConfig
from ..functions.predicates import clean_nit, col, is_canceled, numeric
from .skew import join_unique

KEY = "match_key"
#: Set on rows of an outer comparison that have a partner.
PARTNER = "has_partner"


def _with_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(KEY, col(key))


def tax_key_counts(tax: DataFrame, cfg: ReconConfig) -> DataFrame:
    """(match_key, n_tax, n_tax_valid) over non-null keys."""
    canceled = is_canceled(col(cfg.tax.status), cfg.valid_status) \
        if cfg.tax.status in tax.columns else F.lit(False)
    return (tax.select(col(cfg.tax.key).alias(KEY), canceled.alias("_c"))
               .filter(F.col(KEY).isNotNull())
               .groupBy(KEY)
               .agg(F.count(F.lit(1)).alias("n_tax"),
                    F.count(F.when(~F.col("_c"), 1)).alias("n_tax_valid")))


def ledger_key_counts(ledger: DataFrame, cfg: ReconConfig) -> DataFrame:
    """(match_key, n_ledger) over non-null keys."""
    return (ledger.select(col(cfg.ledger.key).alias(KEY))
                  .filter(F.col(KEY).isNotNull())
                  .groupBy(KEY).agg(F.count(F.lit(1)).alias("n_ledger")))


def _tagged(rows: DataFrame, counts: DataFrame, stored: bool) -> DataFrame:
    """``stored``: both registers are bucketed by the key and hold no hot one, so a plain join moves no rows."""
    return rows.join(counts, KEY, "left") if stored else join_unique(rows, counts, KEY)


def tag_tax(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig, stored: bool = False) -> DataFrame:
    """Tax rows with a non-null key, each tagged with the number of ledger
    rows sharing its key (0 = only in tax). Duplicates are kept."""
    t = _with_key(tax, cfg.tax.key).filter(F.col(KEY).isNotNull())
    out = _tagged(t, ledger_key_counts(ledger, cfg), stored)
    return out.withColumn("n_ledger", F.coalesce(F.col("n_ledger"), F.lit(0)))


def tag_ledger(ledger: DataFrame, tax: DataFrame, cfg: ReconConfig, stored: bool = False) -> DataFrame:
    """Ledger rows with a non-null key tagged with the number of (valid)
    tax rows sharing the key (0 = only in ledger)."""
    lg = _with_key(ledger, cfg.ledger.key).filter(F.col(KEY).isNotNull())
    out = _tagged(lg, tax_key_counts(tax, cfg), stored)
    return (out.withColumn("n_tax", F.coalesce(F.col("n_tax"), F.lit(0)))
               .withColumn("n_tax_valid", F.coalesce(F.col("n_tax_valid"), F.lit(0))))


def matched(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Tax rows whose key is in the ledger (duplicates kept)."""
    return tax.filter(col(cfg.tax.key).isNotNull()).join(
        ledger.select(col(cfg.ledger.key).alias(cfg.tax.key)), cfg.tax.key, "left_semi")


def key_sets(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig) -> DataFrame:
    """O1 + J12 on distinct keys: one row per key with its side
    ('both', 'tax_only', 'ledger_only') and the copy count on each side."""
    keys = tax_key_counts(tax, cfg).join(ledger_key_counts(ledger, cfg), KEY, "full_outer")
    n_t = F.coalesce(F.col("n_tax"), F.lit(0))
    n_l = F.coalesce(F.col("n_ledger"), F.lit(0))
    side = (F.when((n_t > 0) & (n_l > 0), F.lit("both"))
             .when(n_t > 0, F.lit("tax_only")).otherwise(F.lit("ledger_only")))
    return keys.select(F.col(KEY), side.alias("side"), n_t.alias("n_tax"), n_l.alias("n_ledger"))


def _prefixed(df: DataFrame, prefix: str, keep: tuple = (KEY,)) -> DataFrame:
    return df.select(*[col(c).alias(c if c in keep else f"{prefix}{c}") for c in df.columns])


def compare_flags(tax_amount: Column, ledger_amount: Column, tax_nit: Column, ledger_nit: Column,
                  tax_inv: Column, ledger_inv: Column, tax_branch: Column, ledger_branch: Column,
                  tolerance: float) -> dict[str, Column]:
    """C2-C5 as Column expressions. Amounts, invoice numbers and branches
    come parsed to double (NULL when blank, NaN or unparsable); NULL never
    mismatches, except the customer id whose NULL compares as ''."""
    amount = F.coalesce(F.abs(tax_amount - ledger_amount) > F.lit(tolerance), F.lit(False))
    customer = clean_nit(tax_nit) != clean_nit(ledger_nit)
    invoice = F.coalesce(tax_inv.try_cast("bigint") != ledger_inv.try_cast("bigint"), F.lit(False))
    branch = F.coalesce(tax_branch.try_cast("bigint") != ledger_branch.try_cast("bigint"), F.lit(False))
    other = invoice | branch
    return {
        "amount_mismatch": amount,
        "customer_mismatch": customer,
        "invoice_mismatch": invoice,
        "branch_mismatch": branch,
        "other_mismatch": other,
        "perfect_match": ~(amount | customer | other),
    }


def _sides(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig) -> tuple[DataFrame, DataFrame]:
    return (_prefixed(_with_key(tax, cfg.tax.key).filter(F.col(KEY).isNotNull()), "tax_"),
            _prefixed(_with_key(ledger, cfg.ledger.key).filter(F.col(KEY).isNotNull()), "inv_"))


def unpaired_ledger(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig) -> DataFrame:
    """J3 with the columns of ``compare_pairs``: ledger rows whose key the tax register lacks."""
    t, lg = _sides(tax, ledger, cfg)
    return lg.join(t.select(KEY), KEY, "left_anti")


def compare_pairs(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig, how: str = "inner") -> DataFrame:
    """J4 + C2-C5: every (tax row, ledger row) pair sharing a non-null key,
    with the comparison flags: an inner equi-join (one shuffle of each
    side; AQE splits a skewed key's partition). Tax columns are prefixed
    ``tax_``, ledger ones ``inv_`` (the two registers share
    case-insensitive names). With ``how="left"`` also the tax rows without a
    partner: ``PARTNER`` is NULL on these, and so are the flags."""
    t, lg = _sides(tax, ledger, cfg)
    if how == "left":
        lg = lg.withColumn(PARTNER, F.lit(True))
    pairs = t.join(lg, KEY, how)
    flags = _pair_flags(pairs, cfg)
    if how == "left":
        flags = {k: F.when(F.col(PARTNER), v) for k, v in flags.items()}
    pairs = pairs.select("*", *[v.alias(k) for k, v in flags.items()])
    types = F.array_compact(F.array(
        F.when(F.col("amount_mismatch"), F.lit("amount")),
        F.when(F.col("customer_mismatch"), F.lit("customer")),
        F.when(F.col("other_mismatch"), F.lit("other"))))
    return pairs.withColumn("mismatch_types", types if how == "inner" else F.when(F.col(PARTNER), types))


def _pair_flags(pairs: DataFrame, cfg: ReconConfig) -> dict[str, Column]:
    tc, lc = cfg.tax, cfg.ledger
    return compare_flags(
        numeric(pairs, f"tax_{tc.amount}"), numeric(pairs, f"inv_{lc.amount}"),
        F.col(f"tax_{tc.nit}"), F.col(f"inv_{lc.nit}"),
        numeric(pairs, f"tax_{tc.invoice}"), numeric(pairs, f"inv_{lc.invoice}"),
        numeric(pairs, f"tax_{tc.branch}"), numeric(pairs, f"inv_{lc.branch}"),
        cfg.amount_tolerance)


def _compared(df: DataFrame, cols, prefix: str, count: str) -> DataFrame:
    """Rows with a key reduced to the distinct values that are compared,
    and the number of rows that hold them."""
    names = list(dict.fromkeys((cols.amount, cols.nit, cols.invoice, cols.branch)))
    rows = df.select(col(cols.key).alias(KEY), *[col(c).alias(f"{prefix}{c}") for c in names]).filter(F.col(KEY).isNotNull())
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(count))


def pair_counts(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig) -> DataFrame:
    """One row: number of pairs with each flag of ``compare_flags``.

    Both sides are reduced to distinct compared values first (map-side
    combined), and a joined row stands for n_tax * n_ledger pairs: copies
    of a key cost one row, not a row per pair."""
    pairs = _compared(tax, cfg.tax, "tax_", "n_tax").join(_compared(ledger, cfg.ledger, "inv_", "n_ledger"), KEY)
    flags = _pair_flags(pairs, cfg)
    n = F.col("n_tax") * F.col("n_ledger")
    return pairs.agg(*[F.coalesce(F.sum(F.when(v, n)), F.lit(0)).cast("bigint").alias(k) for k, v in flags.items()])


def mismatch_exploded(pairs: DataFrame) -> DataFrame:
    """One row per (pair, mismatch type): the per-category views."""
    return pairs.select("*", F.explode("mismatch_types").alias("mismatch_type"))
