"""Whole reconciliation of a tax register against a ledger.

``reconcile`` returns lazy DataFrames only; nothing is collected. The
statistics are two global aggregates - over per-key summaries and over the
distinct compared values of both registers - each ending in one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReconConfig
from ..functions.predicates import col, is_canceled, money, numeric
from ..operators import branches as B
from ..operators import matching as M
from ..operators.filters import reconcilable
from ..sources.stored import StoredRegisters


@dataclass
class Reconciliation:
    cfg: ReconConfig
    tax: DataFrame             # filtered tax rows (all, NULL keys included)
    ledger: DataFrame          # all ledger rows
    tax_tagged: DataFrame      # non-null-key tax rows + n_ledger
    ledger_tagged: DataFrame   # non-null-key ledger rows + n_tax, n_tax_valid, in_scope
    pairs: DataFrame           # matched pairs + comparison flags
    tax_empty: Column = None   # whether no tax row takes part (a scalar subquery)
    parts: tuple = ()          # of stored registers: reconciliations of disjoint codes, whose rows are these
    keyless: bool = False      # a part without codes

    # ---- row sets (reference result tables) --------------------------------
    @property
    def only_tax(self) -> DataFrame:
        return self.tax_tagged.filter(F.col("n_ledger") == 0)

    @property
    def only_ledger(self) -> DataFrame:
        return self.ledger_tagged.filter(F.col("n_tax") == 0)

    @property
    def matched_tax(self) -> DataFrame:
        return self.tax_tagged.filter(F.col("n_ledger") > 0)

    @property
    def perfect(self) -> DataFrame:
        return self.pairs.filter("perfect_match")

    @property
    def amount_mismatches(self) -> DataFrame:
        return self.pairs.filter("amount_mismatch")

    @property
    def customer_mismatches(self) -> DataFrame:
        return self.pairs.filter("customer_mismatch")

    @property
    def other_mismatches(self) -> DataFrame:
        return self.pairs.filter("other_mismatch")

    @property
    def ledger_valid(self) -> DataFrame:
        """Ledger rows counted in the ledger total."""
        return self.ledger_tagged.filter("in_scope")

    # ---- aggregates ---------------------------------------------------------
    def stats(self) -> DataFrame:
        return reconcile_stats(self)

    def tax_branches(self) -> DataFrame:
        tc = self.cfg.tax
        canceled = (is_canceled(col(tc.status), self.cfg.valid_status)
                    if tc.status in self.tax.columns else F.lit(False))
        return B.branch_breakdown(self.tax, tc.branch, tc.amount, canceled)

    def ledger_branches(self) -> DataFrame:
        """Rows in scope per branch; T14: with an empty tax register all
        ledger rows count, those without a code too. Both are aggregated, and
        the one that holds is chosen per branch."""
        lc = self.cfg.ledger
        canceled = is_canceled(col(lc.status), self.cfg.valid_status) if lc.status else None
        columns = [c for c in dict.fromkeys((lc.branch, lc.amount, lc.status)) if c]
        tagged = self.ledger_tagged.select(*map(col, columns), (F.col("n_tax_valid") > 0).alias("_scoped"))
        loose = self.ledger.filter(col(lc.key).isNull()).select(*map(col, columns), F.lit(False).alias("_scoped"))
        return B.scoped_breakdown(tagged.unionByName(loose), lc.branch, lc.amount, "_scoped", self.tax_empty, canceled)

    def branch_report(self) -> DataFrame:
        return B.compare_branches(self.tax_branches(), self.ledger_branches(),
                                  self.cfg.threshold_pct, dict(self.cfg.branch_names))

    def gate(self, force: bool = False, stats: DataFrame | None = None) -> DataFrame:
        """``stats``: the statistics, where they are known already."""
        return gate(self.stats() if stats is None else stats, self.cfg, force)

    def status(self, stats: DataFrame | None = None, branches: DataFrame | None = None) -> DataFrame:
        """``stats`` and ``branches``: the statistics and the branch report, where they are known already."""
        branches = self.branch_report() if branches is None else branches
        return status(self.stats() if stats is None else stats, B.branch_issue_count(branches, self.cfg.threshold_pct), self.cfg)


def reconcile(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig | None = None) -> Reconciliation:
    """Filter the tax register, tag both sides by key presence, build the
    comparison pairs. All lazy."""
    cfg = cfg or ReconConfig()
    if cfg.tax.key not in tax.columns:
        raise ValueError(f"tax register missing column: {cfg.tax.key}")
    if cfg.ledger.key not in ledger.columns:
        raise ValueError(f"ledger missing column: {cfg.ledger.key}")
    tax_f = reconcilable(tax, cfg)
    # With an empty side the ledger total is not restricted to keys
    # valid in tax; the emptiness test is a scalar subquery (run once)
    return _part(tax_f, ledger, cfg, _empty(tax_f))


def _empty(df: DataFrame) -> Column:
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("_empty")).scalar()


def _part(tax_f: DataFrame, ledger: DataFrame, cfg: ReconConfig, tax_empty: Column, stored: bool = False) -> Reconciliation:
    ledger_tagged = M.tag_ledger(ledger, tax_f, cfg, stored)
    ledger_tagged = ledger_tagged.withColumn("in_scope", (F.col("n_tax_valid") > 0) | tax_empty)
    return Reconciliation(cfg, tax_f, ledger, M.tag_tax(tax_f, ledger, cfg, stored), ledger_tagged,
                          M.compare_pairs(tax_f, ledger, cfg), tax_empty)


def reconcile_stored(registers: StoredRegisters, cfg: ReconConfig | None = None) -> Reconciliation:
    """The same over stored registers: buckets of codes without an exchange,
    hot codes by the operators that shuffle and split, rows without a code in
    totals only. Counters and sums of the parts add up, as no code is in two."""
    cfg = cfg or ReconConfig()
    groups = [registers.main, registers.hot, registers.keyless]
    taxes = [reconcilable(g[0], cfg) if g else None for g in groups]
    ledgers = [g[1] if g else None for g in groups]
    all_of = lambda frames: reduce(DataFrame.unionByName, [f for f in frames if f is not None])
    tax, ledger = all_of(taxes), all_of(ledgers)
    tax_empty = _empty(tax)
    parts = [_part(taxes[0], ledgers[0], cfg, tax_empty, stored=True)]
    if registers.hot:
        parts.append(_part(taxes[1], ledgers[1], cfg, tax_empty))
    rows = lambda name: all_of([getattr(p, name) for p in parts])
    keyless = Reconciliation(cfg, taxes[2], ledgers[2], None, None, None, tax_empty, keyless=True)
    return Reconciliation(cfg, tax, ledger, rows("tax_tagged"), rows("ledger_tagged"), rows("pairs"), tax_empty, (*parts, keyless))


def key_summaries(r: Reconciliation) -> DataFrame:
    """One row per key (NULL keys form their own rows on each side) with
    both sides' counts and exact amounts: the tax side (rows, valid rows,
    valid amount) full-outer-joined with the ledger side (rows, amount).

    Both sides are partially aggregated before their shuffle, so a hot key
    costs one row per map task; the join is one-to-one on the key.
    """
    cfg = r.cfg
    tc, lc = cfg.tax, cfg.ledger
    t_cancel = (is_canceled(col(tc.status), cfg.valid_status)
                if tc.status in r.tax.columns else F.lit(False))
    t_amt = money(numeric(r.tax, tc.amount))
    tk = (r.tax.select(col(tc.key).alias(M.KEY), t_cancel.alias("_c"), t_amt.alias("_a"))
              .groupBy(M.KEY)
              .agg(F.count(F.lit(1)).alias("n_tax"),
                   F.count(F.when(~F.col("_c"), 1)).alias("n_tax_valid"),
                   F.sum(F.when(~F.col("_c"), F.col("_a"))).alias("tax_valid_amount")))
    lk = (r.ledger.select(col(lc.key).alias(M.KEY), money(numeric(r.ledger, lc.amount)).alias("_a"))
                 .groupBy(M.KEY)
                 .agg(F.count(F.lit(1)).alias("n_ledger"), F.sum("_a").alias("ledger_amount")))
    return (tk.withColumn("_tk", F.col(M.KEY)).join(lk.withColumn("_lk", F.col(M.KEY)), M.KEY, "full_outer")
              .select(F.coalesce("_tk", "_lk").alias(M.KEY),
                      *[F.coalesce(col(c), F.lit(0)).cast("bigint").alias(c)
                        for c in ("n_tax", "n_tax_valid", "n_ledger")],
                      "tax_valid_amount", "ledger_amount"))


COUNTERS = ("total_tax", "total_ledger", "merged_count", "only_tax_count", "only_ledger_count", "only_tax_valid_count",
            "only_tax_canceled_count")
AMOUNTS = ("only_tax_valid_amount", "total_tax_amount", "_inv_scoped", "_inv_all")
PAIR_COUNTERS = {"matched_count": "perfect_match", "amount_mismatch_count": "amount_mismatch",
                 "customer_mismatch_count": "customer_mismatch", "other_mismatch_count": "other_mismatch"}


def _counters(r: Reconciliation) -> DataFrame:
    """One row: what adds up over parts of the registers that share no key.

    Presence counters and totals come from the per-key summaries (no row
    of either register is shuffled for them); mismatch counters come from
    ``pair_counts`` over sides reduced to distinct compared values."""
    if r.keyless:
        return _keyless_counters(r)
    k = key_summaries(r)
    has_key = F.col(M.KEY).isNotNull()
    only_tax = has_key & (F.col("n_tax") > 0) & (F.col("n_ledger") == 0)
    zero = F.lit(0).cast("decimal(24,4)")

    def total(c, cond=None):
        v = col(c) if cond is None else F.when(cond, col(c))
        return F.coalesce(F.sum(v), zero).cast("decimal(38,4)")

    def count_sum(v):
        return F.coalesce(F.sum(v), F.lit(0)).cast("bigint")

    keys = k.agg(
        count_sum(F.col("n_tax")).alias("total_tax"),
        count_sum(F.col("n_ledger")).alias("total_ledger"),
        count_sum(F.when(has_key, F.col("n_tax") * F.col("n_ledger"))).alias("merged_count"),
        count_sum(F.when(only_tax, F.col("n_tax"))).alias("only_tax_count"),
        count_sum(F.when(has_key & (F.col("n_ledger") > 0) & (F.col("n_tax") == 0), F.col("n_ledger")))
         .alias("only_ledger_count"),
        count_sum(F.when(only_tax, F.col("n_tax_valid"))).alias("only_tax_valid_count"),
        count_sum(F.when(only_tax, F.col("n_tax") - F.col("n_tax_valid"))).alias("only_tax_canceled_count"),
        total("tax_valid_amount", only_tax).alias("only_tax_valid_amount"),
        total("tax_valid_amount").alias("total_tax_amount"),
        total("ledger_amount", has_key & (F.col("n_tax_valid") > 0)).alias("_inv_scoped"),
        total("ledger_amount").alias("_inv_all"))
    pair_counts = M.pair_counts(r.tax, r.ledger, r.cfg).select(F.struct(
        *[F.col(flag).alias(c) for c, flag in PAIR_COUNTERS.items()]).alias("c")).scalar()  # evaluated once
    return (keys.select("*", pair_counts.alias("__pc"))
                .select(*COUNTERS, *AMOUNTS, *[F.col(f"__pc.{c}").alias(c) for c in PAIR_COUNTERS]))


def _keyless_counters(r: Reconciliation) -> DataFrame:
    """Rows without a key: they count in totals and match nothing."""
    tc, lc = r.cfg.tax, r.cfg.ledger
    canceled = is_canceled(col(tc.status), r.cfg.valid_status) if tc.status in r.tax.columns else F.lit(False)
    none, nothing = F.lit(0).cast("bigint"), F.lit(0).cast("decimal(38,4)")
    amount = lambda v: F.coalesce(F.sum(v), nothing).cast("decimal(38,4)")
    tax = r.tax.agg(F.struct(F.count(F.lit(1)).alias("n"), amount(F.when(~canceled, money(numeric(r.tax, tc.amount)))).alias("a")).alias("t"))
    led = r.ledger.agg(F.struct(F.count(F.lit(1)).alias("n"), amount(money(numeric(r.ledger, lc.amount))).alias("a")).alias("l")).scalar()
    known = {"total_tax": F.col("t.n"), "total_ledger": F.col("l.n"), "total_tax_amount": F.col("t.a"), "_inv_all": F.col("l.a")}
    return tax.select("t", led.alias("l")).select(
        *[known.get(c, none).alias(c) for c in COUNTERS], *[known.get(c, nothing).alias(c) for c in AMOUNTS],
        *[none.alias(c) for c in PAIR_COUNTERS])


def reconcile_stats(r: Reconciliation) -> DataFrame:
    """One row of counts, totals, differences, match rate.

    Every part of the registers (one, unless they are stored) gives one row
    of counters and sums; these rows are added up."""
    names = (*COUNTERS, *AMOUNTS, *PAIR_COUNTERS)
    rows = [_counters(p) for p in r.parts or (r,)]
    agg = rows[0]
    if len(rows) > 1:
        agg = reduce(DataFrame.unionByName, rows).agg(*[F.sum(c).cast(dict(rows[0].dtypes)[c]).alias(c) for c in names])
    # With an empty side the ledger total is not restricted to keys
    # valid in the tax register
    inv = F.when((F.col("total_tax") == 0) | (F.col("total_ledger") == 0), F.col("_inv_all")) \
           .otherwise(F.col("_inv_scoped"))
    diff = F.abs(F.col("total_tax_amount") - F.col("total_ledger_amount"))
    return (agg.withColumn("total_ledger_amount", inv)
               .withColumn("amount_difference", diff)
               .withColumn("amount_difference_pct",
                           F.when(F.col("total_ledger_amount") > 0,
                                  F.col("amount_difference").cast("double")
                                  / F.col("total_ledger_amount").cast("double") * 100)
                            .otherwise(F.lit(0.0)))
               .withColumn("match_rate",
                           F.when(F.col("total_tax") > 0,
                                  F.col("matched_count") / F.col("total_tax") * 100).otherwise(F.lit(0.0)))
               .withColumn("total_issues",
                           F.col("only_tax_count") + F.col("only_ledger_count") + F.col("amount_mismatch_count")
                           + F.col("customer_mismatch_count") + F.col("other_mismatch_count"))
               .drop("_inv_scoped", "_inv_all"))


def gate(stats: DataFrame, cfg: ReconConfig, force: bool = False) -> DataFrame:
    """Load allowed when the total differs by at most the threshold and
    no pair has an amount mismatch; ``force`` overrides."""
    passed = (F.col("amount_difference_pct") <= cfg.threshold_pct) & (F.col("amount_mismatch_count") == 0)
    return stats.select(passed.alias("passed"), (passed | F.lit(force)).alias("should_sync"))


def status(stats: DataFrame, branch_issues: DataFrame, cfg: ReconConfig) -> DataFrame:
    """The displayed status ladder (first rule that fires wins)."""
    s = stats.withColumn("branches_with_issues", branch_issues.select("branches_with_issues").scalar())
    thr = cfg.threshold_pct
    other = F.col("only_ledger_count") + F.col("customer_mismatch_count") + F.col("other_mismatch_count")
    all_canceled = ((F.col("only_tax_count") > 0) & (F.col("only_tax_valid_count") == 0)
                    & (F.col("only_tax_canceled_count") > 0))
    reason = (F.when(F.col("only_tax_valid_count") > 0, F.lit("valid_only_in_tax"))
               .when(F.col("branches_with_issues") > 0, F.lit("branch_over_threshold"))
               .when(F.col("amount_difference_pct") > thr, F.lit("total_over_threshold"))
               .when(F.col("amount_mismatch_count") > 0, F.lit("amount_mismatch"))
               .when(all_canceled & (F.col("amount_difference_pct") <= thr), F.lit("only_canceled_in_tax"))
               .when(other == 0, F.lit("no_discrepancy"))
               .when(other <= cfg.minor_issue_limit, F.lit("few_minor"))
               .otherwise(F.lit("minor_issues")))
    level = (F.when(reason.isin("valid_only_in_tax", "branch_over_threshold", "total_over_threshold",
                                "amount_mismatch"), F.lit("CRITICAL"))
              .when(reason == "no_discrepancy", F.lit("PERFECT"))
              .when(reason == "minor_issues", F.lit("MINOR ISSUES"))
              .otherwise(F.lit("ACCEPTABLE")))
    return s.select(level.alias("status"), reason.alias("status_reason"),
                    F.col("branches_with_issues"), other.cast("bigint").alias("other_issues"))
