"""One accounting period end to end (the reference's main run): reconcile,
write the report, check the gate, map and validate the register, then a
dry run or the keyed all-or-nothing load.

Only one-row results reach the driver (gate, validation verdict, counts).
Both registers are first checkpointed into the shared checkpoint folder (the
processed register is a stage output, as the decoded export and the ledger
snapshot were): every later plan reads them as leaves, so the decode and
the extract are neither recomputed per output nor re-optimized inside every
plan, and a lost executor cannot force them to be recomputed. The statistics
and the branch report are computed once; the row sheets are one pass; the
counts of a load are observed while its rows are written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import REGISTER_COLUMN_MAP, ReconConfig
from ..operators.register import map_register, transform_stats, validate_register
from ..operators.upsert import dry_run, merge_plan
from ..session import cut_lineage
from ..sinks.report import write_report
from ..sinks.snapshot import commit_load, read_current
from .reconciliation import reconcile


@dataclass
class PeriodResult:
    stats: dict
    status: dict
    passed: bool
    synced: bool = False
    issues: list = field(default_factory=list)
    transform: dict = field(default_factory=dict)
    load: dict = field(default_factory=dict)
    snapshot: str | None = None
    report_sheets: list = field(default_factory=list)


def run_period(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig | None = None,
               column_map: tuple = REGISTER_COLUMN_MAP, target_root: str | None = None,
               report_root: str | None = None, force: bool = False, load: bool = False,
               order_by: str | None = None, buckets: int = 256) -> PeriodResult:
    cfg = cfg or ReconConfig()
    tax, ledger = cut_lineage(tax), cut_lineage(ledger)
    r = reconcile(tax, ledger, cfg)
    # statistics and branch report are computed once, as small tables that gate, status and report read
    known, branches = cut_lineage(r.stats()), cut_lineage(r.branch_report())
    stats = known.first().asDict()
    status = r.status(known, branches).first().asDict()
    gate = r.gate(force, known).first()
    res = PeriodResult(stats=stats, status=status, passed=bool(gate["passed"]))
    if report_root:
        res.report_sheets = write_report(r, report_root, stats=known, branches=branches)
    if not gate["should_sync"]:
        return res
    mapped = cut_lineage(map_register(
        tax, column_map, only_tax=r.only_tax, only_tax_key=cfg.tax.key, ledger=ledger, ledger_key=cfg.ledger.key,
        ledger_glosa=cfg.ledger.glosa, ledger_order=cfg.ledger.order, keep=(order_by,) if order_by else ()))
    res.transform = transform_stats(mapped).first().asDict()
    res.issues = [row.asDict() for row in validate_register(mapped).collect()]  # at most one row per rule
    if res.issues:
        return res
    current = read_current(tax.sparkSession, target_root) if target_root else None
    empty = None
    if current is None:
        current = empty = (mapped.limit(0).withColumn("created_at", F.current_timestamp())
                           .withColumn("updated_at", F.current_timestamp()))
    if not load:
        res.load = dry_run(current, mapped, "authorization_code").first().asDict()
        return res
    if target_root is None:
        raise ValueError("loading needs a target_root")
    res.snapshot = commit_load(mapped, target_root, "authorization_code",
                               lambda old, new: merge_plan(old, new, "authorization_code", order_by=order_by),
                               buckets=buckets, empty=empty, counts=res.load)
    res.synced = True
    return res
