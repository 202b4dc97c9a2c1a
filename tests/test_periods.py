"""Tables by period: replaced and pruned by folder; snapshots of which the newest is read."""

import os

import pytest

from concilia.sinks import periods as P


def _rows(spark, dates, tag):
    return spark.createDataFrame([(i, d, tag) for i, d in enumerate(dates)], "id int, day string, tag string").selectExpr(
        "id", "CAST(day AS DATE) AS day", "tag")


def test_only_the_periods_written_are_replaced(spark, scratch):
    root = os.path.join(scratch, "periods")
    P.write_periods(_rows(spark, ["2025-01-05", "2025-02-01", "2025-02-28", None], "old"), root, "day")
    P.write_periods(_rows(spark, ["2025-02-10"], "new"), root, "day")
    got = sorted((r.year or 0, r.month or 0, r.tag) for r in P.read_periods(spark, root).collect())
    assert got == [(0, 0, "old"), (2025, 1, "old"), (2025, 2, "new")]


def test_a_filter_on_periods_prunes_folders(spark, scratch):
    root = os.path.join(scratch, "pruned")
    P.write_periods(_rows(spark, [f"2025-{m:02d}-05" for m in range(1, 13)], "x"), root, "day")
    one = P.read_periods(spark, root, [(2025, 3), (2025, 4)])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert one.count() == 2


def test_newest_complete_snapshot(spark, scratch):
    root = os.path.join(scratch, "snapshots")
    assert P.save_snapshot(_rows(spark, ["2025-01-01"], "one"), root, 2025, 1) == 1
    assert P.save_snapshot(_rows(spark, ["2025-01-01"], "two"), root, 2025, 1) == 2
    assert P.save_snapshot(_rows(spark, ["2025-02-01"], "one"), root, 2025, 2) == 1
    assert P.snapshots(spark, root) == {(2025, 1): [1, 2], (2025, 2): [1]}
    assert sorted((r.month, r.snapshot, r.tag) for r in P.newest(spark, root).collect()) == [(1, 2, "two"), (2, 1, "one")]
    os.makedirs(os.path.join(root, "year=2025", "month=1", "snapshot=3"))  # a save that did not end
    assert P.newest(spark, root, [(2025, 1)]).first().tag == "two"
    with pytest.raises(FileNotFoundError):
        P.newest(spark, root, [(2024, 1)])
