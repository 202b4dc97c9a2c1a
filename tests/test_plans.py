"""Plan-quality guard: no registered query may plan a cartesian product,
a nested-loop join or row-at-a-time Python evaluation."""

import re

import __spark_entry__ as E

FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython")


def test_no_forbidden_operators(spark):
    bad = {}
    for name, fn in sorted(E.queries().items()):
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        hits = FORBIDDEN.findall(plan)
        if hits:
            bad[name] = sorted(set(hits))
    assert not bad, bad
