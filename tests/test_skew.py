"""A hot key holding a large share of both registers: statistics must
equal a brute-force computation over all pairs."""

import random

import pandas as pd

from concilia.config import LedgerColumns, ReconConfig, TaxColumns
from concilia.plans.reconciliation import reconcile

TAX = TaxColumns(key="k", amount="a", nit="nit", status="st", modality="m", sector="s", branch="b", invoice="inv")
LED = LedgerColumns(key="k", amount="a", nit="nit", branch="b", invoice="inv", order=("inv",))
CFG = ReconConfig(tax=TAX, ledger=LED)


def _rows(rnd, n, hot, side):
    out = []
    for i in range(n):
        k = "HOT" if i < hot else (f"K{i}" if rnd.random() < 0.9 else f"{side}{i}")
        a = round(rnd.choice([10.0, 10.01, 10.02, 55.5]) + rnd.choice([0, 0, 0.005]), 3)
        nit = rnd.choice(["1", "1", " 1-", "2", None])
        inv = rnd.choice(["7", "007", "8", None, "x"])
        b = rnd.choice(["0", "0000", "1", None])
        out.append((k, a, nit, inv, b))
    return out


def test_hot_key_stats_match_brute_force(spark):
    rnd = random.Random(5)
    t_rows = [r + (rnd.choice(["VALIDA", "ANULADA"]), "2", "01") for r in _rows(rnd, 900, 300, "T")]
    l_rows = _rows(rnd, 800, 250, "L")
    tax = spark.createDataFrame(t_rows, "k string, a double, nit string, inv string, b string, st string, "
                                        "m string, s string").repartition(4)
    led = spark.createDataFrame(l_rows, "k string, a double, nit string, inv string, b string").repartition(4)
    got = reconcile(tax, led, CFG).stats().first().asDict()

    t = pd.DataFrame(t_rows, columns=["k", "a", "nit", "inv", "b", "st", "m", "s"])
    lg = pd.DataFrame(l_rows, columns=["k", "a", "nit", "inv", "b"])
    pairs = t.merge(lg, on="k", suffixes=("_t", "_l"))

    def clean(x):
        return "" if x is None else str(x).strip().upper().replace(" ", "").replace("-", "").replace(".", "")

    def as_int(x):
        try:
            return int(float(x))
        except (TypeError, ValueError):
            return None

    def differs(x, y):
        return x is not None and y is not None and x != y

    amount = (pairs.a_t - pairs.a_l).abs() > 0.01
    customer = pairs.nit_t.map(clean) != pairs.nit_l.map(clean)
    other = [differs(as_int(a), as_int(b)) or differs(as_int(c), as_int(d))
             for a, b, c, d in zip(pairs.inv_t, pairs.inv_l, pairs.b_t, pairs.b_l)]
    other = pd.Series(other)
    assert got["merged_count"] == len(pairs) > 300 * 250
    assert got["amount_mismatch_count"] == int(amount.sum())
    assert got["customer_mismatch_count"] == int(customer.sum())
    assert got["other_mismatch_count"] == int(other.sum())
    assert got["matched_count"] == int((~amount & ~customer & ~other).sum())
    only_tax = t[~t.k.isin(set(lg.k))]
    assert got["only_tax_count"] == len(only_tax)
    assert got["only_ledger_count"] == int((~lg.k.isin(set(t.k))).sum())
