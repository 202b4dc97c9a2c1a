from pyspark.sql import functions as F

from concilia.fixtures.star import star
from concilia.fixtures.views import Tables
from concilia.functions.predicates import money
from concilia.operators.ledger import extract_ledger, one_per_key, picks

PERIOD = ("1990-01-01", "2010-12-31")


def test_repeated_dimension_rows_do_not_repeat_invoices(spark):
    t = star(Tables(spark, "/root/testdata/sf0.001"))
    want = sorted(map(repr, extract_ledger(t, *PERIOD, order=False).collect()))
    assert want
    more = dict(t)
    for name in ("siat_cuis", "factura_siat", "siat_sincro_tipo_metodo_pago"):
        more[name] = t[name].unionByName(t[name])
    inactive = t["siat_cuis"].withColumn("active", F.lit(0))
    more["siat_cuis"] = more["siat_cuis"].unionByName(inactive.select(*[F.col(f.name).cast(f.dataType) for f in t["siat_cuis"].schema]))
    assert sorted(map(repr, extract_ledger(more, *PERIOD, order=False).collect())) == want


def test_one_per_key_returns_a_row_that_exists(spark):
    df = spark.createDataFrame([(1, 10, "z"), (1, 20, "a"), (2, 5, None)], "k int, a int, b string")
    assert sorted(map(tuple, one_per_key(df, "k").collect())) == [(1, 10, "z"), (2, 5, None)]


def test_amount_that_does_not_fit_is_missing(spark):
    df = spark.createDataFrame([(1e25,), (1.5,), (None,)], "x double")
    assert float(df.agg(F.sum(money(F.col("x")))).first()[0]) == 1.5


def _small_star(spark):
    """Few relations of ``picks``, with copies, NULL ids and links to nothing."""
    df = spark.createDataFrame
    details = [(1, 10), (1, 11), (1, 10), (2, 12), (2, 99), (3, 99), (4, 13), (4, None), (5, 11), (None, 10)]
    links = [(1, 100), (1, 101), (2, None), (2, 100), (4, 555), (3, 100), (5, 102), (5, 101)]
    return {
        "users": df([(7, "Ana", "B"), (7, "Ana", "A"), (8, None, "C")], "id long, first_name string, last_name string"),
        "tmovimiento": df([(0, "M0"), (1, "M1")], "id long, sigla string"),
        "egresos": df([(10, 0, 7, "x"), (11, 1, 8, "y"), (11, 0, 8, "y"), (12, 1, 8, None), (13, 1, 8, "z"), (99, 5, 7, "no kind")],
                      "idegresos long, tipomov long, vendedor long, clientePedido string"),
        "pago": df([(100, 2), (100, None), (101, 1), (102, 3)], "idPago long, numPago int"),
        "factura_egresos": df(details, "idFactura long, idegresos long"),
        "pago_factura": df(links, "idFactura long, idPago long")}


def test_picks_over_copies_and_missing_links(spark):
    t = _small_star(spark)
    got = {r["idFactura"]: tuple(r)[1:] for r in picks(t).collect()}
    assert got == {1: (10, "M0", "Ana", "A", "x", 100, None, 18), 2: (12, "M1", None, "C", None, None, None, 3),
                   4: (13, "M1", None, "C", "z", None, None, 1), 5: (11, "M0", None, "C", "y", 101, 1, 4),
                   None: (10, "M0", "Ana", "A", "x", None, None, 2)}
    some = spark.createDataFrame([(1,), (5,)], "idFactura long")
    assert {r["idFactura"]: tuple(r)[1:] for r in picks(t, some).collect()} == {k: got[k] for k in (1, 5)}


def test_details_are_not_joined_on_payments(spark):
    """A detail has no payment id: joined on it, the details of all invoices would meet in one task."""
    lines = picks(_small_star(spark))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at, = (i for i, line in enumerate(lines) if "Join LeftOuter" in line and "idPago" in line)
    below = []
    for line in lines[at + 1:]:
        if depth(line) <= depth(lines[at]):
            break
        below.append(line)
    assert below and not any("Union" in line for line in below) and any("Union" in line for line in lines)
