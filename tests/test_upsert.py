from pyspark.sql import functions as F

from concilia.operators.upsert import dry_run, merge_plan, plan_counts, upsert_counts
from concilia.sinks import snapshot as SN
from concilia.sinks.snapshot import commit_snapshot, committed_versions, read_current

def now():
    return F.lit("2025-06-01 00:00:00").cast("timestamp")


SCHEMA = ("authorization_code string, total_sale_amount decimal(14,2), author string, "
          "created_at timestamp, updated_at timestamp")


def target(spark):
    return spark.createDataFrame([], SCHEMA).unionByName(spark.sql(
        "SELECT 'A' AS authorization_code, CAST(1 AS DECIMAL(14,2)) AS total_sale_amount, 'manual' AS author, "
        "TIMESTAMP'2020-01-01 00:00:00' AS created_at, TIMESTAMP'2020-01-01 00:00:00' AS updated_at"))


def source(spark):
    return spark.createDataFrame([("A", 5, 1), ("B", 7, 2), ("B", 8, 3), (None, 1, 4)],
                                 "authorization_code string, total_sale_amount int, seq int") \
        .withColumn("author", F.lit("engine"))


def test_merge_actions_and_kept_columns(spark):
    plan = {r["authorization_code"]: r for r in
            merge_plan(target(spark), source(spark), now=now(), order_by="seq").collect()}
    assert plan["A"]["action"] == "update" and plan["A"]["author"] == "manual"
    assert str(plan["A"]["created_at"]) == "2020-01-01 00:00:00"
    assert float(plan["A"]["total_sale_amount"]) == 5.0
    assert plan["B"]["action"] == "insert" and float(plan["B"]["total_sale_amount"]) == 8.0  # last wins
    assert None not in plan


def test_counts_follow_row_by_row_semantics(spark):
    c = upsert_counts(target(spark), source(spark)).first()
    assert (c["inserted"], c["updated"], c["total_processed"]) == (1, 2, 3)
    d = dry_run(target(spark), source(spark), sample=2, sample_order="seq").first()
    assert d["exact_inserts"] == 1 and d["rows"] == 4


def test_idempotent(spark):
    once = merge_plan(target(spark), source(spark), now=now(), order_by="seq").drop("action")
    twice = merge_plan(once, source(spark), now=now(), order_by="seq").drop("action")
    cols = sorted(once.columns)
    assert sorted(map(tuple, once.select(cols).collect())) == sorted(map(tuple, twice.select(cols).collect()))
    assert plan_counts(merge_plan(once, source(spark), now=now(), order_by="seq")).first()["insert"] == 0


def test_snapshot_publication_is_atomic(spark, scratch):
    root = f"{scratch}/register"
    assert read_current(spark, root) is None
    p1 = commit_snapshot(target(spark), root)
    plan = merge_plan(read_current(spark, root), source(spark), now=now(), order_by="seq").drop("action")
    p2 = commit_snapshot(plan, root)
    assert committed_versions(spark, root) == [1, 2] and p1 != p2
    assert read_current(spark, root).count() == 2


def test_upsert_keeps_columns_that_the_source_lacks(spark):
    target = spark.createDataFrame([(1, "a", 5.0, "seen", "x"), (2, "b", 6.0, None, "y")],
                                   "id int, authorization_code string, subtotal double, obs string, customer_name string")
    source = spark.createDataFrame([("a", "new", 1), ("c", "third", 1), ("c", "fourth", 1)],
                                   "authorization_code string, customer_name string, extra int")
    got = {r.authorization_code: r for r in merge_plan(target, source).collect()}
    assert (got["a"].id, got["a"].subtotal, got["a"].obs, got["a"].customer_name) == (1, 5.0, "seen", "new")
    assert (got["b"].id, got["b"].subtotal, got["b"].customer_name, got["b"].action) == (2, 6.0, "y", "keep")
    # copies of a key without an order: the greatest row, whatever the input order
    assert got["c"].customer_name == "third" and got["c"].id is None


def test_amount_that_does_not_fit_is_an_issue(spark):
    from concilia.operators.register import map_register, validate_register

    rows = spark.createDataFrame([("a", "9999999999999.99"), ("b", "12.5"), ("c", "x"), ("d", None)], "code string, tax string")
    mapped = map_register(rows, (("code", "authorization_code"), ("tax", "debit_tax")))
    assert [tuple(r) for r in validate_register(mapped).collect()] == [("overflow", "debit_tax", 1)]


def _register(spark, root, rows=2000, buckets=16):
    df = spark.range(rows).selectExpr("concat('K', id) AS authorization_code", "CAST(id AS DECIMAL(14,2)) AS total_sale_amount",
                                      "'manual' AS author", "TIMESTAMP'2020-01-01 00:00:00' AS created_at",
                                      "TIMESTAMP'2020-01-01 00:00:00' AS updated_at")
    commit_snapshot(df, root, key="authorization_code", buckets=buckets)
    return df


def _merge(target, source):
    return merge_plan(target, source, now=now()).drop("action")


def test_two_writers_from_one_base(spark, scratch):
    """One of two loads from the same version raises; made again, neither is lost."""
    root = f"{scratch}/race"
    _register(spark, root)
    one = spark.createDataFrame([("K1", 11), ("N1", 12)], "authorization_code string, total_sale_amount int")
    two = spark.createDataFrame([("K1", 21), ("N2", 22)], "authorization_code string, total_sale_amount int")
    base = committed_versions(spark, root)[-1]
    SN.commit_load(one, root, "authorization_code", _merge, base=base)
    try:
        SN.commit_load(two, root, "authorization_code", _merge, base=base)
        raise AssertionError("the second writer has to fail")
    except SN.Conflict:
        pass
    assert committed_versions(spark, root) == [1, 2] and len(SN.orphans(spark, root)) == 1
    assert read_current(spark, root).filter("authorization_code = 'N2'").count() == 0
    SN.commit_load(two, root, "authorization_code", _merge)
    got = {r.authorization_code: float(r.total_sale_amount) for r in read_current(spark, root).collect()}
    assert len(got) == 2002 and (got["K1"], got["N1"], got["N2"]) == (21.0, 12.0, 22.0)
    assert [SN.manifest(spark, root, v)["base"] for v in (1, 2, 3)] == [0, 1, 2]


def test_writers_at_the_same_time(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor

    root = f"{scratch}/threads"
    _register(spark, root, 200, 4)

    def load(i):
        source = spark.createDataFrame([(f"T{i}", i)], "authorization_code string, total_sale_amount int")
        for tries in range(20):
            try:
                return SN.commit_load(source, root, "authorization_code", _merge) and tries
            except SN.Conflict:
                continue
        raise AssertionError("no free version")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(load, range(4)))
    assert committed_versions(spark, root) == [1, 2, 3, 4, 5]
    assert read_current(spark, root).filter("authorization_code LIKE 'T%'").count() == 4


def test_a_load_leaves_other_buckets_untouched(spark, scratch):
    root = f"{scratch}/buckets"
    _register(spark, root)
    few = spark.range(2000).selectExpr("concat('K', id) AS authorization_code", "1 AS total_sale_amount").filter(
        SN.bucket_of(F.col("authorization_code"), 16).isin(3, 7))
    few = few.limit(20)
    before = SN.manifest(spark, root)["files"]
    files = {f: sorted(SN._names(spark, f"{root}/{f}")) for v in before.values() for f in v}
    SN.commit_load(few, root, "authorization_code", _merge)
    after = SN.manifest(spark, root)["files"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert changed <= {"3", "7"} and changed and set(after) == set(before)
    assert all(sorted(SN._names(spark, f"{root}/{f}")) == names for f, names in files.items())
    new = read_current(spark, root)
    assert new.count() == 2000 and new.filter("total_sale_amount = 1").count() in (20, 21)
    assert SN.read_version(spark, root, 1).filter("author = 'manual'").count() == 2000


def test_first_load_and_registers_not_dealt_yet(spark, scratch):
    root, old = f"{scratch}/first", f"{scratch}/old"
    source = spark.createDataFrame([("A", 1), ("B", 2), (None, 3)], "authorization_code string, total_sale_amount int")
    SN.commit_load(source, root, "authorization_code", _merge, buckets=8, empty=target(spark))
    assert read_current(spark, root).count() == 2 and SN.manifest(spark, root)["buckets"] == 8
    commit_snapshot(target(spark), old)
    SN.commit_load(source, old, "authorization_code", _merge, buckets=8)
    assert {r.authorization_code: r.author for r in read_current(spark, old).collect()} == {"A": "manual", "B": None}
    empty = source.limit(0)
    SN.commit_load(empty, old, "authorization_code", _merge)
    assert read_current(spark, old).count() == 2 and committed_versions(spark, old) == [1, 2, 3]
