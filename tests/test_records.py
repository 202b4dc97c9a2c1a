"""Records that span lines, in files cut into many blocks, against the csv module."""

import csv
import io
import os
import random

import pytest

from concilia.sources import records as R
from concilia.sources.registers import load_register, read_register

HEADER = "NRO,FECHA,FACTURA,CODIGO,NIT,COMPLEMENTO,NOMBRE,IMPORTE"


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _write(path, text, enc="utf-8"):
    with open(path, "w", encoding=enc, newline="") as f:
        f.write(text)


def _field(rng):
    kind = rng.randrange(9)
    word = rng.choice(["ACME", "SRL", "Ñandú", "x", ""])
    if kind == 0:
        return f'"{word}, {word}"'
    if kind == 1:
        return f'"{word}\n{word}"'
    if kind == 2:
        return f'"a ""{word}"" b"'
    if kind == 3:
        return f'"a \\"{word}\\" \n\n, c"'
    if kind == 4:
        return f"{word}\\, {word}"
    if kind == 5:
        return f'{word}x "{word}"'
    if kind == 6:
        return f"{word}\\\n\"{word}"
    return word


def _expected(text, n):
    return [r for r in csv.reader(io.StringIO(text, newline=""), quotechar='"', escapechar="\\") if r]


@pytest.mark.parametrize("seed", range(4))
def test_records_equal_the_csv_module(spark, scratch, small_blocks, seed):
    rng = random.Random(seed)
    d = os.path.join(scratch, f"in{seed}")
    os.makedirs(d)
    want = []
    for name in "abc":
        rows = [",".join([f"{name}{i}", "2025-01-01", *[_field(rng) for _ in range(5)], "1.00"]) for i in range(120)]
        text = HEADER + "\n" + "\n".join(rows) + "\n"
        _write(os.path.join(d, f"{name}.csv"), text)
        want += _expected(text, 8)[1:]
    assert all(len(r) == 8 for r in want)
    got = read_register(spark, d, keep_skipped=True)
    names = HEADER.split(",")
    rows = got.collect()
    assert {r["repair_status"] for r in rows} == {"ok"}
    assert sorted([r[c] for c in names] for r in rows) == sorted(want)


def test_maps_of_lines():
    assert R.behind('a,"b') == (1, 0, 1) and R.behind('a"b') == (0, 0, 0) and R.behind("a\\") == (2, 1, 2)
    assert R.behind('"a"') == (0, 0, 0) and R.behind("plain") == (0, 1, 0) and R.behind('"') == (1, 0, 0)
    assert R.behind('x","') == (1, 1, 1) and R.behind('a,"b\\') == (1, 2, 1)


def test_a_record_over_many_blocks(spark, scratch, small_blocks):
    d = os.path.join(scratch, "long")
    os.makedirs(d)
    name = "\n".join(f"line {i}, of the name" for i in range(200))
    _write(os.path.join(d, "a.csv"), f'{HEADER}\n1,d,1,c,n,,"{name}",1.00\n2,d,2,c,n,,B,2.00\n')
    rows = {r["NRO"]: r for r in read_register(spark, d).collect()}
    assert len(rows) == 2 and rows["1"]["NOMBRE"] == name and rows["2"]["IMPORTE"] == "2.00"


def test_a_stray_quote_swallows_no_rows(spark, scratch, small_blocks):
    d = os.path.join(scratch, "stray")
    os.makedirs(d)
    rows = [f"{i},d,{i},c,n,,Name {i},{i}.00" for i in range(300)]
    rows[40] = '40,d,40,c,n,,"Open,40.00'
    rows[200] = '200,d,200,c,n,,"Shut",200.00'
    _write(os.path.join(d, "a.csv"), HEADER + "\n" + "\n".join(rows) + "\n")
    got = {r["NRO"]: r for r in read_register(spark, d, keep_skipped=True).collect()}
    assert len(got) == 300 and got["40"]["NOMBRE"] == '"Open' and got["200"]["NOMBRE"] == "Shut"
    assert {r["repair_status"] for r in got.values()} == {"ok"}


def test_a_quote_that_nothing_closes_costs_bounded_memory(spark, scratch, small_blocks, monkeypatch):
    d = os.path.join(scratch, "open")
    os.makedirs(d)
    rows = [f"{i},d,{i},c,n,,Name {i},{i}.00" for i in range(2000)]
    rows[3] = '3,d,3,c,n,,"Open,3.00'
    _write(os.path.join(d, "a.csv"), HEADER + "\n" + "\n".join(rows) + "\n")
    from concilia.sources import registers

    monkeypatch.setattr(registers, "records", lambda lines, blocks: R.records(lines, blocks, limit=5000))
    found = []
    original = R.joined_lines
    monkeypatch.setattr(R, "joined_lines", lambda *a: found.append(original(*a)) or found[-1])
    assert read_register(spark, d).count() == 2000
    assert max(sum(map(len, r["lines"])) for r in found[0].collect()) <= 5100


def test_load_counts_and_encodings(spark, scratch):
    d = os.path.join(scratch, "enc")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), HEADER + "\n1,d,1,c,n,,Ñandú,1.00\n2,d,2\n", "utf-8")
    _write(os.path.join(d, "b.csv"), HEADER + "\n3,d,3,c,n,,Ñandú,1.00\n4,d,4,c,n,,A, B,1.00\n", "latin-1")
    _write(os.path.join(d, "c.csv"), HEADER + "\n5,d,5,c,n,,plain,1.00\n", "ascii")
    rows, counts = load_register(spark, d, encodings=("us-ascii", "utf-8", "iso-8859-1"))
    assert {(r["file"], r["repair_status"]): r["n"] for r in counts.collect()} == {
        ("a.csv", "ok"): 1, ("a.csv", "skipped"): 1, ("b.csv", "ok"): 1, ("b.csv", "fixed"): 1, ("c.csv", "ok"): 1}
    assert sorted(r["NOMBRE"] for r in rows.collect()) == ["A, B", "plain", "Ñandú", "Ñandú"]
    with pytest.raises(ValueError, match="none of the encodings"):
        read_register(spark, d, encodings=("us-ascii", "utf-8"))
