import os
import zipfile

import pytest

from concilia.sources.registers import file_catalog, latest_snapshot, read_register, read_zip_register, repair_counts, repair_lines

HEADER = "NRO,FECHA,FACTURA,CODIGO,NIT,COMPLEMENTO,NOMBRE,IMPORTE"
LINES = [
    "1,2025-01-01,1,abc,100,,ACME,10.50",
    "2,2025-01-02,2,abd,101,,ACME, S.R.L.,11.00",
    "3,2025-01-03,3,abe,102,,A,B,C,12.00",
    "4,2025-01-04,4",
    "5,2025-01-05,5,abf,103,,Ñandú Ltda,13.00",
]


def _write(path, text, enc):
    with open(path, "w", encoding=enc) as f:
        f.write(text)


def test_repair_lines_statuses(spark):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "i int, line string")
    rows = {r["i"]: r for r in repair_lines(df, "line", HEADER.split(","), 6).collect()}
    assert rows[0]["repair_status"] == "ok" and rows[0]["NOMBRE"] == "ACME"
    assert rows[1]["repair_status"] == "fixed" and rows[1]["NOMBRE"] == "ACME, S.R.L."
    assert rows[2]["NOMBRE"] == "A,B,C" and rows[2]["IMPORTE"] == "12.00"
    assert rows[3]["repair_status"] == "skipped" and rows[3]["NOMBRE"] is None


def test_read_register_mixed_encodings(spark, scratch):
    d = os.path.join(scratch, "in")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), HEADER + "\n" + "\n".join(LINES[:3]) + "\n", "utf-8")
    _write(os.path.join(d, "b.csv"), HEADER + "\n" + "\n".join(LINES[3:]) + "\n", "latin-1")
    rows = read_register(spark, d).collect()
    names = sorted(r["NOMBRE"] for r in rows)
    assert "Ñandú Ltda" in names and "ACME, S.R.L." in names
    assert len(rows) == 4  # the short line is skipped


def test_zip_and_catalog(spark, scratch):
    d = os.path.join(scratch, "zips")
    os.makedirs(d)
    with zipfile.ZipFile(os.path.join(d, "ventas.zip"), "w") as z:
        z.writestr("archivoVentas.csv", HEADER + "\n" + "\n".join(LINES) + "\n")
    rows = read_zip_register(spark, d).collect()
    assert len(rows) == 4
    _write(os.path.join(d, "processed_x.csv"), "x", "utf-8")
    _write(os.path.join(d, "inventory_y.csv"), "x", "utf-8")
    cat = file_catalog(spark, d)
    latest = latest_snapshot(cat).first()
    assert latest["name"] == "ventas.zip"
    assert cat.filter("usable").count() == 3


def test_quoted_fields(spark):
    lines = ['1,d,1,abc,100,"x, y",ACME,10.50',             # quoted field before the name
             '2,d,2,abd,101,,"ACME, SRL",11.00',
             '3,d,3,abe,102,,"A \\"B\\" C",12.00',          # escaped quotes
             '4,d,4,abf,103,"",Say "so", SRL,13.00',         # right only when split and merged
             '5,d,5,abg,104,,,14.00']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "i int, line string")
    rows = {r["i"]: r for r in repair_lines(df, "line", HEADER.split(","), 6).collect()}
    assert rows[1]["COMPLEMENTO"] == "x, y" and rows[1]["NOMBRE"] == "ACME" and rows[1]["IMPORTE"] == "10.50"
    assert rows[2]["NOMBRE"] == "ACME, SRL" and rows[2]["COMPLEMENTO"] == "" and rows[2]["repair_status"] == "ok"
    assert rows[3]["NOMBRE"] == 'A "B" C'
    assert rows[4]["repair_status"] == "fixed" and rows[4]["IMPORTE"] == "13.00"
    assert rows[5]["NOMBRE"] == "" and rows[5]["IMPORTE"] == "14.00"


def test_headers_by_file(spark, scratch):
    d = os.path.join(scratch, "heads")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), HEADER.replace(",", ", ") + "\n" + LINES[0] + "\n", "utf-8")
    _write(os.path.join(d, "b.csv"), HEADER + "\n" + LINES[1] + "\n" + LINES[3] + "\n", "utf-8")
    rows = read_register(spark, d, keep_skipped=True)
    assert sorted(r["NRO"] or "" for r in rows.collect()) == ["", "1", "2"]
    assert {r["repair_status"]: r["n"] for r in repair_counts(rows).collect()} == {"ok": 1, "fixed": 1, "skipped": 1}
    _write(os.path.join(d, "c.csv"), "NOMBRE,NRO\nx,1\n", "utf-8")
    with pytest.raises(ValueError, match="different headers"):
        read_register(spark, d)


def test_catalog_lists_empty_files(spark, scratch):
    d = os.path.join(scratch, "empties")
    os.makedirs(os.path.join(d, "deep"))
    _write(os.path.join(d, "a.csv"), "", "utf-8")
    _write(os.path.join(d, "deep", "b.csv"), "x", "utf-8")
    _write(os.path.join(d, "_hidden"), "x", "utf-8")
    got = {r["name"]: (r["size_bytes"], r["usable"]) for r in file_catalog(spark, d).collect()}
    assert got == {"a.csv": (0, False), "b.csv": (1, True)}
    assert file_catalog(spark, os.path.join(scratch, "nowhere")).count() == 0
