"""Archives as a data source: streamed, in any encoding, records over several lines."""

import os
import tracemalloc
import zipfile

import pytest

from concilia.sources import archives as A
from concilia.sources.registers import read_zip_register

HEADER = "NRO,FECHA,FACTURA,CODIGO,NIT,COMPLEMENTO,NOMBRE,IMPORTE"


def _archive(path, text, enc="utf-8", method=zipfile.ZIP_DEFLATED, member="ventas.csv"):
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr(member, text.encode(enc))


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_an_archive_is_never_held(scratch, method):
    """60 MB of lines go through a task in a few MB of memory; the archive itself is 60 MB when it is stored."""
    path = os.path.join(scratch, "big.zip")
    line = "1,2025-01-02,1,abc,100,,ACME y Compañía S.R.L. de la calle larga,10.50\n"
    n = 60_000_000 // len(line)
    _archive(path, HEADER + "\n" + line * n, method=method)
    tracemalloc.start()
    seen = last = 0
    for member, at, lines in A.archive_lines(path, ".csv", ["utf-8", "iso-8859-1"]):
        assert at == seen
        seen, last = seen + len(lines), lines[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n + 1 and last == line[:-1] and peak < 12_000_000


def test_encodings_members_and_archives_without_one(spark, scratch):
    d = os.path.join(scratch, "zips")
    os.makedirs(d)
    _archive(os.path.join(d, "a.zip"), f"{HEADER}\r\n1,d,1,c,n,,Ñandú,1.00\r\n2,d,2\r\n", "latin-1")
    _archive(os.path.join(d, "b.zip"), f'{HEADER}\n3,d,3,c,n,,"Uno\nDos, Tres",1.00\n4,d,4,c,n,,A, B,1.00\n')
    _archive(os.path.join(d, "c.zip"), "no table", member="readme.txt")
    with zipfile.ZipFile(os.path.join(d, "d.zip"), "w") as z:
        z.writestr("z.CSV", f"{HEADER}\n6,d,6,c,n,,later,1.00\n")
        z.writestr("m.csv", f"{HEADER}\n5,d,5,c,n,,first by name,1.00\n")
    rows = {r["NRO"]: r for r in read_zip_register(spark, d, keep_skipped=True).collect()}
    assert {k: r["NOMBRE"] for k, r in rows.items()} == {
        "1": "Ñandú", None: None, "3": "Uno\nDos, Tres", "4": "A, B", "5": "first by name"}
    assert rows["4"]["repair_status"] == "fixed"
    lines = A.read_archives(spark, [os.path.join(d, "a.zip"), os.path.join(d, "b.zip"), os.path.join(d, "c.zip")])
    assert lines.rdd.getNumPartitions() == 3 and lines.count() == 3 + 4
    with pytest.raises(Exception, match="not in any of the encodings"):
        A.read_archives(spark, [os.path.join(d, "a.zip")], encodings=("utf-8",)).count()
    with pytest.raises(FileNotFoundError):
        read_zip_register(spark, scratch)
