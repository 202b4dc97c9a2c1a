import random

from concilia.functions.cuf import decode_codes

GOLDEN = "447D97004336A8D7C85C2495A6D872EA2398A919E1187C56A11D12F74"


def _expected(code):
    if code is None or len(code) < 42:
        return "short_code", None
    # stricter than int(x, 16), which also takes spaces, '_', '0x' and a
    # sign (documented deviation T26): exactly 42 hex digits
    if any(ch not in "0123456789abcdefABCDEF" for ch in code[:42]):
        return "not_hex", None
    s = str(int(code[:42], 16))
    if len(s) <= 27:
        return "short_decimal", s
    if len(s[27:]) < 24:
        return "short_tail", s
    return "ok", s


def test_golden_vector(spark):
    row = decode_codes(spark.createDataFrame([(GOLDEN,)], "c string"), "c").first()
    assert row["decode_status"] == "ok"
    assert [row[f] for f in ("SUCURSAL", "MODALIDAD", "TIPO EMISION", "TIPO FACTURA", "SECTOR",
                             "NUM FACTURA", "PV", "CODIGO AUTOVERIFICADOR")] == \
        ["0000", "2", "1", "1", "01", "0000009587", "0000", "1"]


def test_against_python_big_ints(spark):
    rnd = random.Random(7)
    codes = [None, "", "abc", "g" * 42, "0" * 42, "f" * 42, "F" * 50, " " + "a" * 41]
    codes += ["".join(rnd.choice("0123456789abcdefABCDEF") for _ in range(rnd.choice([42, 45, 64])))
              for _ in range(2000)]
    rows = decode_codes(spark.createDataFrame([(c,) for c in codes], "c string"), "c",
                        keep_digits=True).collect()
    for r in rows:
        status, digits = _expected(r["c"])
        assert r["decode_status"] == status, r["c"]
        if digits is not None:
            assert r["code_digits"] == digits
        if status == "ok":
            tail = digits[27:]
            assert r["SUCURSAL"] == tail[0:4] and r["NUM FACTURA"] == tail[9:19]
            assert r["CODIGO AUTOVERIFICADOR"] == tail[23:24]
        else:
            assert r["SUCURSAL"] == "" and r["SECTOR"] == ""  # '' not NULL


def test_decode_stays_in_codegen(spark):
    df = decode_codes(spark.range(10).selectExpr("md5(CAST(id AS STRING)) || 'abcdefghij' AS c"), "c")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WholeStageCodegen" in plan or "*(" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
