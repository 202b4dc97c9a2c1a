"""Authorization-code decode (C1, X1, X2) as native Column expressions.

The first 42 hex characters form a 168-bit integer whose decimal form
(up to 51 digits) does not fit any Spark numeric type. The value is built
by Horner's rule over one 2-digit and five 8-digit hex chunks, kept as six
base-10^9 ``bigint`` limbs: limb * 2^32 + carry stays below 2^63. Each
Horner step is a plain projection, so the whole decode runs inside the
scan's whole-stage-codegen span with no Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CODE_DROP_DIGITS, CODE_FIELDS, CODE_HEX_CHARS, CODE_MIN_TAIL

BASE = 1_000_000_000
CODE_HEX_DIGITS_MAX = 51  # decimal digits of 16^42 - 1
LIMBS = 6
TWO32 = 1 << 32

STATUS_OK = "ok"
STATUS_SHORT = "short_code"
STATUS_NOT_HEX = "not_hex"
STATUS_SHORT_DECIMAL = "short_decimal"
STATUS_SHORT_TAIL = "short_tail"


def snake(name: str) -> str:
    return name.lower().replace(" ", "_")


def _chunks() -> list[tuple[int, int]]:
    """(1-based start, length) of the hex chunks: a short head, then 8s."""
    head = CODE_HEX_CHARS % 8 or 8
    out = [(1, head)]
    pos = head + 1
    while pos <= CODE_HEX_CHARS:
        out.append((pos, 8))
        pos += 8
    return out


def decode_codes(df: DataFrame, code_col: str, prefix: str = "", names: str = "reference",
                 status_col: str = "decode_status", keep_digits: bool = False) -> DataFrame:
    """Add the 8 decoded fields ('' when undecodable) and a status column.

    The decoded register is a stage output: write it (or ``checkpoint`` it
    into the shared checkpoint folder) before several plans read it, so the
    limb projections are computed and optimized once.

    ``names='reference'`` keeps the register's field names (``SUCURSAL``,
    ``TIPO EMISION`` ...); ``names='snake'`` lower-cases them.
    """
    tmp = "__cuf"
    if "`" in code_col:
        raise ValueError("code column name may not contain a backtick")
    code = F.col(code_col).cast("string")
    long_enough = F.coalesce(F.length(code) >= CODE_HEX_CHARS, F.lit(False))
    ok = long_enough & F.substring(code, 1, CODE_HEX_CHARS).rlike(f"^[0-9A-Fa-f]{{{CODE_HEX_CHARS}}}$")
    chunks = _chunks()
    chunk = [f"{tmp}_h{i}" for i in range(len(chunks))]
    limb = [f"{tmp}_l{i}" for i in range(LIMBS)]
    # each hex chunk is converted once; every later expression reads the
    # column (the optimizer keeps a non-trivial projection that is read
    # several times instead of inlining it)
    out = df.select("*", ok.alias(f"{tmp}_ok"), long_enough.alias(f"{tmp}_len"))
    out = out.select("*", *[F.when(F.col(f"{tmp}_ok"), F.conv(F.substring(code, st, ln), 16, 10).cast("bigint"))
                             .otherwise(F.lit(0)).alias(chunk[i]) for i, (st, ln) in enumerate(chunks)])
    keep = [f"`{c}`" for c in out.columns if c not in chunk]
    out = out.selectExpr(*keep, *[f"`{c}`" for c in chunk[1:]], f"{chunk[0]} AS {limb[0]}",
                         *[f"CAST(0 AS BIGINT) AS {limb[i]}" for i in range(1, LIMBS)])
    # one projection per Horner step: value = value * 2^32 + chunk, the
    # carry running from the low limb to the high one (``div`` is exact
    # integral division; nothing goes through a double)
    for step in range(1, len(chunks)):
        carry = chunk[step]
        new_limbs = []
        for i in range(LIMBS):
            v = f"({limb[i]} * {TWO32} + {carry})"
            new_limbs.append(f"{v} % {BASE} AS {limb[i]}")
            carry = f"({v} div {BASE})"
        out = out.selectExpr(*keep, *[f"`{c}`" for c in chunk[step + 1:]], *new_limbs)

    # The decimal form has at most 51 digits (16^42 < 10^51). Its length
    # only matters through two thresholds, both visible on the limbs:
    # <= 27 digits <=> the top three limbs are 0; 51 digits <=> the top
    # limb is >= 10^5. The 24 digits after the first 27 are then the low
    # 24 digits: the low 6 of limb 2, then limbs 1 and 0.
    tail_digits = CODE_HEX_DIGITS_MAX - CODE_DROP_DIGITS
    low6 = F.lpad((F.col(limb[2]) % F.lit(10 ** 6)).cast("string"), 6, "0")
    tail = F.concat(low6, F.lpad(F.col(limb[1]).cast("string"), 9, "0"), F.lpad(F.col(limb[0]).cast("string"), 9, "0"))
    top_zero = (F.col(limb[3]) == 0) & (F.col(limb[4]) == 0) & (F.col(limb[5]) == 0)
    status = (F.when(~F.col(f"{tmp}_len"), F.lit(STATUS_SHORT))
               .when(~F.col(f"{tmp}_ok"), F.lit(STATUS_NOT_HEX))
               .when(top_zero, F.lit(STATUS_SHORT_DECIMAL))
               .when(F.col(limb[5]) < F.lit(10 ** (CODE_HEX_DIGITS_MAX - 1 - 9 * (LIMBS - 1))),
                     F.lit(STATUS_SHORT_TAIL))
               .otherwise(F.lit(STATUS_OK)))
    extra = []
    if keep_digits:
        padded = F.concat(*[F.lpad(F.col(limb[i]).cast("string"), 9, "0") for i in reversed(range(LIMBS))])
        stripped = F.ltrim(padded, F.lit("0"))
        extra = [F.when(F.col(f"{tmp}_ok"), F.when(stripped == "", F.lit("0")).otherwise(stripped))
                 .alias(prefix + "code_digits")]
    out = out.select(*[F.col(c) for c in keep], status.alias(status_col), tail.alias(f"{tmp}_tail"), *extra)
    decoded_ok = F.col(status_col) == F.lit(STATUS_OK)
    assert tail_digits == CODE_MIN_TAIL
    fields = [F.when(decoded_ok, F.substring(F.col(f"{tmp}_tail"), start + 1, end - start)).otherwise(F.lit(""))
               .alias(prefix + (snake(name) if names == "snake" else name)) for name, start, end in CODE_FIELDS]
    digits_col = [F.col(prefix + "code_digits")] if keep_digits else []
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col(status_col), *fields, *digits_col)


def field_names(prefix: str = "", names: str = "reference") -> list[str]:
    return [prefix + (snake(n) if names == "snake" else n) for n, _, _ in CODE_FIELDS]
