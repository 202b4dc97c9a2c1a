"""Key set operations (O1), snapshot differences (O3, O4) and the
duplicate-key report (A14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions.predicates import col
from .skew import join_unique


def _keys(df: DataFrame, key_col: str, name: str = "cuf") -> DataFrame:
    return df.select(col(key_col).alias(name)).filter(col(name).isNotNull())


def key_intersect(a: DataFrame, a_key: str, b: DataFrame, b_key: str, name: str = "cuf") -> DataFrame:
    """Distinct keys present on both sides (set semantics)."""
    return _keys(a, a_key, name).intersect(_keys(b, b_key, name))


def key_except_both(a: DataFrame, a_key: str, b: DataFrame, b_key: str, name: str = "cuf",
                    labels: tuple = ("tax_only", "ledger_only")) -> DataFrame:
    """Both set differences of distinct keys, tagged with their side."""
    ka, kb = _keys(a, a_key, name), _keys(b, b_key, name)
    return (ka.subtract(kb).select(F.lit(labels[0]).alias("side"), name)
              .unionByName(kb.subtract(ka).select(F.lit(labels[1]).alias("side"), name)))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, detail: tuple = (), number: str | None = None) -> DataFrame:
    """Rows whose key is in one snapshot only, both directions, with
    a ``direction`` tag ('lost' = only in old, 'new' = only in new). A NULL
    key has no partner. With ``number``, rows carry its sort key (L4) as
    ``number_order``."""
    cols = list(dict.fromkeys([key, *detail, *([number] if number else [])]))
    lost = old.select(*cols).join(new.select(key), key, "left_anti").withColumn("direction", F.lit("lost"))
    added = new.select(*cols).join(old.select(key), key, "left_anti").withColumn("direction", F.lit("new"))
    out = lost.unionByName(added)
    return out.withColumn("number_order", numeric_order(number)) if number else out


def snapshot_diffs(old: DataFrame, new: DataFrame, keys: tuple, detail: tuple = (), number: str | None = None) -> DataFrame:
    """O3 once for each of ``keys``: the differences by row number and those
    by code differ, as a code may keep its rows under new numbers.
    ``key_kind`` names the key of a difference."""
    parts = [snapshot_diff(old, new, k, tuple(c for c in (*keys, *detail) if c != k), number)
             .withColumn("key_kind", F.lit(k)) for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Every row whose key appears more than once, with its copy count.

    The copy count is a partially aggregated groupBy joined back (a hot key
    costs one row per map task before the shuffle; AQE splits its rows in
    the join back)."""
    counts = (df.select(key).filter(col(key).isNotNull())
                .groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
                .filter(F.col("copies") > 1))
    return join_unique(df, counts, key, "inner")


def numeric_order(c) -> "F.Column":
    """L4: sort key for row numbers held as text: digits numerically, any
    other value as 0."""
    return F.when(col(c).cast("string").rlike("^[0-9]+$"),
                  col(c).cast("string").try_cast("decimal(38,0)")).otherwise(F.lit(0))
