"""Audit, preview and profile operators over registers (S8, S9, F7, A13,
A15, L2, L3, P1, P6, P7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import col, money, numeric


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and whether the key is unique."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                  F.countDistinct(key).cast("bigint").alias("distinct_keys")) \
             .withColumn("is_unique", F.col("rows") == F.col("distinct_keys"))


def table_schema(df: DataFrame) -> DataFrame:
    """Column names and types as rows (no data is read)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, nullable boolean")


def observation_audit(df: DataFrame, date_col: str, note_col: str, contains: str,
                      year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows whose note contains a text, optionally in one year/month."""
    out = df.filter(col(note_col).contains(contains))
    if year is not None:
        out = out.filter(F.year(date_col) == year)
    if month is not None:
        out = out.filter(F.month(date_col) == month)
    return out


def observation_counts(df: DataFrame, date_col: str, note_col: str, note: str, by: str = "month") -> DataFrame:
    """Rows with one note per day or per month."""
    d = col(date_col)
    rows = df.filter(col(note_col) == note)
    if by == "day":
        keys = [F.to_date(d).alias("day"), F.month(d).alias("month"), F.year(d).alias("year")]
    else:
        keys = [F.year(d).alias("year"), F.month(d).alias("month")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def latest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """L2: the n last rows by a total order (descending, NULLs last)."""
    return df.orderBy(*[col(c).desc_nulls_last() for c in order]).limit(n)


def top_by_amount(df: DataFrame, amount: str, key: str, n: int = 10) -> DataFrame:
    """L3: n largest amounts, ties broken by key."""
    return (df.withColumn("__amt", numeric(df, amount))
              .orderBy(F.col("__amt").desc_nulls_last(), col(key).asc())
              .limit(n).drop("__amt"))


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First and last n rows by a key, tagged 'head' / 'tail'."""
    head = df.orderBy(col(key).asc_nulls_last()).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(col(key).desc_nulls_last()).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def min_rows(df: DataFrame, n: int = 1) -> DataFrame:
    """One row telling whether ``df`` has at least n rows. Reads at most
    n rows (limit before count), never the whole table."""
    got = df.limit(n).agg(F.count(F.lit(1)).cast("bigint").alias("rows_seen"))
    return got.withColumn("has_min_rows", (F.col("rows_seen") >= n) & (F.col("rows_seen") > 0)) \
              .withColumn("min_rows", F.lit(n).cast("bigint"))


def clean_name(name: str) -> str:
    """P1 rule for one header: lower case without outer blanks, inner blanks
    as underscores, and only letters, digits and underscores kept."""
    kept = (ch for ch in "_".join(name.strip().lower().split(" ")) if ch == "_" or ch.isalnum())
    return "".join(kept)


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column by ``clean_name``; two headers that clean to
    the same name raise instead of silently colliding."""
    new = [clean_name(c) for c in df.columns]
    dup = {n for n in new if new.count(n) > 1}
    if dup:
        raise ValueError(f"cleaned column names collide: {sorted(dup)}")
    return df.toDF(*new)


def ledger_summary(df: DataFrame, invoice: str, amount: str, key: str) -> DataFrame:
    """Distinct invoices, exact total amount and rows with a key."""
    return df.agg(F.countDistinct(invoice).cast("bigint").alias("distinct_invoices"),
                  F.coalesce(F.sum(money(numeric(df, amount))), F.lit(0).cast("decimal(24,4)")).alias("total_amount"),
                  F.count(key).cast("bigint").alias("rows_with_key"),
                  F.count(F.lit(1)).cast("bigint").alias("rows"))
