"""Tables stored by accounting period.

``write_periods`` deals rows to ``year=/month=`` folders and replaces only the
periods that it has rows for. ``save_snapshot`` keeps every save of a period
beside the earlier ones (``year=/month=/snapshot=``), ``newest`` reads the
latest complete one of each period: a save that failed has no ``_SUCCESS`` and
is not seen. Readers get the period as partition columns, so a filter on them
prunes folders before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshot import _names

YEAR, MONTH, SNAPSHOT = "year", "month", "snapshot"


def period_of(date: Column) -> list[Column]:
    return [F.year(date).alias(YEAR), F.month(date).alias(MONTH)]


def write_periods(df: DataFrame, root: str, date_col: str) -> None:
    """Rows dealt by the month of ``date_col``; the periods among them are
    replaced, all others stay. A hot period is written by several tasks.
    Rows without a date are a period of their own (NULL)."""
    y, m = period_of(F.col(f"`{date_col}`"))
    salt = F.pmod(F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in df.columns])), F.lit(16))
    dealt = df.withColumn(YEAR, y).withColumn(MONTH, m).repartition(YEAR, MONTH, salt)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(YEAR, MONTH).parquet(root)


def in_periods(periods: list[tuple[int, int]]) -> Column:
    """Rows of these (year, month) pairs, as a filter of partition columns."""
    wanted = F.lit(False)
    for year, month in periods:
        wanted = wanted | ((F.col(YEAR) == year) & (F.col(MONTH) == month))
    return wanted


def read_periods(spark: SparkSession, root: str, periods: list[tuple[int, int]] | None = None) -> DataFrame:
    rows = spark.read.parquet(root)
    return rows if periods is None else rows.filter(in_periods(periods))


def save_snapshot(df: DataFrame, root: str, year: int, month: int) -> int:
    """Keeps ``df`` as the next snapshot of a period and returns its number."""
    folder = f"{root.rstrip('/')}/{YEAR}={year}/{MONTH}={month}"
    numbers = [int(n.split("=")[1]) for n in _names(df.sparkSession, folder) if n.startswith(f"{SNAPSHOT}=")]
    number = max(numbers, default=0) + 1
    df.write.mode("error").parquet(f"{folder}/{SNAPSHOT}={number}")  # of two at once, one finds the folder there
    return number


def snapshots(spark: SparkSession, root: str) -> dict[tuple[int, int], list[int]]:
    """The complete snapshots of every period; only folders are listed."""
    root, out = root.rstrip("/"), {}
    for y in (n for n in _names(spark, root) if n.startswith(f"{YEAR}=")):
        for m in (n for n in _names(spark, f"{root}/{y}") if n.startswith(f"{MONTH}=")):
            done = [int(s.split("=")[1]) for s in _names(spark, f"{root}/{y}/{m}")
                    if s.startswith(f"{SNAPSHOT}=") and "_SUCCESS" in _names(spark, f"{root}/{y}/{m}/{s}")]
            if done:
                out[int(y.split("=")[1]), int(m.split("=")[1])] = sorted(done)
    return out


def newest(spark: SparkSession, root: str, periods: list[tuple[int, int]] | None = None) -> DataFrame:
    """The latest snapshot of every period (or of these), with ``year``, ``month`` and ``snapshot``."""
    root = root.rstrip("/")
    paths = [f"{root}/{YEAR}={y}/{MONTH}={m}/{SNAPSHOT}={numbers[-1]}" for (y, m), numbers in sorted(snapshots(spark, root).items())
             if periods is None or (y, m) in periods]
    if not paths:
        raise FileNotFoundError(f"no snapshot of {periods or 'any period'} under {root}")
    return spark.read.option("basePath", root).parquet(*paths)
