"""Both registers stored by authorization code, so that reconciling them moves
no rows (J1-J5, J12, A1, C8).

Every register is written in three parts:

* the rows with a code, bucketed and sorted by it, the same number of buckets
  on both sides: aggregates per code and joins on the code read bucket by
  bucket, without an exchange;
* the rows of hot codes, those with more than ``hot_rows`` rows in a register,
  apart and not bucketed, since a bucket is one task and cannot be split: they
  are reconciled by the operators that shuffle and split;
* the rows without a code, which match nothing and only count in totals.

Hot codes are found by a count per code that combines on the map side; there
are at most ``rows / hot_rows`` of them. The tables live under a folder that
driver and executors share and are known to the session's catalog.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReconConfig
from ..functions.predicates import col
from ..session import cut_lineage

HOT_ROWS = 1_000_000
#: Rows of both registers that a bucket holds on average: what a task sorts and aggregates.
BUCKET_ROWS = 250_000


@dataclass
class StoredRegisters:
    """(tax, ledger) of each part; ``hot`` is None where no code is hot."""

    main: tuple[DataFrame, DataFrame]
    keyless: tuple[DataFrame, DataFrame]
    hot: tuple[DataFrame, DataFrame] | None


def bucket_count(tax: DataFrame, ledger: DataFrame, least: int = 1, rows: int = BUCKET_ROWS) -> int:
    """Buckets for two registers: as many as leave about ``rows`` rows in each,
    so that more rows mean more buckets, not larger ones. Counts both, which
    takes only the footers of Parquet files."""
    return max(least, -(-(tax.count() + ledger.count()) // rows))


def store_registers(tax: DataFrame, ledger: DataFrame, cfg: ReconConfig, root: str, buckets: int,
                    hot_rows: int = HOT_ROWS) -> StoredRegisters:
    """Writes both registers under ``root`` and returns their parts. A bucket
    should fit a task (see ``bucket_count``)."""
    spark = tax.sparkSession
    sides = ((tax, cfg.tax.key), (ledger, cfg.ledger.key))
    code = "__code"
    counts = [df.groupBy(col(key).alias(code)).agg(F.count(F.lit(1)).alias("n")).filter(f"n > {hot_rows}").select(code)
              for df, key in sides]
    hot = cut_lineage(counts[0].unionByName(counts[1]).filter(F.col(code).isNotNull()).distinct())
    some = not hot.isEmpty()
    tag = uuid.uuid4().hex

    def part(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
        path = f"{root.rstrip('/')}/{name}"
        if key is None:
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        table = f"concilia_{name}_{tag}"
        # dealt as the buckets are: a task writes one file per bucket
        df.repartition(buckets, col(key)).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
        return spark.table(table)

    main, keyless, apart = [], [], []
    for (df, key), name in zip(sides, ("tax", "ledger")):
        keyed = df.filter(col(key).isNotNull())
        keyless.append(part(df.filter(col(key).isNull()), f"{name}_keyless"))
        if some:
            theirs = hot.withColumnRenamed(code, "__hot")
            apart.append(part(keyed.join(theirs, col(key) == F.col("__hot"), "left_semi"), f"{name}_hot"))
            keyed = keyed.join(theirs, col(key) == F.col("__hot"), "left_anti")
        main.append(part(keyed, name, key))
    return StoredRegisters(tuple(main), tuple(keyless), tuple(apart) if some else None)
