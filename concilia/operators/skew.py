"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_unique(rows: DataFrame, unique: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join ``rows`` with an aggregate that has one row per ``key``.

    An aggregate leaves its rows partitioned by the key, so a join right on
    it reads one side without an exchange of its own, and AQE splits a hot
    partition only between two plain exchanges. Joining on the key and a
    hash of it asks for a partitioning that the aggregate does not have:
    both sides get an exchange, and a hot key's (or the NULL keys') rows
    are split while the aggregate's single row is read by every split. The
    price is one more exchange of the reduced side. Column order is that of
    a join on ``key``.
    """
    h, k = "__unique_hash", "__unique_key"
    right = unique.select(F.xxhash64(F.col(key)).alias(h), F.col(key).alias(k),
                          *[F.col(f"`{c}`") for c in unique.columns if c != key])
    left = rows.select(F.col(key), *[F.col(f"`{c}`") for c in rows.columns if c != key])
    return left.join(right, (F.xxhash64(left[key]) == right[h]) & (left[key] == right[k]), how).drop(h, k)
