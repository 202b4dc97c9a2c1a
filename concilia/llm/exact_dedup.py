"""Exact de-duplication by 128-bit content hash.

Two texts are equal when they are identical after all characters of
``[\\x20\\x09-\\x0D]`` are deleted. Rows are grouped by the MD5 of the
normalised text; each group's smallest id gives the reference text, and
every member is compared with it byte by byte, so a hash collision can
never merge different texts. Of equal texts the row with the most code
points in the original stays, then the smallest id, then the first row: one
row of each group.

Shuffles: one map-side combined aggregate of (hash, best row), which a
group of any size enters as one row per task, and one join of the texts
with the reference texts on the hash. The reference side is a written
table, so both join inputs are plain exchanges and AQE splits a hot hash.

Defined cases: null text is empty and equals all other blank texts; rows
that repeat an id with an equal text share its keep_id, and the first of
them is kept; null ids sort after all others; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, body, free_name, stored, with_row_key


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WS_CLASS + "+", "")


def _best() -> Column:
    """Most code points first, then the smallest id, of any type that has an order; null ids last."""
    return F.min(F.struct((-F.col("__len")).alias("neg"), F.col("__id").isNull().alias("none"), F.col("__id").alias("id"))).alias("__best")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    return _verdicts(docs, F.monotonically_increasing_id(), id_col, text_col, content_hash).select(
        F.col("__id").alias(id_col), "keep_id", "group_size", "kept", F.col("__sha").alias("text_sha256"))


def _verdicts(docs: DataFrame, row: Column, id_col: str, text_col: str, content_hash: Callable[[Column], Column]) -> DataFrame:
    """(__row, __id, keep_id, group_size, kept, __sha) per row; ``row`` is evaluated once."""
    base = docs.select(row.alias("__row"), F.col(id_col).alias("__id"), body(text_col).alias("__text"))
    base = base.select("__row", "__id", F.length("__text").alias("__len"), normalised(F.col("__text")).alias("__norm"))
    base = base.withColumn("__h", content_hash(F.col("__norm")))
    groups = stored(base.groupBy("__h").agg(F.min("__id").alias("__ref"), F.count(F.lit(1)).alias("__n"), _best()),
                    "exact-groups")
    shared = groups.filter("__n > 1").select("__h", "__ref")
    refs = (base.join(shared, (base["__h"] == shared["__h"]) & base["__id"].eqNullSafe(shared["__ref"]))
            .select(base["__h"].alias("__h"), "__norm")
            .groupBy("__h").agg(F.min("__norm").alias("__refnorm")))
    refs = stored(groups.join(refs, "__h", "left"), "exact-refs")
    same = F.coalesce(F.col("__norm") == F.col("__refnorm"), F.lit(True))
    joined = stored(
        base.join(refs, "__h").select(
            "__row", "__id", "__len", "__h", "__n", "__best", same.alias("__same"),
            F.sha2("__norm", 256).alias("__sha"),
            F.when(~same, F.col("__norm")).alias("__other")),
        "exact-joined")
    collided = joined.filter("NOT __same").select("__h").distinct()
    good = joined.join(collided, "__h", "left_anti")
    # members of a collided hash are grouped anew by their bytes
    bad = joined.join(collided, "__h", "left_semi").select("__row", "__id", "__len", "__h", "__same", "__sha", "__other")
    redone = bad.groupBy("__h", "__other").agg(F.count(F.lit(1)).alias("__n"), _best())
    bad = bad.alias("b").join(redone.alias("r"), (F.col("b.__h") == F.col("r.__h"))
                              & F.col("b.__other").eqNullSafe(F.col("r.__other")))
    cols = ["__row", "__id", "__len", "__h", "__other", "__n", "__best", "__sha"]
    both = good.withColumn("__other", F.lit(None).cast("string")).select(*cols).unionByName(
        bad.select("b.__row", "b.__id", "b.__len", "b.__h", "b.__other", "r.__n", "r.__best", "b.__sha"))
    keep = F.col("__best.id")
    both = both.withColumn("__top", F.col("__id").eqNullSafe(keep) & (F.col("__len") == -F.col("__best.neg")))
    # rows that repeat the kept id and length: all but the first go
    tied = both.filter("__top").groupBy("__h", "__other").agg(F.min("__row").alias("first"), F.max("__row").alias("last"))
    tied = tied.filter("first < last").withColumnsRenamed({"__h": "h", "__other": "other"})
    tied = stored(tied, "exact-tied")
    out = both.join(tied, (both["__h"] == tied["h"]) & both["__other"].eqNullSafe(tied["other"]), "left")
    first = F.col("first").isNull() | (F.col("__row") == F.col("first"))
    return out.select("__row", "__id", keep.alias("keep_id"), F.col("__n").alias("group_size"),
                      (F.col("__top") & first).alias("kept"), "__sha")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    key = free_name(docs, "__row")
    rows = with_row_key(docs, key)
    kept = _verdicts(rows, F.col(key), id_col, text_col, F.md5).filter("kept").select(F.col("__row").alias(key))
    return rows.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
