"""Keyed all-or-nothing upsert into the accounting register.

``merge_plan`` builds the complete next snapshot of the target in one full
outer join on the key (insert / update / keep per row); nothing is written
until ``sinks.snapshot.commit_snapshot`` publishes it as a new version, so
a failed job leaves the current version untouched (all or nothing), and
applying the same source twice gives the same rows as applying it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import UPSERT_COLUMNS, UPSERT_KEEP
from ..functions.predicates import col


def dedup_source(source: DataFrame, key: str, order_by: str | None = None) -> DataFrame:
    """One source row per key: the last by ``order_by`` (statement order of
    a row-by-row upsert), ties and a missing order by the row's own values,
    so the pick never depends on input order; rows with a NULL key are
    dropped. The pick is a partially aggregated groupBy, so a key with many
    copies stays cheap."""
    rows = source.filter(col(key).isNotNull())
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    picked = F.max(row) if order_by is None else F.max_by(row, F.struct(col(order_by), row))
    return rows.groupBy(key).agg(picked.alias("__row")).select(key, "__row.*")


def merge_plan(target: DataFrame, source: DataFrame, key: str = "authorization_code",
               columns: tuple = UPSERT_COLUMNS, keep: tuple = UPSERT_KEEP,
               now: Column | None = None, order_by: str | None = None) -> DataFrame:
    """Next snapshot of ``target`` after upserting ``source``.

    Updates take every written column that the source has, except ``keep``
    (key, original author); all other target columns stay as they are, also
    on updated rows. ``created_at`` survives and ``updated_at`` is ``now``.
    Inserts get both timestamps ``now`` and NULL in columns that the source
    lacks. Target-only rows are kept unchanged. Adds an ``action`` column
    (insert/update/keep).
    """
    now = now if now is not None else F.current_timestamp()
    src = dedup_source(source, key, order_by)
    written = [c for c in columns if c in src.columns and c != key]
    s = src.select(col(key).alias("__k"), F.lit(True).alias("__s"), *[col(c).alias(f"__s_{c}") for c in written])
    t = target.select(col(key).alias("__k"), F.lit(True).alias("__t"),
                      *[col(c).alias(f"__t_{c}") for c in target.columns if c != key])
    j = t.join(s, "__k", "full_outer")
    in_s, in_t = F.coalesce(F.col("__s"), F.lit(False)), F.coalesce(F.col("__t"), F.lit(False))
    action = F.when(in_s & in_t, F.lit("update")).when(in_s, F.lit("insert")).otherwise(F.lit("keep"))
    out = [F.col("__k").alias(key)]
    stamps = ("created_at", "updated_at")
    types = dict(target.dtypes)
    for c in [*[c for c in columns if c in written or c in types], *[c for c in target.columns if c not in columns]]:
        if c == key or c in stamps:
            continue
        tcol = F.col(f"`__t_{c}`") if c in types else F.lit(None)
        if c not in written:
            val = tcol
        elif c in keep:
            val = F.when(in_t, tcol).otherwise(F.col(f"`__s_{c}`"))
        else:
            val = F.when(in_s, F.col(f"`__s_{c}`")).otherwise(tcol)
        out.append((val.cast(types[c]) if c in types else val).alias(c))
    created = F.col("__t_created_at") if "created_at" in target.columns else F.lit(None).cast("timestamp")
    updated = F.col("__t_updated_at") if "updated_at" in target.columns else F.lit(None).cast("timestamp")
    out += [F.when(in_t, created).otherwise(now).alias("created_at"),
            F.when(in_s, now).otherwise(updated).alias("updated_at"),
            action.alias("action")]
    return j.select(*out)


def upsert_counts(target: DataFrame, source: DataFrame, key: str = "authorization_code") -> DataFrame:
    """Counts a row-by-row upsert reports: per key with c source copies,
    an existing key gives c updates, a new key 1 insert and c-1 updates."""
    per_key = (source.filter(col(key).isNotNull()).groupBy(key)
                     .agg(F.count(F.lit(1)).alias("c")))
    exists = target.select(key).filter(col(key).isNotNull()).distinct().withColumn("__e", F.lit(True))
    j = per_key.join(exists, key, "left")
    new = ~F.coalesce(F.col("__e"), F.lit(False))
    return j.agg(F.count(F.when(new, 1)).cast("bigint").alias("inserted"),
                 F.coalesce(F.sum(F.when(new, F.col("c") - 1).otherwise(F.col("c"))), F.lit(0))
                  .cast("bigint").alias("updated"),
                 F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("total_processed"))


def plan_counts(plan: DataFrame) -> DataFrame:
    """Rows per action in a merge plan and the size of the next snapshot."""
    return plan.agg(*[F.count(F.when(F.col("action") == a, 1)).cast("bigint").alias(a)
                      for a in ("insert", "update", "keep")],
                    F.count(F.lit(1)).cast("bigint").alias("rows_after"))


def dry_run(target: DataFrame, source: DataFrame, key: str = "authorization_code",
            sample: int | None = None, sample_order: str | None = None) -> DataFrame:
    """K6: what a load would do, without writing.

    Exact mode counts by key presence (semi/anti join). ``sample=n``
    reproduces the estimate from the first n source rows (by
    ``sample_order``): updates = floor(rows * existing/n), the rest inserts.
    """
    rows = source.agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
    exact = upsert_counts(target, source, key).select(
        F.struct(F.col("inserted").alias("i"), F.col("updated").alias("u")).alias("c")).scalar()
    res = (rows.select("rows", exact.alias("__x"))
               .select("rows", F.col("__x.i").alias("exact_inserts"), F.col("__x.u").alias("exact_updates")))
    if sample:
        order = sample_order or key
        head = source.orderBy(col(order).asc_nulls_last(), col(key).asc_nulls_last()).limit(sample)
        probe = head.join(target.select(key).distinct().withColumn("__e", F.lit(1)), key, "left")
        ratio = probe.agg(F.struct((F.count("__e") / F.count(F.lit(1))).alias("r"),
                                   F.count(F.lit(1)).alias("n")).alias("c")).scalar()
        res = (res.select("*", ratio.alias("__r"))
                  .select("*", F.col("__r.r").alias("existing_ratio"), F.col("__r.n").alias("sampled")).drop("__r"))
        est_upd = F.when(F.col("sampled") > 0, F.floor(F.col("rows") * F.col("existing_ratio"))).otherwise(0)
        res = (res.withColumn("estimated_updates", est_upd.cast("bigint"))
                  .withColumn("estimated_inserts", (F.col("rows") - F.col("estimated_updates")).cast("bigint"))
                  .drop("sampled"))
    return res
