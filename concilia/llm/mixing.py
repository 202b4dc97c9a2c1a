"""Mixing sources to target weights by Pfair scheduling.

Every source has an integer quota k out of the period Q = sum of quotas,
so its weight is k/Q. Its documents are cut into blocks of ``block_rows``
rows. Block j of a period is released at floor(j*Q/k) and due at
ceil((j+1)*Q/k); one block runs per slot, earliest deadline first among the
released ones (ties: first source by name). On one processor with total
weight 1 that meets every window, so after t slots a source has had more
than t*k/Q - 1 and fewer than t*k/Q + 1 blocks. The schedule repeats every
Q slots, so one period is computed, on the driver with a heap of sources,
and every block finds its slot by a join on the source and block mod k: no
global sort, no sequential pass over data. A source that has fewer blocks
than its quota enters the period with these only, so the work is at most
min(Q, blocks) steps, however fine the quotas are. A source that has run out
leaves its slots empty; the others keep their windows and so their
proportions, and no row is dropped or repeated.

Rows within a source follow a fixed pseudo-random order (MD5 of the id).
Ranking a source that holds a third of all rows would be one task; so rows
are ranked inside ``buckets`` of the hash and the buckets' counts are
summed ahead (at most sources x buckets small rows).

Weights: given as {source: weight}, or by default the square root of each
source's row count. k/Q is within the relative ``TOLERANCE`` of the target
weight of every source: the resolution follows from the smallest weight, for
any number of sources (one row each is collected; the slots of a period are a
table, which Spark broadcasts while its size is below the threshold). With a given ``resolution`` quotas are rounded to so many
parts, at least one each. Sources missing from given weights raise, and so
do more than ``max_sources``, where that is given: no row is left out.

Defined cases: a null source is the source "" ; null ids are allowed;
equal ids share an order key and get different positions; empty input
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_name, stored, with_row_key

MAX_SOURCES = None
RESOLUTION = None
#: Largest relative deviation of k/Q from the target weight.
TOLERANCE = 0.01
BLOCK_ROWS = 32
BUCKETS = 4096


def quotas(sizes: dict[str, int], weights: dict[str, float] | None = None, resolution: int | None = RESOLUTION,
           max_sources: int | None = MAX_SOURCES) -> dict[str, int]:
    """{source: k} from {source: rows}."""
    if max_sources is not None and len(sizes) > max_sources:
        raise ValueError(f"{len(sizes)} sources; map them to at most {max_sources} mixture groups first")
    if not sizes:
        return {}
    w = {s: math.sqrt(n) if weights is None else weights.get(s) or 0 for s, n in sizes.items()}
    if missing := sum(not x > 0 for x in w.values()):
        raise ValueError(f"{missing} sources have no positive weight")
    total = math.fsum(w.values())
    # rounding changes a quota by at most 1/2, their sum by at most the same share: together below TOLERANCE
    parts = resolution or math.ceil(0.5 + 1 / TOLERANCE) * total / min(w.values())
    k = {s: max(1, round(x / total * parts)) for s, x in w.items()}
    common = 1 if resolution else math.gcd(*k.values())
    return {s: x // common for s, x in k.items()}


def period(quota: dict[str, int], blocks: dict[str, int]) -> dict[str, list[int]]:
    """{source: slots of its blocks in a period}, at most as many as it has."""
    q, names = sum(quota.values()), sorted(quota)
    slots: dict[str, list[int]] = {s: [] for s in names}
    coming, ready, t = [(0, s) for s in names], [], 0  # next blocks by release, and released ones by deadline
    while coming or ready:
        if not ready:
            t = max(t, coming[0][0])
        while coming and coming[0][0] <= t:
            s = heapq.heappop(coming)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * q // quota[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        t += 1
        if (n := len(slots[s])) < min(quota[s], blocks[s]):
            heapq.heappush(coming, (n * q // quota[s], s))
    return slots


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_rows: int = BLOCK_ROWS, resolution: int | None = RESOLUTION, buckets: int = BUCKETS,
        max_sources: int | None = MAX_SOURCES) -> DataFrame:
    """(id, source, block, block_row, slot) for every row; reading by
    (slot, block_row) gives the mixture."""
    return _mix(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__src")),
                weights, block_rows, resolution, buckets, max_sources).select(
        F.col("__id").alias(id_col), F.col("__source").alias("source"), "block", "block_row", "slot")


def mixed_rows(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
               source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, range-partitioned and sorted in mixture order."""
    spark = docs.sparkSession
    opts = {"block_rows": BLOCK_ROWS, "resolution": RESOLUTION, "buckets": BUCKETS, "max_sources": MAX_SOURCES} | options
    key, at, slot, row = (free_name(docs, c) for c in ("__row", "__at", "__slot", "__block_row"))
    rows = with_row_key(docs, key)
    # keys and sources alone are ranked and dealt to ranges of slots; the rows follow by their keys
    narrow = _mix(rows.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__src"), F.col(key).alias("__row")), weights, **opts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.select("__row", "slot", "block_row").repartitionByRange(parts, "slot", "block_row")
    placed = stored(dealt.select(F.col("__row").alias(key), F.spark_partition_id().alias(at), F.col("slot").alias(slot),
                                 F.col("block_row").alias(row)), "mix-placed")
    last = placed.agg(F.max(at)).first()[0]
    out = rows.join(placed, key).repartitionById((last or 0) + 1, at).sortWithinPartitions(slot, row)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _mix(rows, weights, block_rows, resolution, buckets, max_sources) -> DataFrame:
    import pyarrow as pa

    h = F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("")))
    rows = rows.withColumn("__source", F.coalesce(F.col("__src").cast("string"), F.lit(""))).withColumn("__h", h)
    rows = rows.withColumn("__b", (F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    counts = rows.groupBy("__source", "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__source", "__b", (F.sum("__c").over(
        W.partitionBy("__source").orderBy("__b")) - F.col("__c")).alias("__before"))
    # one row per source
    sizes = {r["__source"]: r["n"] for r in counts.groupBy("__source").agg(F.sum("__c").alias("n")).collect()}
    quota = quotas(sizes, weights, resolution, max_sources)
    slots = period(quota, {s: -(-n // block_rows) for s, n in sizes.items()})
    plan = rows.sparkSession.createDataFrame(pa.table(
        [pa.array(quota, pa.string()), pa.array(quota.values(), pa.int64()), pa.array([sum(quota.values())] * len(quota), pa.int64()),
         pa.array([slots[s] for s in quota], pa.list_(pa.int64()))], names=["source", "k", "q", "slots"]))
    at = F.row_number().over(W.partitionBy("__source", "__b").orderBy("__h", "__id")) - 1
    ranked = rows.withColumn("__at", at).join(
        before.withColumnsRenamed({"__source": "__s2", "__b": "__b2"}),
        (F.col("__source") == F.col("__s2")) & (F.col("__b") == F.col("__b2")))
    ranked = ranked.withColumn("__pos", F.col("__at") + F.col("__before"))
    ranked = ranked.withColumn("block", F.expr(f"__pos DIV {block_rows}"))
    out = ranked.join(plan, F.col("__source") == F.col("source"))  # broadcast by Spark if its size allows that
    slot = F.expr("(block DIV k) * q + slots[CAST(block % k AS INT)]").cast("long")
    return out.withColumn("slot", slot).withColumn("block_row", (F.col("__pos") % block_rows).cast("int"))
