"""Data-quality profiles and distributions.

Every profile is one aggregation pass (partial aggregation per task), then
an unpivot of the one-row result into long form. Top-k per group uses
``row_number() <= k``, which Spark plans with a window group limit, so
only k rows per group and task cross the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cuf import STATUS_OK
from ..functions.predicates import money, numeric, strip


def fill_rate(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column total, populated (non-empty text), empty rows and
    fill rate in percent."""
    aggs = [F.count(F.lit(1)).alias("__total")]
    for i, c in enumerate(cols):
        populated = F.coalesce(F.length(F.col(f"`{c}`").cast("string")) > 0, F.lit(False))
        aggs.append(F.count(F.when(populated, 1)).alias(f"__p{i}"))
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `__p{i}`" for i, c in enumerate(cols))
    long = one.selectExpr("__total", f"stack({len(cols)}, {stack}) AS (field, populated_rows)")
    return long.select(
        "field",
        F.col("__total").cast("bigint").alias("total_rows"),
        F.col("populated_rows").cast("bigint").alias("populated_rows"),
        (F.col("__total") - F.col("populated_rows")).cast("bigint").alias("empty_rows"),
        F.when(F.col("__total") > 0, F.col("populated_rows") / F.col("__total") * 100)
         .otherwise(F.lit(0.0)).alias("fill_rate"))


def decode_stats(decoded: DataFrame, status_col: str = "decode_status") -> DataFrame:
    """Rows per decode status and their share; ``decoded`` is True for
    rows whose fields were filled."""
    w = Window.partitionBy()  # over the handful of status rows only
    counts = decoded.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.col(status_col).alias("decode_status"),
        F.col("n").cast("bigint").alias("n"),
        (F.col("n") / F.sum("n").over(w) * 100).alias("share_pct"),
        (F.col(status_col) == STATUS_OK).alias("decoded"))


def value_topk(df: DataFrame, cols: list[str], k: int = 3) -> DataFrame:
    """Per column, number of distinct non-null values and the k most
    frequent values with their count and share of all rows (ties broken by
    value)."""
    total = df.agg(F.count(F.lit(1)).alias("__rows")).scalar()
    stack = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {stack}) AS (field, value)").filter(F.col("value").isNotNull())
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    distinct = counts.groupBy("field").agg(F.count(F.lit(1)).alias("n_distinct"))
    w = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("value").asc())
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return (top.join(distinct, "field")
               .select("field", F.col("n_distinct").cast("bigint"), F.col("rank").cast("bigint"), "value",
                       F.col("n").cast("bigint"), (F.col("n") / total * 100).alias("share_pct")))


def group_summary(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Count, sum and mean of an amount per group (sum exact)."""
    amt = money(numeric(df, amount))
    return (df.groupBy(*by)
              .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                   F.coalesce(F.sum(amt), F.lit(0).cast("decimal(24,4)")).alias("total"),
                   F.count(amt).alias("__n_amt"))
              .withColumn("mean", F.when(F.col("__n_amt") > 0, F.col("total").cast("double") / F.col("__n_amt")))
              .drop("__n_amt"))


def profile_nulls(df: DataFrame) -> DataFrame:
    """Per column, its type, null count and null percent."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count(F.when(F.col(f"`{f.name}`").isNull(), 1)).alias(f"__n{i}"))
    one = df.agg(*aggs)
    stack = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', `__n{i}`" for i, f in enumerate(fields))
    long = one.selectExpr("__rows", f"stack({len(fields)}, {stack}) AS (column, dtype, null_count)")
    return long.select("column", "dtype", F.col("null_count").cast("bigint"),
                       F.when(F.col("__rows") > 0, F.col("null_count") / F.col("__rows") * 100)
                        .otherwise(F.lit(0.0)).alias("null_pct"),
                       F.col("__rows").cast("bigint").alias("rows"))


def profile_dates(df: DataFrame) -> DataFrame:
    """Min and max of every date/timestamp column."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(F.col(f"`{c}`")).cast("string").alias(f"__mn{i}"),
                 F.max(F.col(f"`{c}`")).cast("string").alias(f"__mx{i}")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `__mn{i}`, `__mx{i}`" for i, c in enumerate(cols))
    return one.selectExpr(f"stack({len(cols)}, {stack}) AS (column, min_value, max_value)")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def blank_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, values that are empty after trimming."""
    aggs = [F.count(F.when(strip(F.col(f"`{c}`").cast("string")) == "", 1)).alias(f"__b{i}")
            for i, c in enumerate(cols)]
    stack = ", ".join(f"'{c}', `__b{i}`" for i, c in enumerate(cols))
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {stack}) AS (field, blank_rows)") \
             .withColumn("blank_rows", F.col("blank_rows").cast("bigint"))


def numeric_profile(df: DataFrame, cols: list[str], quartiles: bool = True,
                    accuracy: int = 100000) -> DataFrame:
    """A10: count, mean, sample std, min, max per column (exact, one pass)
    and, optionally, quartiles from Spark's bounded-memory quantile sketch
    (rank error at most rows/accuracy; ``exact_quantiles`` has exact ones)."""
    parts = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)  # NaN counts as missing
        # mean from an exact decimal sum: the same value whatever the
        # partitioning (a floating sum depends on the order of addition)
        mean = F.sum(x.cast("decimal(38,8)")).cast("double") / F.count(x)
        aggs = [F.count(x).cast("bigint").alias("count"), mean.alias("mean"), F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"), F.max(x).alias("max")]
        if quartiles:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias("__q"))
        parts.append((c, aggs))
    # one pass over the table: all columns' aggregates together, then unpivot
    flat = []
    for i, (_, aggs) in enumerate(parts):
        flat.extend(a.alias(f"__{i}_{j}") for j, a in enumerate(aggs))
    one = df.agg(*flat)
    names = ["count", "mean", "std", "min", "max"]
    rows = []
    for i, (c, _) in enumerate(parts):
        sel = [F.lit(c).alias("column"), *[F.col(f"__{i}_{j}").alias(n) for j, n in enumerate(names)]]
        if quartiles:
            sel += [F.col(f"__{i}_5")[k].alias(n) for k, n in enumerate(("q25", "q50", "q75"))]
        rows.append(F.struct(*sel))
    return one.select(F.inline(F.array(*rows)))


#: Bits of a value that a pass tells apart, and passes.
RADIX, PASSES = 16, 4
#: A key of a pass is a value's leading bits times this, and the column's number.
COLUMNS = 1 << 15


def _images(df: DataFrame, xs: list[Column]) -> DataFrame:
    """Columns s0, s1, ...: integers that order as the doubles ``xs`` do:
    their IEEE 754 bits, negated for negative numbers. NULL for NULL and NaN;
    -0.0 counts as 0.0.

    The bits are calculated: with a = m * 2**(e - 52) and 2**52 <= m < 2**53,
    they are (e + 1023) * 2**52 + m - 2**52. Scaling by powers of two is
    exact, in two steps so that it neither overflows nor underflows, and
    ``log2`` may miss e by one, which m shows. Step by step, so that nothing
    is calculated twice."""
    n = range(len(xs))
    each = lambda f: [c for i in n for c in f(i)]
    x, a, e, m = (lambda p: lambda i: F.col(f"{p}{i}"))("x"), (lambda i: F.abs(F.col(f"x{i}"))), \
        (lambda i: F.col(f"e{i}")), (lambda i: F.col(f"m{i}"))
    df = df.select(*[F.when(~F.isnan(c), c).alias(f"x{i}") for i, c in enumerate(xs)])
    df = df.select(*each(lambda i: (x(i), F.least(F.greatest(F.floor(F.log2(a(i))), F.lit(-1022)), F.lit(1023)).cast("int").alias(f"e{i}"))))
    half = lambda i: F.shiftright(52 - e(i), 1)
    df = df.select(*each(lambda i: (x(i), e(i), (a(i) * F.pow(F.lit(2.0), half(i)) * F.pow(F.lit(2.0), 52 - e(i) - half(i))).alias(f"m{i}"))))
    low, high = F.lit(float(1 << 52)), F.lit(float(1 << 53))
    over, under = (lambda i: m(i) >= high), (lambda i: (m(i) < low) & (e(i) > -1022))
    # below 2**-1022 there is no leading one, and the exponent field is zero
    bits = lambda i: F.when(a(i) == 0, F.lit(0).cast("long")).when(a(i) == float("inf"), F.lit(0x7FF << 52)).otherwise(
        (e(i) + F.when(over(i), 1).when(under(i), -1).otherwise(0) + 1022) * F.lit(1 << 52)
        + F.when(over(i), m(i) / 2).when(under(i), m(i) * 2).otherwise(m(i)).cast("long"))
    df = df.select(*each(lambda i: (x(i), bits(i).alias(f"b{i}"))))
    return df.select(*[F.when(x(i) < 0, -F.col(f"b{i}")).otherwise(F.col(f"b{i}")).alias(f"s{i}") for i in n])


def _value_of(s: Column) -> Column:
    """The double whose image is ``s``."""
    bits = F.abs(s)
    e, m = F.shiftright(bits, 52).cast("long"), bits.bitwiseAND(F.lit((1 << 52) - 1))
    power = lambda k: F.pow(F.lit(2.0), k)
    full = (m + F.lit(1 << 52)).cast("double")
    k = e - 1075
    a = F.when(e == 0x7FF, F.lit(float("inf"))).when(e == 0, m.cast("double") * F.lit(2.0 ** -537) * F.lit(2.0 ** -537)) \
        .otherwise(full * power(F.floor(k / 2)) * power(k - F.floor(k / 2)))
    return F.when(s < 0, -a).otherwise(a)


def exact_quantiles(df: DataFrame, cols: list[str], probs: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics
    (the definition used by numeric summaries): (column, q), one array in
    the order of ``probs`` per column that has a value; NULL and NaN count
    as missing.

    Radix selection, all columns at once: a value's image is an integer of 64
    bits in the order of the values. Each of PASSES scans counts the values
    per RADIX further leading bits, but only of values that share the leading
    bits found so far with a wanted rank; a running count over the bins then
    tells the next bits of every wanted rank. A count combines on the map
    side, so a scan shuffles at most 2**RADIX narrow rows per task, column
    and wanted prefix, however the values are spread; the ranks found, at
    most two per column and probability, reach the next scan as a scalar
    subquery. Nothing is joined with the data, nothing goes to the driver,
    and no job runs before the result is asked for.
    """
    if len(cols) > COLUMNS:
        raise ValueError(f"at most {COLUMNS} columns at a time")
    images = _images(df, [F.col(f"`{c}`").cast("double") for c in cols])
    stack = ", ".join(f"{i}, s{i}" for i in range(len(cols)))
    long = images.selectExpr(f"stack({len(cols)}, {stack}) AS (c, s)").filter("s IS NOT NULL")
    rank = "array<struct<at:int,rank:bigint,share:double>>"
    found = None
    for k in range(1, PASSES + 1):
        rows = long.select("c", F.shiftright("s", 64 - RADIX * k).alias("bits"))
        if found is None:
            counts = rows.groupBy("c", "bits").agg(F.count(F.lit(1)).alias("n"))
            all_of = Window.partitionBy("c")
            last = F.sum("n").over(all_of) - 1
            wanted = [F.struct(F.lit(2 * i + j).alias("at"),
                               F.least(F.floor(last * p).cast("bigint") + j, last).alias("rank"),
                               (last * p - F.floor(last * p)).alias("share")) for i, p in enumerate(probs) for j in (0, 1)]
            counts = counts.withColumn("ranks", F.array(*wanted).cast(rank))
        else:
            key = F.shiftright("bits", RADIX) * COLUMNS + F.col("c")
            # a generator, not a filter and a projection: the subquery stands in the plan once
            match = F.filter(F.array(F.try_element_at(F.col("found"), key)), lambda r: r.isNotNull())
            rows = rows.select("c", "bits", found.alias("found")).select("c", "bits", F.explode(match).alias("ranks"))
            counts = rows.groupBy("c", "bits", "ranks").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("c", F.shiftright("bits", RADIX)).orderBy("bits") if k > 1 else Window.partitionBy("c").orderBy("bits")
        counts = counts.withColumn("before", F.sum("n").over(order) - F.col("n"))
        here = F.filter("ranks", lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("n")))
        left = F.transform(here, lambda r: F.struct(r["at"].alias("at"), (r["rank"] - F.col("before")).alias("rank"),
                                                    r["share"].alias("share"))).cast(rank)
        hits = counts.select("c", "bits", left.alias("ranks")).filter("size(ranks) > 0")
        if k < PASSES:
            entry = F.struct((F.col("bits") * COLUMNS + F.col("c")).alias("key"), "ranks")
            found = hits.agg(F.map_from_entries(F.collect_list(entry)).alias("found")).scalar()
    at = hits.select("c", "bits", F.explode("ranks").alias("r")).select("c", _value_of(F.col("bits")).alias("v"), "r.at", "r.share")
    by_rank = [F.max(F.when(F.col("at") == i, F.col("v"))).alias(f"v{i}") for i in range(2 * len(probs))]
    shares = [F.max(F.when(F.col("at") == 2 * i, F.col("share"))).alias(f"share{i}") for i in range(len(probs))]
    stats = at.groupBy("c").agg(*by_rank, *shares)
    q = []
    for i in range(len(probs)):
        lo, hi, share = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}"), F.col(f"share{i}")
        q.append(F.when((share == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * share))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), (F.col("c") + 1).cast("int"))
    return stats.select(name.alias("column"), F.array(*q).alias("q"))


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10 with exact quartiles: the one-pass moments plus
    ``exact_quantiles``, as one row per column."""
    quartiles = exact_quantiles(df, cols).select(
        "column", *[F.col("q")[i].alias(name) for i, name in enumerate(("q25", "q50", "q75"))])
    return numeric_profile(df, cols, quartiles=False).join(quartiles, "column", "left")
