"""Running totals and first-of-key selection that survive one key holding most of the rows."""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import materialize


def running_totals(df: DataFrame, keys, order, bucket: Column, totals) -> DataFrame:
    """Add, per key, running sums up to and including the current row.

    A plain window over `keys` sorts each key in one task. Here the window runs per key and
    `bucket` (any expression that does not decrease along `order`, such as the hour of the
    timestamp), and each bucket's start offset comes from a prefix sum over the small table of
    bucket sums. A hot key is therefore spread over its buckets. Keys must not be NULL and `order`
    must be total.

    `totals` maps output name to the summed expression; `F.lit(1)` gives a rank.
    """
    keys, names = list(keys), list(totals)
    slot = keys + ["__bucket"]
    rows = df.withColumn("__bucket", bucket)
    for name in names:
        rows = rows.withColumn(f"__v_{name}", totals[name].cast("long"))
    sums = rows.groupBy(*slot).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *slot, *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names]
    )
    inside = W.partitionBy(*slot).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows
    for name in names:
        local = local.withColumn(f"__l_{name}", F.sum(f"__v_{name}").over(inside))
    joined = local.join(offsets, slot)
    for name in names:
        joined = joined.withColumn(
            name, F.coalesce(F.col(f"__l_{name}"), F.lit(0)) + F.col(f"__o_{name}")
        )
    return joined.drop(
        "__bucket", *[f"__{p}_{n}" for p in ("v", "l", "o") for n in names]
    )


HOT_ROWS = 1 << 20
SLICES = 256


def spread_totals(df: DataFrame, keys, order, lead, totals, descending=False, hot_rows=HOT_ROWS, slices=SLICES) -> DataFrame:
    """`running_totals` whose buckets follow the rows: keys of more than `hot_rows` rows are cut at
    quantiles of `lead`, so each slice has about as many rows however they bunch; the other keys are
    one plain window and are shuffled once.

    `lead` is a number or time that `order` begins with (`descending` tells its direction). Quantiles
    come from a mergeable sketch in the map tasks; a boundary that is off by some rows moves no
    result, only the size of a slice. Which keys are hot is a count per key. At most rows / `hot_rows`
    keys are hot, and if there are none the quantiles are not looked for.
    """
    keys = list(keys)
    value = F.col(lead)
    kind = df.schema[lead].dataType.typeName()
    value = F.unix_micros(value.cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else value.cast("double")
    hot = materialize(df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(*keys))
    if hot.isEmpty():
        return _one_window(df, keys, order, totals)
    named = [F.col(k).alias(f"__k_{k}") for k in keys]
    cuts = [i / slices for i in range(1, slices)]
    bounds = df.join(hot, keys, "left_semi").groupBy(*named).agg(
        F.percentile_approx(value, cuts, 10 * slices).alias("__cuts"))
    bounds = materialize(bounds)
    same = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    rows = df.join(bounds, same).withColumn("__slice", F.size(F.filter("__cuts", lambda c: c < value)))
    rows = rows.drop("__cuts", *[f"__k_{k}" for k in keys])
    slot = -F.col("__slice") if descending else F.col("__slice")
    spread = running_totals(rows, keys, order, slot, totals).drop("__slice")
    rest = _one_window(df.join(hot, keys, "left_anti"), keys, order, totals)
    return rest.unionByName(spread.select(*rest.columns))


def _one_window(df, keys, order, totals):
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.select("*", *[F.coalesce(F.sum(v.cast("long")).over(window), F.lit(0)).alias(n) for n, v in totals.items()])


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The first whole row per key: a combinable `min_by`, not a sort of the group."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    )
    return best.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def top_per_key(df: DataFrame, keys, order, k, rank="rank") -> DataFrame:
    """At most `k` rows per key. Spark cuts each map task to `k` rows per key before the shuffle
    (window group limit), so a hot key never reaches one task whole."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
