"""Top N items within every group (problem 6).

Per-group histograms of the scores give, for each group, the lowest bin that still has N different items at or
above it. Rows below that bin cannot be among the first N and are dropped before the exact ranking.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import materialize

#: A group is heavy if it holds more than this part of all rows; so there are at most this many heavy groups.
HEAVY_GROUPS = 10_000
SLOTS = 64


def _finite(name: str) -> Column:
    value = F.col(name).cast("double")
    missing = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~missing, value + F.lit(0.0))


def _bin(value: str, low: float | None, high: float | None, bins: int) -> Column:
    """A bin from 1 to `bins` that never falls as the value rises."""
    if low is None or not high > low:
        return F.lit(1)
    width = high - low
    if width == float("inf"):
        share = (F.col(value) / 2 - low / 2) / (high / 2 - low / 2)
    else:
        share = (F.col(value) - F.lit(low)) / F.lit(width)
    return F.least(F.lit(bins), F.lit(1) + F.floor(share * bins).cast("int"))


def top_n(
    df: DataFrame,
    group: str,
    item: str,
    scores: tuple[str, str],
    ascending: tuple[str, ...] = (),
    n: int = 10,
    bins: int = 64,
) -> DataFrame:
    """The first `n` items of each group as (group, item, position).

    Order: both `scores` descending, then the `ascending` columns, then the item. A null, NaN or infinite score
    comes after every finite one, all such values being equal; nulls of ascending columns come last. Rows whose
    group or item is null are left out. Rows delivered twice count once; an item that occurs in a group with
    different values stands where its first occurrence stands. Groups with fewer than `n` items keep all; an
    empty table gives an empty result. Other columns of `df` are ignored, whatever their names.

    Heavy groups (over 1/HEAVY_GROUPS of all rows, hence at most HEAVY_GROUPS of them) get their thresholds by
    broadcast, so that their rows are dropped before any shuffle and the rest is deduplicated spread over all
    tasks. The other groups meet their thresholds in the shuffle by group that the ranking needs anyway.
    """
    if n < 1 or bins < 1:
        raise ValueError("n and bins must be positive")
    tail = [f"_t{i}" for i in range(len(ascending))]
    rows = df.select(
        F.col(group).alias("_g"),
        F.col(item).alias("_i"),
        _finite(scores[0]).alias("_a"),
        _finite(scores[1]).alias("_b"),
        *[F.col(c).alias(t) for c, t in zip(ascending, tail, strict=True)],
    ).where("_g is not null and _i is not null")

    limits = rows.agg(F.min("_a"), F.max("_a"), F.min("_b"), F.max("_b")).first()
    bin_of = (
        F.when(F.col("_a").isNotNull(), bins + _bin("_a", limits[0], limits[1], bins))
        .when(F.col("_b").isNotNull(), _bin("_b", limits[2], limits[3], bins))
        .otherwise(F.lit(0))
    ).cast("int")
    binned = rows.withColumn("_bin", bin_of)

    # Different items set different bits at best, so the bits set are never more than the items there are.
    words = max(1, -(-n // (SLOTS // 2)))
    hashed = F.xxhash64("_i")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(hashed, F.lit(SLOTS)).cast("int"))
    word = F.pmod(F.shiftright(hashed, 32), F.lit(words))
    histogram = binned.groupBy("_g", "_bin").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.bit_or(F.when(word == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_w{w}") for w in range(words)],
    )
    downward = Window.partitionBy("_g").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    at_least = reduce(lambda x, y: x + y, [F.bit_count(F.bit_or(f"_w{w}").over(downward)) for w in range(words)])
    thresholds = materialize(
        histogram.select("_g", "_bin", "_rows", at_least.alias("_items"))
        .groupBy("_g")
        .agg(F.sum("_rows").alias("_rows"), F.max(F.when(F.col("_items") >= n, F.col("_bin"))).alias("_floor"))
    )
    total = thresholds.agg(F.sum("_rows")).first()[0] or 0
    heavy_from = max(4 * n, total // HEAVY_GROUPS + 1)
    heavy = F.broadcast(thresholds.where(F.col("_rows") > heavy_from).select("_g", "_floor"))
    light = thresholds.where((F.col("_rows") <= heavy_from) & F.col("_floor").isNotNull()).select("_g", "_floor")

    order = [F.desc_nulls_last("_a"), F.desc_nulls_last("_b"), *[F.asc_nulls_last(t) for t in tail]]
    kept = "_floor is null or _bin >= _floor"

    # Heavy: one best occurrence of each item, found with map-side combining, over all tasks.
    negated = [F.col("_a").isNull().alias("_an"), (-F.col("_a")).alias("_a"), F.col("_b").isNull().alias("_bn"), (-F.col("_b")).alias("_b")]
    last = [c for t in tail for c in (F.col(t).isNull().alias(f"{t}n"), F.col(t).alias(t))]
    best = (
        binned.join(heavy, "_g")
        .where(kept)
        .groupBy("_g", "_i")
        .agg(F.min(F.struct(*negated, *last)).alias("_k"))
        .select("_g", "_i", (-F.col("_k._a")).alias("_a"), (-F.col("_k._b")).alias("_b"), *[F.col(f"_k.{t}").alias(t) for t in tail])
    )
    # Light: everything happens in the one exchange by group.
    first = Window.partitionBy("_g", "_i").orderBy(*order)
    rest = (
        binned.join(heavy.select("_g"), "_g", "left_anti")
        .join(light, "_g", "left")
        .where(kept)
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select(best.columns)
    )
    position = F.row_number().over(Window.partitionBy("_g").orderBy(*order, F.asc("_i")))

    def ranked(x: DataFrame) -> DataFrame:
        return x.withColumn("_p", position).where(F.col("_p") <= n)

    return ranked(best).unionByName(ranked(rest)).select(
        F.col("_g").alias(group), F.col("_i").alias(item), F.col("_p").alias("position")
    )
