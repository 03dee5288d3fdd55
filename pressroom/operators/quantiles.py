"""Exact order statistics that do not gather a group in one task.

The built-in exact percentile keeps every distinct value of a group in one hash map. That suits a
group of bounded size; for larger ones the functions here count rows per narrow value range first
(map-side combined, a few thousand ranges per group), find the range that holds each wanted rank,
and only then sort the distinct values inside those ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.operators.skew import HOT_ROWS, hot_keys, hottest
from pressroom.session import cut_lineage

MEDIAN_RANKS = {
    "lower": lambda n: F.floor((n + 1) / 2),
    "upper": lambda n: F.floor(n / 2) + 1,
}

# 1024 ranges per doubling: each is about 0.07 % wide.
RANGES_PER_DOUBLING = 1024
# Above the largest binary exponent of a double times the ranges per doubling.
RANGE_OFFSET = 1200 * RANGES_PER_DOUBLING


def nearest_rank(q: float):
    """1-based rank of the nearest-rank quantile among n sorted values."""
    return lambda n: F.floor(F.lit(q) * (n - 1) + 0.5) + 1


def value_range(value: Column) -> Column:
    """Number of the value's range; larger values never get a smaller number."""
    doublings = F.least(F.log2(F.abs(value)), F.lit(1100.0))
    magnitude = F.floor(doublings * RANGES_PER_DOUBLING) + RANGE_OFFSET
    return F.when(value == 0, F.lit(0)).when(value > 0, magnitude).otherwise(-magnitude).cast("bigint")


#: Above the range of every number.
NAN_RANGE = 1 << 62


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, object], nan_last: bool = False) -> DataFrame:
    """One row per key: the value at each named rank of the sorted non-null values; NaN is skipped, or comes last.

    The number of groups must be bounded by the caller (hot groups, or columns times clusters):
    the wanted ranges, at most one per group and rank, are broadcast for the second pass.
    """
    keys = list(keys)
    values = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & (F.lit(nan_last) | ~F.isnan("_v")))
        .withColumn("_range", F.when(F.isnan("_v"), F.lit(NAN_RANGE)).otherwise(value_range(F.col("_v"))))
    )
    per_range = values.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), F.col("_total").alias("n")) for name in ranks]
    )
    rank_of = F.coalesce(
        *[F.when(F.col("_w.name") == name, rank(F.col("_w.n"))) for name, rank in ranks.items()]
    ).cast("bigint")
    targets = (
        per_range.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(group))
        .withColumn("_w", F.explode(wanted))
        .withColumn("_rank", rank_of)
        .where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
        .select(
            *keys,
            "_range",
            F.struct(F.col("_w.name").alias("name"), (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("rank")).alias("_w"),
        )
        .groupBy(*keys, "_range")
        .agg(F.collect_list("_w").alias("_wanted"))
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = (
        values.join(F.broadcast(targets), [*keys, "_range"])
        .groupBy(*keys, "_range", "_v")
        .agg(F.count(F.lit(1)).alias("_n"), F.any_value("_wanted").alias("_wanted"))
        .withColumn("_upto", F.sum("_n").over(in_range))
    )
    hits = counted.withColumn("_w", F.explode("_wanted")).where(
        (F.col("_w.rank") <= F.col("_upto")) & (F.col("_w.rank") > F.col("_upto") - F.col("_n"))
    )
    return hits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_w.name") == name, F.col("_v"))).alias(name) for name in ranks]
    )


def grouped_median(
    df: DataFrame, key: str, value: str, alias: str, min_rows: int = HOT_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Exact median per key, nulls skipped; keys with null values only keep a null median.

    Keys of up to ``min_rows`` rows use the built-in median in one shuffle; the few larger ones are
    taken apart by ``ranked_values``. Either way NaN ranks above all numbers. Null keys are one group, taken apart like any other.

    ``counted`` may have the rows of each key (``key`` and ``_rows``, null values included). The large keys are then known
    beforehand: without any, the table is read once, and else the rows of these keys are written to the shared folder in one more read.
    """
    # Inside a struct a null key equals itself, in joins as well.
    rows = df.select(F.struct(F.col(key).alias("key")).alias("_key"), F.col(value).alias("_value"))
    if counted is None:
        large = hot_keys(rows, ["_key"], min_rows)
    else:
        large = cut_lineage(hottest(counted.select(F.struct(F.col(key).alias("key")).alias("_key"), "_rows"), ["_key"], min_rows))
        if large.isEmpty():
            return rows.groupBy("_key").agg(F.median("_value").cast("double").alias(alias)).select(F.col("_key.key").alias(key), alias)
    hot = F.broadcast(large.select("_key", F.lit(True).alias("_hot")))
    usual = F.when(F.col("_hot").isNull(), F.col("_value"))
    medians = rows.join(hot, "_key", "left").groupBy("_key").agg(F.median(usual).cast("double").alias("_median"))
    own = rows.join(hot, "_key", "left_semi")
    ends = ranked_values(own if counted is None else cut_lineage(own), ["_key"], "_value", MEDIAN_RANKS, nan_last=True)
    # As many rows at most as there are hot keys.
    found = medians.join(F.broadcast(ends), "_key", "left")
    return found.select(F.col("_key.key").alias(key), F.coalesce("_median", (F.col("lower") + F.col("upper")) / 2).alias(alias))
