"""Describing clusters: feature summaries per cluster and overall, and what tells a cluster apart."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom import schemas
from pressroom.operators.quantiles import MEDIAN_RANKS, nearest_rank, ranked_values

GLOBAL = "global"
PERCENTAGE_THRESHOLD = 0.1
Z_SCORE_THRESHOLD = 1.0
QUARTILES = {"q25": nearest_rank(0.25), "q75": nearest_rank(0.75)}


def cluster_labels(labelled: DataFrame) -> DataFrame:
    return labelled.select("label").distinct().orderBy("label")


def _feature_rows(labelled: DataFrame, features: Mapping[str, str], label: str) -> DataFrame:
    """``scope, feature, value``: every feature value once for its cluster and once for the whole."""
    values = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in features]
    )
    scopes = F.array(F.col(label).cast("string"), F.lit(GLOBAL))
    return labelled.select(F.explode(scopes).alias("scope"), values.alias("_values")).select(
        "scope", F.inline("_values")
    )


def _numerical(rows: DataFrame) -> DataFrame:
    known = F.when(~F.isnan("value"), F.col("value"))
    moments = rows.groupBy("scope", "feature").agg(
        F.avg(known).alias("mean"),
        F.stddev_samp(known).alias("std"),
        F.skewness(known).alias("skewness_index"),
        F.kurtosis(known).alias("kurtosis_index"),
    )
    # Groups are clusters times features, a number that does not grow with the users.
    order = ranked_values(rows, ["scope", "feature"], "value", {**MEDIAN_RANKS, **QUARTILES})
    order = order.withColumn("median", (F.col("lower") + F.col("upper")) / 2)
    return moments.join(order, ["scope", "feature"], "left")


def _categorical(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("scope", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("value").isNotNull(), F.col("n")).cast("double")
    total = F.sum(n)
    kinds = F.count("value")
    largest = F.struct(n, -F.col("value"))
    gini = (1 - F.sum(n * n) / (total * total)) * kinds / F.nullif(kinds - 1, F.lit(0))
    entropy = F.log2(total) - F.sum(n * F.log2(n)) / total
    return counts.groupBy("scope", "feature").agg(
        F.max_by("value", largest).alias("mode"),
        (F.max(n) / total).alias("mode_rate"),
        F.count(F.lit(1)).alias("n_unique"),
        F.when(kinds > 1, gini).otherwise(0.0).alias("normalized_gini_index"),
        F.when(kinds > 1, F.try_divide(entropy, F.log2(kinds))).otherwise(0.0).alias("normalized_entropy_index"),
    )


def cluster_summary(
    labelled: DataFrame, features: Mapping[str, str] = schemas.FEATURE_TYPES, label: str = "label"
) -> DataFrame:
    """The declared summary columns per ``scope`` (each cluster label, and ``global``) and feature.

    Numerical features get moments and quartiles (nearest rank), categorical and binary ones mode,
    distinct count (null is a value) and normalised Gini and entropy indices (of the known values; 0
    for a single value). All scopes come from the same passes; there is no loop over clusters.
    """
    numerical = {f: t for f, t in features.items() if t == "numerical"}
    others = {f: t for f, t in features.items() if t != "numerical"}
    parts = _numerical(_feature_rows(labelled, numerical, label)).unionByName(
        _categorical(_feature_rows(labelled, others, label)), allowMissingColumns=True
    )
    kind = F.coalesce(*[F.when(F.col("feature") == f, F.lit(t)) for f, t in features.items()])
    typed = parts.withColumn("feature_type", kind)
    return typed.select(
        "scope", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schemas.SUMMARY.fields]
    )


def _relative(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), b)


def discriminating_features(
    summary: DataFrame, percentage: float = PERCENTAGE_THRESHOLD, z_score: float = Z_SCORE_THRESHOLD
) -> DataFrame:
    """Every cluster's features against the whole, with ``is_discriminating``.

    Numerical: the mean differs in both relative and standardised terms. Other: the mode rate differs,
    or both indices do. A comparison with 0 never passes.
    """
    own = summary.where(F.col("scope") != GLOBAL).alias("c")
    whole = summary.where(F.col("scope") == GLOBAL).alias("g")

    def pair(name: str) -> tuple[Column, Column]:
        known = [F.col(f"{side}.{name}") for side in ("c", "g")]
        return tuple(F.nanvl(v, F.lit(0.0)) for v in known)

    means, rates = pair("mean"), pair("mode_rate")
    gini, entropy = pair("normalized_gini_index"), pair("normalized_entropy_index")
    compared = own.join(whole, "feature").select(
        F.col("c.scope").alias("label"),
        "feature",
        F.col("c.feature_type").alias("feature_type"),
        _relative(*means).alias("means_relative_difference"),
        F.try_divide(F.abs(means[0] - means[1]), F.nanvl("g.std", F.lit(0.0))).alias("statistical_relevance"),
        _relative(*rates).alias("mode_rate_relative_difference"),
        _relative(*gini).alias("n_gini_index_relative_difference"),
        _relative(*entropy).alias("n_entropy_index_relative_difference"),
    )
    numerical = (F.col("means_relative_difference") > percentage) & (F.col("statistical_relevance") > z_score)
    other = (F.col("mode_rate_relative_difference") > percentage) | (
        (F.col("n_gini_index_relative_difference") > percentage)
        & (F.col("n_entropy_index_relative_difference") > percentage)
    )
    passed = F.when(F.col("feature_type") == "numerical", numerical).otherwise(other)
    return compared.withColumn("is_discriminating", F.coalesce(passed, F.lit(False)))
