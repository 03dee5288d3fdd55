"""Segmenting users: scaling, PCA, Gaussian mixtures chosen by BIC."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.plans import mixtures
from pressroom.plans.mixtures import Mixture, bic, parameter_count

__all__ = ["Components", "MixtureChoice", "choose_mixture", "fit_components", "labelled", "parameter_count", "principal_components", "standardised"]

VARIANCE_TO_KEEP = 0.80
CLUSTER_COUNTS = tuple(range(8, 15))
RESTARTS = (5, 8, 10)
#: A fit has converged when the mean log-likelihood of a row changes by less than this.
TOLERANCE = 1e-3


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features scaled to zero mean and unit population deviation.

    Statistics skip missing values, which then become 0, the mean of a centred column; so does a
    constant column. The statistics are one row of two numbers per feature.
    """
    values = {f: F.col(f"`{f}`").cast("double") for f in features}
    known = {f: F.when(~F.isnan(v), v) for f, v in values.items()}
    statistics = df.agg(
        *[F.avg(v).alias(f"mean_{f}") for f, v in known.items()],
        *[F.stddev_pop(v).alias(f"std_{f}") for f, v in known.items()],
    ).first()

    def scaled(f: str):
        mean, std = statistics[f"mean_{f}"], statistics[f"std_{f}"]
        if not std:
            return F.lit(0.0).alias(f)
        return F.coalesce((known[f] - mean) / std, F.lit(0.0)).alias(f)

    kept = [c for c in df.columns if c not in features]
    return df.select(*[F.col(f"`{c}`") for c in kept], *[scaled(f) for f in features])


def feature_covariances(scaled: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature_a, feature_b, covariance`` of centred features, each pair once and each feature with itself.

    What the components are taken from. Products are averaged before the shuffle, so a task sends one
    row per pair whatever the number of rows.
    """
    values = F.array(*[F.col(f"`{f}`") for f in features])
    names = F.array(*[F.lit(f) for f in features])

    def product(i: int, j: int):
        return F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"))

    pairs = F.array(*[product(i, j) for i in range(len(features)) for j in range(i, len(features))])
    rows = scaled.select(values.alias("_values")).select("_values", F.inline(pairs))
    means = rows.groupBy("a", "b").agg(F.avg(F.get("_values", "a") * F.get("_values", "b")).alias("covariance"))
    return means.select(F.get(names, F.col("a")).alias("feature_a"), F.get(names, F.col("b")).alias("feature_b"), "covariance")


@dataclass(frozen=True)
class Components:
    """Principal components: loadings (features x components) and the share of the variance of each component, all of them.

    Components go by falling variance. Their sign is fixed: the loading of largest size is positive, of (nearly) equal ones
    the first feature's, so that two fits can be compared.
    """

    features: tuple[str, ...]
    loadings: np.ndarray
    shares: np.ndarray

    def needed(self, keep: float) -> int:
        """The fewest leading components whose share of the variance exceeds ``keep``."""
        return min(int((self.shares.cumsum() <= keep).sum()) + 1, len(self.features))

    def projected(self, k: int) -> Column:
        """The first ``k`` components of a row of scaled features, as array<double>."""

        def along(loading: np.ndarray) -> Column:
            terms = [F.col(f"`{f}`") * float(weight) for f, weight in zip(self.features, loading)]
            return sum(terms[1:], terms[0])

        return F.array(*[along(self.loadings[:, i]) for i in range(k)])

    def report(self, spark: SparkSession, keep: float) -> DataFrame:
        """``component`` (from 1), ``share``, ``cumulative``, ``kept`` and the strongest feature of every component."""
        total, k = self.shares.cumsum(), self.needed(keep)
        strongest = [self.features[i] for i in np.abs(self.loadings).argmax(axis=0)]
        rows = [(i + 1, float(s), float(t), i < k, f) for i, (s, t, f) in enumerate(zip(self.shares, total, strongest))]
        return spark.createDataFrame(rows, "component int, share double, cumulative double, kept boolean, strongest string")


def signed(loadings: np.ndarray) -> np.ndarray:
    sizes = np.abs(loadings)
    first = (sizes >= sizes.max(axis=0) * (1 - 1e-6)).argmax(axis=0)
    return loadings * np.where(loadings[first, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)


def fit_components(scaled: DataFrame, features: Sequence[str]) -> Components:
    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(scaled)
    model = PCA(k=len(features), inputCol="_features", outputCol="_all").fit(assembled)
    return Components(tuple(features), signed(model.pc.toArray()), model.explainedVariance.toArray())


def principal_components(
    scaled: DataFrame, features: Sequence[str], keep: float = VARIANCE_TO_KEEP, output: str = "components"
) -> DataFrame:
    """Add the fewest leading components whose share of the variance exceeds ``keep``."""
    fitted = fit_components(scaled, features)
    kept = [F.col(f"`{c}`") for c in scaled.columns if c not in features]
    return scaled.select(*kept, array_to_vector(fitted.projected(fitted.needed(keep))).alias(output))


@dataclass
class MixtureChoice:
    """The chosen mixture, and the BIC of every setting as ``(k, restarts, bic)``."""

    model: Mixture
    k: int
    restarts: int
    bic: float
    grid: list[tuple[int, int, float]]


def choose_mixture(
    df: DataFrame,
    column: str = "components",
    cluster_counts: Sequence[int] = CLUSTER_COUNTS,
    restarts: Sequence[int] = RESTARTS,
    max_iter: int = 100,
    first_seed: int = 42,
    tolerance: float = TOLERANCE,
) -> MixtureChoice:
    """Fit a grid of Gaussian mixtures and keep the one with the smallest BIC, of ties the smaller k, then the fewer restarts.

    The best of n restarts uses the first n seeds, so one fit per k and seed covers every restart setting. All fits run in the
    same passes over ``df``. Every covariance has a floor on its diagonal, so every setting can be fitted, whatever the number of
    rows. ``tolerance`` is per row. Pass a frame whose lineage is cut; it is read once per pass.
    """
    kind = dict(df.dtypes)[column]
    values = F.col(column) if kind.startswith("array") else vector_to_array(column)
    table = mixtures.rows_for(df, values)
    seeds = [first_seed + attempt for attempt in range(max(restarts))]
    fitted = mixtures.fit_grid(table, [(k, seed) for k in sorted(cluster_counts) for seed in seeds], max_iter, tolerance)
    n = table.count()
    grid, best = [], None
    for k in sorted(cluster_counts):
        for tried in sorted(restarts):
            model = max((fitted[k, seed] for seed in seeds[:tried]), key=lambda m: m.log_likelihood)
            found = bic(model.log_likelihood, k, model.means.shape[1], n)
            grid.append((k, tried, found))
            if best is None or found < best.bic:
                best = MixtureChoice(model, k, tried, found, grid)
    return best


def labelled(df: DataFrame, choice: MixtureChoice | Mixture, column: str = "components") -> DataFrame:
    """Add the cluster ``label`` of each row, and drop the components."""
    model = choice if isinstance(choice, Mixture) else choice.model
    kind = dict(df.dtypes)[column]
    values = F.col(column) if kind.startswith("array") else vector_to_array(column)
    return df.withColumn("label", mixtures.label(model, values)).drop(column)
