"""Comparing experiment runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.schemas import METRICS

# Weights of the metrics in the overall score.
SCORE_WEIGHTS = {"auc": 0.5, "mrr": 0.3, "ndcg@5": 0.1, "ndcg@10": 0.1}


def encoded(column: str, first: str) -> Column:
    """1 for the value ``first``, 2 for any other."""
    return F.when(F.col(f"`{column}`") == first, 1).otherwise(2)


def with_overall_score(results: DataFrame) -> DataFrame:
    score = sum((F.col(f"`{m}`") * weight for m, weight in SCORE_WEIGHTS.items()), F.lit(0.0))
    return results.withColumn("overall score", score)


def best_run(results: DataFrame) -> DataFrame:
    """The run with the highest overall score; the smaller run id wins a tie."""
    return with_overall_score(results).orderBy(F.desc("overall score"), "run id").limit(1)


def winners_per_model(results: DataFrame, model: str = "used model") -> DataFrame:
    """All runs that reach their model's highest overall score, ties kept."""
    order = Window.partitionBy(f"`{model}`").orderBy(F.desc("overall score"))
    ranked = with_overall_score(results).withColumn("_rank", F.rank().over(order)).where(F.col("_rank") == 1)
    return ranked.drop("_rank").orderBy(F.desc("overall score"))


def _correlation(a: Column, b: Column) -> Column:
    # Null for a constant column. Both sides are cut to the rows where neither is null.
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def param_correlations(
    results: DataFrame, parameters: Mapping[str, Column], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """``metric, parameter, correlation, rank``: Pearson correlations, highest first per metric.

    All pairs come from one aggregation over the results.
    """
    pairs = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(name).alias("parameter"),
            _correlation(F.col(f"`{metric}`"), value).alias("correlation"),
        )
        for metric in metrics
        for name, value in parameters.items()
    ]
    table = results.agg(F.array(*pairs).alias("_pairs")).select(F.inline("_pairs"))
    order = Window.partitionBy("metric").orderBy(F.desc_nulls_last("correlation"), "parameter")
    return table.withColumn("rank", F.row_number().over(order))
