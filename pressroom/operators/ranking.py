"""Ranks and ranking quality over long candidate rows: ``impression_id, pos, score[, label]``.

A candidate list is one impression's in-view list, so every window below covers one short list, and
all of them share one shuffle on ``impression_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.functions.scalars import sigmoid


def _impression():
    return Window.partitionBy("impression_id")


def _by_score():
    return _impression().orderBy(F.desc("score"))


def normalised_scores(scores: DataFrame) -> DataFrame:
    """Add ``probability`` (softmax over the impression) and ``pointwise`` (sigmoid)."""
    shifted = F.exp(F.col("score") - F.max("score").over(_impression()))
    return (
        scores.withColumn("_e", shifted)
        .withColumn("probability", F.col("_e") / F.sum("_e").over(_impression()))
        .withColumn("pointwise", sigmoid(F.col("score")))
        .drop("_e")
    )


def with_rank(scores: DataFrame) -> DataFrame:
    """Add ``rank``, 1 for the highest score; of equal scores the earlier position comes first."""
    return scores.withColumn("rank", F.row_number().over(_impression().orderBy(F.desc("score"), "pos")))


def score_lists(scores: DataFrame) -> DataFrame:
    """Scores of each impression as one list in in-view order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "score")))
    return scores.groupBy("impression_id").agg(F.transform(ordered, lambda e: e["score"]).alias("scores"))


def ranked_predictions(scores: DataFrame) -> DataFrame:
    """``impression_id, ranked_scores``: the rank of every in-view article, in in-view order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "rank")))
    ranks = F.transform(ordered, lambda e: e["rank"])
    return with_rank(scores).groupBy("impression_id").agg(ranks.alias("ranked_scores"))


def submission_lines(ranked: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Text lines ``<impression id> [<rank>,<rank>,...]``, with the columns of ``keep`` beside them."""
    line = F.concat(F.col("impression_id").cast("string"), F.lit(" ["), F.array_join("ranked_scores", ","), F.lit("]"))
    return ranked.select(*keep, line.alias("value"))


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def _ndcg(k: int, clicked: Column) -> Column:
    gained = F.sum(F.when((F.col("label") == 1) & (F.col("rank") <= k), _gain(F.col("rank"))).otherwise(0.0))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(clicked, F.lit(k)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + _gain(i),
    )
    return F.when(clicked > 0, gained / ideal)


def impression_metrics(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """AUC, MRR, NDCG@5 and NDCG@10 of each impression; null where a metric is undefined."""
    # Equal scores share the mean of their ranks, counted from the lowest score up.
    ties = F.count(F.lit(1)).over(_by_score().rangeBetween(Window.currentRow, Window.currentRow))
    above = F.rank().over(_by_score())
    ranked = (
        with_rank(scored)
        .withColumn("_ties", ties)
        .withColumn("_above", above)
        .withColumn("_size", F.count(F.lit(1)).over(_impression()))
        .withColumn("_up", F.col("_size") + 1 - (F.col("_above") + (F.col("_ties") - 1) / 2))
    )
    clicked = F.sum(F.col("label").cast("bigint"))
    others = F.count(F.lit(1)) - clicked
    rank_sum = F.sum(F.when(F.col("label") == 1, F.col("_up")).otherwise(0.0))
    auc = F.try_divide(rank_sum - clicked * (clicked + 1) / 2, clicked * others)
    mrr = F.try_divide(F.sum(F.col("label") / F.col("rank")), clicked)
    return ranked.groupBy("impression_id", *keep).agg(
        auc.alias("auc"), mrr.alias("mrr"), _ndcg(5, clicked).alias("ndcg@5"), _ndcg(10, clicked).alias("ndcg@10")
    )


def ranking_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each metric over the impressions where it is defined, and how many were left out of the AUC."""
    per_impression = impression_metrics(scored, by)
    return per_impression.groupBy(*by).agg(
        *[F.avg(F.col(f"`{m}`")).alias(m) for m in ("auc", "mrr", "ndcg@5", "ndcg@10")],
        F.count(F.lit(1)).alias("n_impressions"),
        F.count_if(F.col("auc").isNull()).alias("n_skipped"),
    )
