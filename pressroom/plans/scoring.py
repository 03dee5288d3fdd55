"""User profiles from article vectors, and candidate scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.functions.arrays import dot
from pressroom.operators.skew import BROADCAST_BYTES, HOT_ROWS, hot_keys, hottest, skew_join

DECAY = 0.05
PAIR = ["user_id", "split", "article_id"]


@dataclass(frozen=True)
class Vectors:
    """Article vectors and how to join them: by broadcast, or by a shuffle that splits hot articles."""

    table: DataFrame
    broadcast: bool = False

    def joined(
        self, rows: DataFrame, spread_by: Sequence[str], how: str = "inner", min_rows: int = HOT_ROWS,
        hot: DataFrame | None = None,
    ) -> DataFrame:
        if self.broadcast:
            return rows.join(F.broadcast(self.table), "article_id", how)
        return skew_join(rows, self.table, ["article_id"], spread_by, how, min_rows, hot)


def vectors_for_join(docvec: DataFrame, limit: int = BROADCAST_BYTES) -> Vectors:
    """Article vectors, broadcast while they fit the limit.

    Without a broadcast every entry or pair has to be shuffled together with a vector; with it, only
    ids are. Measured once per call, so pass the result to both the profile and the scores. The size is
    summed over the whole table, so it holds for this run's data whatever the statistics say.
    """
    row_bytes = 16 + 4 * F.coalesce(F.size("contrastive_vector"), F.lit(0))
    measured = docvec.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0
    return Vectors(docvec, measured <= limit)


def as_vectors(docvec: DataFrame | Vectors) -> Vectors:
    return docvec if isinstance(docvec, Vectors) else Vectors(docvec)


def time_decay_profile(
    recent: DataFrame, docvec: DataFrame | Vectors, alpha: float = DECAY, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean vector of each user's recent articles, weighted by ``exp(-alpha * lag)``.

    Articles without a vector take no part. Users without any known article are absent.
    """
    ids = recent.select("user_id", "split", "lag", "article_id")
    entries = as_vectors(docvec).joined(ids, ["user_id", "split", "lag"], min_rows=min_rows)
    mean = Summarizer.mean(array_to_vector("contrastive_vector"), F.exp(F.col("lag") * F.lit(-alpha)))
    return entries.groupBy("user_id", "split").agg(vector_to_array(mean).alias("profile"))


def candidates(behaviors: DataFrame) -> DataFrame:
    """One row per impression and in-view article with its click label."""
    shown = behaviors.select(
        "impression_id",
        "user_id",
        "split",
        "article_ids_clicked",
        F.posexplode_outer("article_ids_inview").alias("pos", "article_id"),
    ).where(F.col("pos").isNotNull())
    label = F.coalesce(F.array_contains("article_ids_clicked", F.col("article_id")), F.lit(False))
    return shown.withColumn("label", label.cast("tinyint")).drop("article_ids_clicked")


def pair_scores(
    pairs: DataFrame, profile: DataFrame, docvec: DataFrame | Vectors, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``score``, profile times article vector, to distinct ``user_id, split, article_id``; 0 where either is unknown."""
    hot = hot_keys(pairs.select("article_id"), ["article_id"], min_rows)
    known = pairs.join(profile, ["user_id", "split"], "left")
    matched = as_vectors(docvec).joined(known, ["user_id", "split"], "left", min_rows, hot)
    score = F.coalesce(dot(F.col("profile"), F.col("contrastive_vector")), F.lit(0.0))
    return matched.withColumn("score", score).drop("profile", "contrastive_vector")


def join_per_pair(
    rows: DataFrame, attach: Callable[[DataFrame], DataFrame], min_rows: int = HOT_ROWS
) -> DataFrame:
    """Join candidate rows with what ``attach`` adds to their user, split and article.

    ``attach`` sees the distinct triples only, so a user or article that fills the log is worked out
    once per triple, and vectors never travel with the impressions. The count of each triple also
    tells which ones to split when the result is joined back, so ``attach`` has to keep its column ``_rows``.
    """
    counted = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_rows"))
    hot = hottest(counted, PAIR, min_rows)
    return skew_join(rows, attach(counted), PAIR, ["impression_id", "pos"], min_rows=min_rows, hot=hot, counted=True)


def candidate_scores(
    behaviors: DataFrame, profile: DataFrame, docvec: DataFrame | Vectors, min_rows: int = HOT_ROWS
) -> DataFrame:
    """``impression_id, user_id, split, pos, article_id, label, score`` for every in-view article."""
    return join_per_pair(candidates(behaviors), lambda pairs: pair_scores(pairs, profile, docvec, min_rows), min_rows)
