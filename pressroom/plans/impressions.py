"""Preparing impressions for a ranking model: history, sampling, labels, splits, feature joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions.arrays import pad_left, pad_right
from pressroom.functions.scalars import id_hash
from pressroom.operators.skew import HOT_ROWS, skew_join
from pressroom.plans.features import HISTORY_SIZE
from pressroom.session import cut_lineage
from pressroom.sources.tables import read_behaviors, read_history

PAD = 0
SEED = 123
NEGATIVES_PER_CLICK = 5


def history_lists(recent: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """Recent article ids per user and split as one list, oldest first. A group has at most ``n`` entries."""
    entries = F.filter(
        F.array_sort(F.collect_list(F.struct((-F.col("lag")).alias("at"), "pos", "article_id"))),
        lambda e: e["pos"].isNotNull(),
    )
    ids = F.transform(entries, lambda e: e["article_id"])
    return recent.where(F.col("lag") < n).groupBy("user_id", "split").agg(ids.alias("article_id_fixed"))


def padded_history(recent: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """The same lists filled up to ``n`` on the left, so the most recent article stays last."""
    return history_lists(recent, n).withColumn("article_id_fixed", pad_left(F.col("article_id_fixed"), n, PAD))


def padded_history_from_lists(history: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """The same from list histories, inside the row."""
    return history.select("user_id", "split", pad_left(F.col("article_id_fixed"), n, PAD).alias("article_id_fixed"))


def with_history(
    behaviors: DataFrame, recent: DataFrame, n: int = HISTORY_SIZE, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of impressions with their user's history of the same split, padded on the left to ``n``."""
    return skew_join(behaviors, padded_history(recent, n), ["user_id", "split"], ["impression_id"], min_rows=min_rows)


def sample(df: DataFrame, fraction: float, key: str = "impression_id", seed: int = SEED) -> DataFrame:
    """A random fraction of the rows, chosen by a hash of the key: the same rows under any partitioning."""
    return df.where(id_hash(F.col(key), seed) < F.lit(int(fraction * 2**32)))


def load_split(
    spark: SparkSession, root: str, splits: Sequence[str], n: int = HISTORY_SIZE, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Impressions of the named split folders, each with its user's padded history."""
    histories = padded_history_from_lists(read_history(spark, root, splits), n)
    return skew_join(
        read_behaviors(spark, root, splits), histories, ["user_id", "split"], ["impression_id"], min_rows=min_rows
    )


def _unclicked() -> Column:
    return F.array_except("article_ids_inview", "article_ids_clicked")


def negative_samples(
    behaviors: DataFrame, per_click: int = NEGATIVES_PER_CLICK, seed: int = SEED, with_replacement: bool = True
) -> DataFrame:
    """One row per click: the clicked article and ``per_click`` unclicked in-view articles, shuffled.

    Without replacement, the articles of the smallest hashes are drawn, all of them where there are fewer. An impression without
    an unclicked article gives no row. Everything happens inside the row, so there is no shuffle.
    """
    clicks = behaviors.withColumn("_unclicked", _unclicked()).withColumn(
        "clicked_article_id", F.explode(F.when(F.size("_unclicked") > 0, F.col("article_ids_clicked")))
    )

    def hashed(draw: int, *extra: str) -> Column:
        return id_hash(F.col("impression_id"), F.col("clicked_article_id"), draw, *extra, seed)

    def candidate(draw: int, article: Column) -> Column:
        return F.struct(
            hashed(draw, "order").alias("order"),
            F.lit(draw).alias("draw"),
            article.alias("article_id"),
            F.lit(1 if draw < 0 else 0).cast("tinyint").alias("label"),
        )

    def drawn(draw: int) -> Column:
        return F.get(F.col("_unclicked"), (hashed(draw) % F.size("_unclicked")).cast("int"))

    if with_replacement:
        # Written out per draw rather than as a function over the draw numbers, so that it is compiled.
        negatives = [candidate(draw, drawn(draw)) for draw in range(per_click)]
        shuffled = F.sort_array(F.array(candidate(-1, F.col("clicked_article_id")), *negatives))
    else:
        def by_hash(name: str, article: Column, label: int) -> Column:
            mark = id_hash(F.col("impression_id"), F.col("clicked_article_id"), article, F.lit(name), seed)
            return F.struct(mark.alias("order"), article.alias("article_id"), F.lit(label).cast("tinyint").alias("label"))

        few = F.slice(F.sort_array(F.transform("_unclicked", lambda a: by_hash("draw", a, 0))), 1, per_click)
        others = F.transform(few, lambda c: by_hash("order", c["article_id"], 0))
        shuffled = F.sort_array(F.concat(F.array(by_hash("order", F.col("clicked_article_id"), 1)), others))
    return (
        clicks.withColumn("_candidates", shuffled)
        .withColumn("article_ids_inview", F.col("_candidates.article_id"))
        .withColumn("labels", F.col("_candidates.label"))
        .drop("_candidates", "_unclicked", "article_ids_clicked")
    )


def binary_labels(behaviors: DataFrame) -> DataFrame:
    """``labels``: 1 where the in-view article was clicked, aligned with the in-view list."""
    clicked = F.coalesce("article_ids_clicked", F.array().cast("array<bigint>"))
    labels = F.transform(
        "article_ids_inview", lambda a: F.coalesce(F.array_contains(clicked, a), F.lit(False)).cast("tinyint")
    )
    return behaviors.withColumn("labels", labels)


def last_day_cut(df: DataFrame) -> Column:
    """The day before the latest impression's day, as a scalar subquery."""
    return df.agg(F.date_sub(F.max(F.to_date("impression_time")), 1)).scalar()


def temporal_split(df: DataFrame) -> DataFrame:
    """Add ``part``: ``train`` before the last two days, ``validation`` in them."""
    early = F.to_date("impression_time") < last_day_cut(df)
    return df.withColumn("part", F.when(early, "train").otherwise("validation"))


def with_user_features(df: DataFrame, features: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Attach the features of each impression's user; users without features are dropped."""
    return skew_join(df, features, ["user_id"], ["impression_id"], min_rows=min_rows)


def training_impressions(
    behaviors: DataFrame,
    recent: DataFrame,
    features: Sequence[DataFrame],
    fraction: float = 1.0,
    per_click: int = NEGATIVES_PER_CLICK,
    seed: int = SEED,
    n: int = HISTORY_SIZE,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Sampled, labelled impressions with history and user features, split by the last day.

    Histories and features are joined to each other first, so the impressions move once; candidates
    are drawn after that, from the rows that are left.
    """
    users = padded_history(recent, n)
    for table in features:
        users = users.join(table, "user_id")
    chosen = (
        behaviors.select(
            "impression_id", "user_id", "split", "impression_time", "article_ids_inview", "article_ids_clicked"
        )
        .where(F.size("article_ids_clicked") > 0)
        .transform(sample, fraction=fraction, seed=seed)
    )
    # Read twice: for the join, and for the cut, which needs one date per user of the impressions that stay.
    users = cut_lineage(users)
    latest = (
        chosen.where(F.size(_unclicked()) > 0)
        .groupBy("user_id", "split")
        .agg(F.max(F.to_date("impression_time")).alias("_day"))
        .join(users.select("user_id", "split"), ["user_id", "split"], "left_semi")
    )
    early = F.to_date("impression_time") < latest.agg(F.date_sub(F.max("_day"), 1)).scalar()
    return (
        skew_join(chosen, users, ["user_id", "split"], ["impression_id"], min_rows=min_rows)
        .transform(negative_samples, per_click=per_click, seed=seed)
        .withColumn("part", F.when(early, "train").otherwise("validation"))
    )


def test_impressions(
    behaviors: DataFrame,
    recent: DataFrame,
    engagement: DataFrame,
    fraction: float = 1.0,
    seed: int = SEED,
    n: int = HISTORY_SIZE,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Unlabelled test impressions: no clicks, premium propensity 0, labels all 0."""
    return (
        behaviors.where(F.col("split") == "test")
        .select("impression_id", "user_id", "split", "impression_time", "article_ids_inview")
        .transform(sample, fraction=fraction, seed=seed)
        .withColumn("article_ids_clicked", F.array().cast("array<bigint>"))
        .transform(skew_join, padded_history(recent, n).join(engagement, "user_id"), ["user_id", "split"],
                   ["impression_id"], min_rows=min_rows)
        .withColumn("premium_propensity", F.lit(0))
        .transform(binary_labels)
    )


def evaluation_impressions(
    behaviors: DataFrame,
    recent: DataFrame,
    features: Sequence[DataFrame],
    fraction: float = 1.0,
    seed: int = SEED,
    n: int = HISTORY_SIZE,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Labelled validation impressions with their whole in-view lists, history and user features; nothing is drawn."""
    users = padded_history(recent, n)
    for table in features:
        users = users.join(table, "user_id")
    return (
        behaviors.where(F.col("split") == "validation")
        .select("impression_id", "user_id", "split", "impression_time", "article_ids_inview", "article_ids_clicked")
        .transform(sample, fraction=fraction, seed=seed)
        .transform(skew_join, users, ["user_id", "split"], ["impression_id"], min_rows=min_rows)
        .transform(binary_labels)
    )


def padded_inview(behaviors: DataFrame) -> DataFrame:
    """In-view lists cut and right-padded to the longest list of the table."""
    longest = behaviors.agg(F.max(F.size("article_ids_inview"))).scalar()
    return behaviors.select(
        "impression_id", pad_right(F.col("article_ids_inview"), longest, PAD).alias("padded_inview")
    )


def mapped_inview(
    behaviors: DataFrame, mapping: DataFrame, value: str, default: float = 0.0, min_rows: int = HOT_ROWS
) -> DataFrame:
    """In-view list with each article replaced by its ``value``, unknown articles by ``default``."""
    shown = behaviors.select("impression_id", F.posexplode_outer("article_ids_inview").alias("_pos", "article_id"))
    values = mapping.select("article_id", F.col(value).alias("_value"))
    found = skew_join(shown, values, ["article_id"], ["impression_id"], "left", min_rows=min_rows)
    entry = F.when(
        F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_value", F.lit(default)).alias("_value"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_value"])
    return found.groupBy("impression_id").agg(ordered.alias(value))


def mapped_lists(
    rows: DataFrame,
    lists: Sequence[str],
    mapping: DataFrame,
    values: Mapping[str, float],
    keys: Sequence[str] = ("impression_id",),
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """``keys`` and, for each of the id ``lists`` and each of the ``values`` columns of ``mapping``, the list of that value.

    The new columns are named ``<list>_<value>``, in the order of the ids. ``values`` has the number that an unknown or null id or a
    null value gets, so an id that is not in the mapping is a row of these. All lists travel as tagged entries through one
    join and one regrouping; ids that fill the log are split by ``skew_join``. A null or empty list gives empty lists. Keys are distinct.
    """
    keys = list(keys)

    def entries(name: str, tag: int) -> Column:
        ids = F.coalesce(F.col(name), F.array().cast(dict(rows.dtypes)[name]))
        return F.transform(ids, lambda x, i: F.struct(F.lit(tag).alias("_tag"), i.alias("_pos"), x.cast("bigint").alias("article_id")))

    every = F.flatten(F.array(*[entries(name, tag) for tag, name in enumerate(lists)]))
    tagged = rows.select(*keys, F.inline_outer(every))
    table = mapping.select(F.col("article_id").cast("bigint").alias("article_id"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    found = skew_join(tagged, table, ["article_id"], [*keys, "_tag", "_pos"], "left", min_rows)
    filled = [F.coalesce(f"_v{i}", F.lit(float(default))).alias(f"_v{i}") for i, default in enumerate(values.values())]
    # A null entry stands for a row without ids; it is left out of the lists.
    held = F.array_sort(F.collect_list(F.when(F.col("_tag").isNotNull(), F.struct("_tag", "_pos", *filled))))
    grouped = found.groupBy(*keys).agg(held.alias("_held"))

    def column(tag: int, i: int) -> Column:
        return F.transform(F.filter("_held", lambda e: e["_tag"] == tag), lambda e: e[f"_v{i}"])

    made = [column(tag, i).alias(f"{name}_{v}") for tag, name in enumerate(lists) for i, v in enumerate(values)]
    return grouped.select(*keys, *made)
