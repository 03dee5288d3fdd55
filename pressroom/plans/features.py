"""User and article features. Every function takes and returns DataFrames; histories are long.

The thresholds are arguments; their defaults and the class codes are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.functions.arrays import list_mean, list_tail
from pressroom.functions.scalars import two_level
from pressroom.operators.quantiles import grouped_median
from pressroom.operators.sessions import hour_cells, meaningful, sessions_of_cells, time_profile
from pressroom.operators.skew import HOT_ROWS, first_rows, hot_keys, hottest, skew_join
from pressroom.session import cut_lineage
from pressroom.sources.tables import entry_fields, zipped_lists

HISTORY_SIZE = 20
TRAIN = ("train",)
TRAIN_VALIDATION = ("train", "validation")

# Thresholds of the class features and the sentiment labels.
ARTICLE_LENGTH_THRESHOLD = 2000
SCROLL_PERCENTAGE_THRESHOLD = 60
MEAN_READING_TIME_THRESHOLD = 45
MEAN_DAILY_IMPRESSIONS_THRESHOLD = 5
PREMIUM_CUTS = (0.2, 0.5)
SENTIMENTS = {"Positive": "positive", "Neutral": "neutral", "Negative": "negative"}


def of_splits(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    return df.where(F.col("split").isin(*splits))


# Recent history


def recent_entries(history: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """Last ``n`` entries per user and split, with ``lag`` 0 for the most recent one.

    A history without entries keeps its one row, with a null ``pos``.
    """
    latest = first_rows(history, ["user_id", "split"], [F.col("pos").desc_nulls_last()], n, "_rank")
    return latest.withColumn("lag", F.col("_rank") - 1).drop("_rank")


def recent_entries_from_lists(history: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """The same from a list history: the lists are cut inside the row, without a shuffle."""
    zipped = list_tail(zipped_lists(), n)
    entries = history.select(
        "user_id", "split", F.size(zipped).alias("_n"), F.posexplode_outer(zipped).alias("pos", "_e")
    )
    return entries.select(
        "user_id",
        "split",
        "pos",
        *entry_fields("_e"),
        F.coalesce(F.col("_n") - F.col("pos") - 1, F.lit(0)).alias("lag"),
    )


# Articles


def premium_articles(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", F.col("premium").cast("float").alias("premium"))


def article_length(articles: DataFrame) -> DataFrame:
    """Characters (code points) of the whole body; null for a null body."""
    return articles.select("article_id", F.length("body").alias("article_length"))


def article_features(docvec: DataFrame, premium: DataFrame, length: DataFrame) -> DataFrame:
    """Vectors of the articles that have both features."""
    return docvec.join(premium, "article_id").join(length, "article_id")


# Users, from impressions


def favourite_device(behaviors: DataFrame, splits: Sequence[str] = TRAIN_VALIDATION) -> DataFrame:
    """Median device code, truncated.

    Impressions are counted per user and code before the shuffle, and there are three codes, so the
    median of a user with any number of impressions is taken over three counts.
    """
    counts = of_splits(behaviors, splits).groupBy("user_id", "device_type").agg(F.count(F.lit(1)).alias("_n"))
    median = F.percentile("device_type", F.lit(0.5), F.col("_n")).cast("tinyint")
    return counts.groupBy("user_id").agg(median.alias("favourite_device"))


def median_next_read_time(
    behaviors: DataFrame, splits: Sequence[str] = TRAIN_VALIDATION, min_rows: int = HOT_ROWS
) -> DataFrame:
    rows = of_splits(behaviors, splits)
    return grouped_median(rows, "user_id", "next_read_time", "median_next_read_time", min_rows)


def subscription_status(behaviors: DataFrame, splits: Sequence[str] = TRAIN_VALIDATION) -> DataFrame:
    """1 when no impression says otherwise; unknown flags are skipped."""
    every = F.coalesce(F.bool_and("is_subscriber"), F.lit(True))
    return of_splits(behaviors, splits).groupBy("user_id").agg(every.cast("float").alias("is_subscriber"))


def subscription_consistency(behaviors: DataFrame, splits: Sequence[str] = TRAIN_VALIDATION) -> DataFrame:
    """Number of distinct subscription flags per user, an unknown flag counting as a value."""
    flag = F.col("is_subscriber")
    seen = [F.max(F.coalesce(test, F.lit(False)).cast("int")) for test in (flag, ~flag, flag.isNull())]
    return of_splits(behaviors, splits).groupBy("user_id").agg((seen[0] + seen[1] + seen[2]).alias("n_unique"))


def premium_ids(articles: DataFrame) -> DataFrame:
    return articles.where("premium").select("article_id").distinct()


def premium_clicks(behaviors: DataFrame, articles: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Clicks on premium articles, one row per click."""
    article = F.explode_outer("article_ids_clicked").alias("article_id")
    clicks = behaviors.select("impression_id", "user_id", "split", article)
    # The ids are distinct, so the join keeps each click once.
    return skew_join(clicks, premium_ids(articles), ["article_id"], ["impression_id"], min_rows=min_rows).select(
        "impression_id", "user_id", "split", "article_id"
    )


def premium_click_counts(
    behaviors: DataFrame, articles: DataFrame, splits: Sequence[str] = TRAIN, min_rows: int = HOT_ROWS
) -> DataFrame:
    """``user_id, clicked_articles, premium_clicked_articles``; users without clicks are kept with zeros.

    Clicks are counted per user and article before the article table is joined.
    """
    clicks = _clicks(behaviors, splits)
    # An article has no more users than clicks, so the articles with many clicks cover those with many users.
    hot = hot_keys(clicks.select("article_id"), ["article_id"], min_rows)
    return _premium_counts(_clicks_per_article(clicks), articles, hot)


def _clicks(behaviors: DataFrame, splits: Sequence[str]) -> DataFrame:
    return of_splits(behaviors, splits).select(
        "user_id", F.posexplode_outer("article_ids_clicked").alias("_pos", "article_id")
    )


def _clicks_per_article(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("user_id", "article_id").agg(F.count("_pos").alias("_n"))


def _premium_counts(per_article: DataFrame, articles: DataFrame, hot: DataFrame) -> DataFrame:
    flags = premium_ids(articles).withColumn("_premium", F.lit(True))
    flagged = skew_join(per_article, flags, ["article_id"], ["user_id"], "left", hot=hot)
    return flagged.groupBy("user_id").agg(
        F.sum("_n").alias("clicked_articles"),
        F.sum(F.when(F.col("_premium"), F.col("_n")).otherwise(0)).alias("premium_clicked_articles"),
    )


def premium_propensity(behaviors: DataFrame, articles: DataFrame, splits: Sequence[str] = TRAIN) -> DataFrame:
    """1 free only, 2 mixed, 3 premium heavy, by the premium share of the clicks (no clicks: 1)."""
    return _premium_code(premium_click_counts(behaviors, articles, splits))


def _premium_code(counts: DataFrame) -> DataFrame:
    low, high = PREMIUM_CUTS
    share = F.coalesce(F.try_divide("premium_clicked_articles", "clicked_articles"), F.lit(0.0))
    code = F.when(share < low, 1).when(share < high, 2).otherwise(3).cast("int")
    return counts.select("user_id", code.alias("premium_propensity"))


def visit_profile(behaviors: DataFrame, splits: Sequence[str] = TRAIN_VALIDATION) -> DataFrame:
    """``favourite_device`` and ``subscription_status`` in one pass: ``user_id, favourite_device, is_subscriber``."""
    return _visits_of_counts(_visit_counts(behaviors, splits))


def _visit_counts(behaviors: DataFrame, splits: Sequence[str]) -> DataFrame:
    return of_splits(behaviors, splits).groupBy("user_id", "device_type").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and("is_subscriber").alias("_every")
    )


def _visits_of_counts(counts: DataFrame) -> DataFrame:
    median = F.percentile("device_type", F.lit(0.5), F.col("_n")).cast("tinyint")
    every = F.coalesce(F.bool_and("_every"), F.lit(True)).cast("float")
    return counts.groupBy("user_id").agg(median.alias("favourite_device"), every.alias("is_subscriber"))


# Users, from histories


def _engagement(mean_reading_time, impressions, days):
    # No day between the ends: the daily rate is unbounded, which a null test treats as high too.
    daily = F.try_divide(impressions.cast("double"), days.cast("double"))
    return two_level(
        mean_reading_time <= MEAN_READING_TIME_THRESHOLD, daily <= MEAN_DAILY_IMPRESSIONS_THRESHOLD
    ).alias("reading_engagement")


def _days_between(first, last, span: str):
    if span == "day_of_year":
        return F.dayofyear(last) - F.dayofyear(first)
    if span == "calendar":
        return F.datediff(last, first)
    raise ValueError(f"unknown span: {span}")


def reading_engagement(
    history: DataFrame, splits: Sequence[str] = TRAIN, span: str = "day_of_year"
) -> DataFrame:
    """1 occasional researcher, 2 bored, 3 occasional reader, 4 usual reader.

    One map-side combined aggregation over entries in time order: count, mean, first and last instant.
    ``span='calendar'`` counts whole days across a year's end; the default compares days of the year.
    """
    ends = of_splits(history, splits).groupBy("user_id", "split").agg(
        F.count("pos").alias("_n"),
        F.min("impression_time").alias("_first"),
        F.max("impression_time").alias("_last"),
        F.avg("read_time").alias("_mean"),
    )
    days = _days_between(F.col("_first"), F.col("_last"), span)
    return ends.select("user_id", _engagement(F.col("_mean"), F.col("_n"), days))


def history_profile(history: DataFrame, span: str = "day_of_year") -> DataFrame:
    """``history_users`` joined with ``reading_engagement``, in one pass: ``user_id, reading_engagement``.

    One row per history of the training and validation splits, for users with a training history.
    """
    train = F.col("split") == TRAIN[0]

    def kept(name: str):
        return F.when(train, F.col(name))

    ends = of_splits(history, TRAIN_VALIDATION).groupBy("user_id").agg(
        F.count(kept("pos")).alias("_n"),
        F.min(kept("impression_time")).alias("_first"),
        F.max(kept("impression_time")).alias("_last"),
        F.avg(kept("read_time")).alias("_mean"),
        F.bool_or(train).alias("_train"),
        F.bool_or(~train).alias("_validation"),
    )
    days = _days_between(F.col("_first"), F.col("_last"), span)
    rows = ends.where("_train").withColumn("_times", F.when(F.col("_validation"), 2).otherwise(1))
    engagement = _engagement(F.col("_mean"), F.col("_n"), days)
    return rows.select("user_id", engagement, F.explode(F.sequence(F.lit(1), "_times"))).drop("col")


def reading_engagement_from_lists(
    history: DataFrame, splits: Sequence[str] = TRAIN, span: str = "day_of_year"
) -> DataFrame:
    """The same from list histories, inside the row."""
    times = F.col("impression_time_fixed")
    days = _days_between(F.try_element_at(times, F.lit(1)), F.try_element_at(times, F.lit(-1)), span)
    return of_splits(history, splits).select(
        "user_id", _engagement(list_mean(F.col("read_time_fixed")), F.size(times), days)
    )


def hot_articles(history: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Articles with many entries in a long history.

    They cover the ones with many recent entries, and counting them needs no window.
    """
    return hot_keys(history.select("article_id"), ["article_id"], min_rows)


def _lookup(recent: DataFrame, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    return skew_join(recent, table, ["article_id"], ["user_id", "split", "lag"], "left", hot=hot)


def article_length_propensity(
    recent: DataFrame, articles: DataFrame, splits: Sequence[str] = TRAIN, hot: DataFrame | None = None
) -> DataFrame:
    """1 not interested, 2 short-article reader, 3 skimmer, 4 long-article reader.

    ``recent`` are the entries of ``recent_entries``, so a group holds at most the history size. An
    unknown article has length 0; an article without a body is skipped. ``hot`` may hold the articles
    to split over tasks (``hot_articles``); by default they are counted among the recent entries.
    """
    lengths = article_length(articles).withColumn("_known", F.lit(True))
    entries = _lookup(of_splits(recent, splits), lengths, hot)
    length = F.when(F.col("_known"), F.col("article_length")).when(F.col("pos").isNotNull(), 0)
    medians = entries.groupBy("user_id", "split").agg(
        F.median(length).alias("_length"), F.median("scroll_percentage").alias("_scroll")
    )
    code = two_level(
        F.col("_length") <= ARTICLE_LENGTH_THRESHOLD, F.col("_scroll") <= SCROLL_PERCENTAGE_THRESHOLD
    )
    return medians.select("user_id", code.alias("article_length_propensity"))


def _with_sentiment(
    recent: DataFrame, articles: DataFrame, splits: Sequence[str], hot: DataFrame | None
) -> DataFrame:
    sentiments = articles.select("article_id", "sentiment_label", "sentiment_score")
    return _lookup(of_splits(recent, splits), sentiments, hot)


def sentiment_stats(
    recent: DataFrame,
    articles: DataFrame,
    splits: Sequence[str] = TRAIN_VALIDATION,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Mean score and share of the recent articles per sentiment.

    The mean is over the articles of that sentiment (none: 0); the share is over all entries, with an
    empty history counting as one entry. ``hot`` is as for ``article_length_propensity``.
    """
    label = F.col("sentiment_label")
    total = F.count(F.lit(1))

    def mean(value: str) -> Column:
        # Summed in their order, so that the last digit does not hang on the tasks: one history size of scores per split and user.
        scores = F.array_sort(F.collect_list(F.when(label == value, F.col("sentiment_score"))))
        return F.coalesce(F.try_divide(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x), F.size(scores)), F.lit(0.0))

    means = [mean(value).alias(f"mean_{name}_score") for value, name in SENTIMENTS.items()]
    rates = [
        (F.count_if(label == value) / total).alias(f"{name}_sentiment_articles_rate")
        for value, name in SENTIMENTS.items()
    ]
    return _with_sentiment(recent, articles, splits, hot).groupBy("user_id").agg(*means, *rates)


def sentiment_article_lists(
    recent: DataFrame,
    articles: DataFrame,
    splits: Sequence[str] = TRAIN_VALIDATION,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Recent article ids per sentiment, ascending. At most one history size per split and user."""
    lists = [
        F.array_sort(F.collect_list(F.when(F.col("sentiment_label") == value, F.col("article_id")))).alias(
            f"{name}_article_ids"
        )
        for value, name in SENTIMENTS.items()
    ]
    return _with_sentiment(recent, articles, splits, hot).groupBy("user_id").agg(*lists)


# All user features together


def history_users(history: DataFrame, splits: Sequence[str] = TRAIN_VALIDATION, dedupe: bool = False) -> DataFrame:
    """One row per user and split history; one row per user with ``dedupe``."""
    pairs = of_splits(history, splits).select("user_id", "split").distinct().select("user_id")
    return pairs.distinct() if dedupe else pairs


def user_profile(users: DataFrame, features: Sequence[DataFrame]) -> DataFrame:
    """Inner join of the users with every feature table; a user lacking one is dropped.

    Every feature table has one row per user, so no key is hot here. All are aggregated by user, so
    their shuffles serve the joins as well.
    """
    profile = users
    for table in features:
        profile = profile.join(table, "user_id")
    return profile


def _history_of_cells(cells: DataFrame, span: str) -> DataFrame:
    """``history_profile`` from hour cells that also have ``_entries``, ``_read`` and ``_read_rows``."""
    train = F.col("split") == TRAIN[0]

    def kept(name: str):
        return F.when(train, F.col(name))

    ends = cells.groupBy("user_id").agg(
        F.sum(kept("_entries")).alias("_n"),
        F.timestamp_micros(F.min(kept("_first"))).alias("_first"),
        F.timestamp_micros(F.max(kept("_last"))).alias("_last"),
        F.try_divide(F.sum(kept("_read")), F.sum(kept("_read_rows"))).alias("_mean"),
        F.bool_or(train).alias("_train"),
        F.bool_or(~train).alias("_validation"),
    )
    days = _days_between(F.col("_first"), F.col("_last"), span)
    rows = ends.where("_train").withColumn("_times", F.when(F.col("_validation"), 2).otherwise(1))
    engagement = _engagement(F.col("_mean"), F.col("_n"), days)
    return rows.select("user_id", engagement, F.explode(F.sequence(F.lit(1), "_times"))).drop("col")


def whole_profile(
    history: DataFrame, visits: DataFrame, behaviors: DataFrame, articles: DataFrame, span: str = "day_of_year", min_rows: int = HOT_ROWS
) -> DataFrame:
    """All user features from five reads of the log, whatever of it is hot: the ``user_profile`` of the feature functions.

    ``visits`` and ``behaviors`` may be the same table. Readings are combined per user and hour, which serves sessions and
    engagement; visits per user and device, clicks per user and article, and the recent entries are cut to their number. Each of these
    narrow tables is written to the shared folder once. Hot users and articles are counted on them, not on the log, and the rows
    of hot users, if there are any, are written too, for their medians.
    """
    entries = of_splits(history, TRAIN_VALIDATION)
    read = [F.count("pos").alias("_entries"), F.sum("read_time").alias("_read"), F.count("read_time").alias("_read_rows")]
    cells = cut_lineage(hour_cells(entries, also=read))
    recent = cut_lineage(recent_entries(entries).select("user_id", "split", "lag", "article_id"))
    counts = cut_lineage(_visit_counts(visits, TRAIN_VALIDATION))
    clicks = cut_lineage(_clicks_per_article(_clicks(behaviors, TRAIN)))

    per_user = counts.groupBy("user_id").agg(F.sum("_n").alias("_rows"))
    per_click = clicks.groupBy("article_id").agg(F.sum("_n").alias("_rows"))
    premium = _premium_counts(clicks, articles, hottest(per_click, ["article_id"], min_rows))
    times = of_splits(visits, TRAIN_VALIDATION).select("user_id", "next_read_time")
    medians = grouped_median(times, "user_id", "next_read_time", "median_next_read_time", min_rows, counted=per_user)
    return user_profile(
        _history_of_cells(cells, span),
        [
            sentiment_stats(recent, articles),
            _visits_of_counts(counts),
            time_profile(meaningful(sessions_of_cells(cells))),
            medians,
            _premium_code(premium),
        ],
    )
