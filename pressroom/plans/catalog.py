"""The named queries over the test tables.

Each takes a session and a table folder. Lists are returned as comma-joined text and floating columns
rounded to six digits, so that results compare across engines; the library functions return arrays
and full precision.

Tables that several queries need, the user profile, the ranker's features and the fitted models, are written to the shared
folder by the first of them (``stored``) and read by the others of the same application.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom import schemas
from pressroom.functions import arrays
from pressroom.functions.arrays import dot
from pressroom.functions.scalars import rounded
from pressroom.operators import ranking, sessions
from pressroom.plans import clustering, experiments, features, impressions, mixtures, ranker, scoring, summaries
from pressroom.session import cut_lineage, scratch
from pressroom.sources import derived, runs, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return run


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from folder ``sf``, built once per application and state of the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held, status = system.getContentSummary(path), system.getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf, name, held.getLength(), held.getFileCount(), status.getModificationTime())
    if key not in _STORED:
        _STORED[key] = scratch(spark, name)
        build().write.parquet(_STORED[key])
    return spark.read.parquet(_STORED[key])


def joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


def _recent(spark: SparkSession, sf: str) -> DataFrame:
    return features.recent_entries(derived.history(spark, sf))


def _reading(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _recent(spark, sf), derived.articles(spark, sf)


def _hot_articles(spark: SparkSession, sf: str) -> DataFrame:
    return features.hot_articles(derived.history(spark, sf))


# Articles


@query
def premium_articles(spark, sf):
    return features.premium_articles(derived.articles(spark, sf))


@query
def premium_articles_test(spark, sf):
    return features.premium_articles(derived.articles_test(spark, sf))


@query
def article_length(spark, sf):
    return features.article_length(derived.articles(spark, sf))


@query
def article_features(spark, sf):
    articles = derived.articles(spark, sf)
    table = features.article_features(
        derived.docvec(spark, sf), features.premium_articles(articles), features.article_length(articles)
    )
    vector = F.col("contrastive_vector")
    norm = F.sqrt(dot(vector, vector))
    return table.select(
        "article_id", "premium", "article_length", F.size(vector).alias("n_dims"), norm.alias("vector_norm")
    )


# User features


@query
def favourite_device(spark, sf):
    return features.favourite_device(derived.visits(spark, sf, features.TRAIN_VALIDATION))


@query
def median_next_read_time(spark, sf):
    return features.median_next_read_time(derived.visits(spark, sf, features.TRAIN_VALIDATION))


@query
def subscription_status(spark, sf):
    return features.subscription_status(derived.visits(spark, sf, features.TRAIN_VALIDATION))


@query
def subscription_consistency(spark, sf):
    return features.subscription_consistency(derived.visits(spark, sf, features.TRAIN_VALIDATION))


@query
def premium_clicks(spark, sf):
    return features.premium_clicks(derived.behaviors(spark, sf), derived.articles(spark, sf))


@query
def premium_propensity(spark, sf):
    return features.premium_propensity(derived.behaviors(spark, sf, features.TRAIN), derived.articles(spark, sf))


@query
def reading_engagement(spark, sf):
    return features.reading_engagement(derived.history(spark, sf, features.TRAIN))


@query
def reading_engagement_test(spark, sf):
    return features.reading_engagement(derived.history(spark, sf, ("test",)), ("test",))


@query
def history_union(spark, sf):
    parts = [derived.history(spark, sf, (split,)) for split in features.TRAIN_VALIDATION]
    return parts[0].unionByName(parts[1]).select(
        "user_id",
        "split",
        F.col("pos.event_id").alias("event_id"),
        "article_id",
        F.unix_micros("impression_time").alias("impression_us"),
        "read_time",
        "scroll_percentage",
    )


@query
def history_tail(spark, sf):
    return _recent(spark, sf).select("user_id", "split", "lag", "article_id", "read_time", "scroll_percentage")


@query
def article_length_propensity(spark, sf):
    return features.article_length_propensity(*_reading(spark, sf), hot=_hot_articles(spark, sf))


@query
def sentiment_stats(spark, sf):
    return features.sentiment_stats(*_reading(spark, sf), hot=_hot_articles(spark, sf))


@query
def sentiment_article_lists(spark, sf):
    lists = features.sentiment_article_lists(*_reading(spark, sf), hot=_hot_articles(spark, sf))
    return lists.select("user_id", *[joined(c) for c in lists.columns if c != "user_id"])


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    history = derived.history(spark, sf, features.TRAIN_VALIDATION)
    return sessions.meaningful(sessions.user_sessions(history))


@query
def user_sessions(spark, sf):
    return _sessions(spark, sf)


@query
def session_hour_propensity(spark, sf):
    return sessions.session_hour_propensity(_sessions(spark, sf))


@query
def time_profile(spark, sf):
    return sessions.time_profile(_sessions(spark, sf))


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        history = derived.history(spark, sf, features.TRAIN_VALIDATION)
        visits = derived.visits(spark, sf, features.TRAIN_VALIDATION)
        return features.whole_profile(history, visits, derived.behaviors(spark, sf, features.TRAIN), derived.articles(spark, sf))

    return stored(spark, sf, "profile", build)


@query
def user_profile(spark, sf):
    return _profile(spark, sf)


@query
def list_sessions(spark, sf):
    """Sessions from list histories, put in order by chunks of the lists."""
    lists = derived.list_history(spark, sf, features.TRAIN_VALIDATION)
    return sessions.meaningful(sessions.user_sessions_from_lists(lists))


# Impressions for ranking


@query
def impressions_with_history(spark, sf):
    table = impressions.with_history(derived.behaviors(spark, sf), _recent(spark, sf))
    return table.select(
        "impression_id",
        "user_id",
        "split",
        joined("article_id_fixed"),
        joined("article_ids_inview"),
        joined("article_ids_clicked"),
    )


@query
def sampled_impressions(spark, sf):
    return impressions.sample(derived.visits(spark, sf), 0.3).select("impression_id", "user_id", "split")


@query
def negative_samples(spark, sf):
    table = impressions.negative_samples(derived.behaviors(spark, sf))
    return table.select("impression_id", "clicked_article_id", joined("article_ids_inview"), joined("labels"))


@query
def distinct_negative_samples(spark, sf):
    table = impressions.negative_samples(derived.behaviors(spark, sf), per_click=3, with_replacement=False)
    return table.select("impression_id", "clicked_article_id", joined("article_ids_inview"), joined("labels"))


@query
def binary_labels(spark, sf):
    table = impressions.binary_labels(derived.behaviors(spark, sf))
    return table.select("impression_id", joined("article_ids_inview"), joined("labels"))


@query
def temporal_split(spark, sf):
    return impressions.temporal_split(derived.visits(spark, sf)).select("impression_id", "part")


@query
def padded_lists(spark, sf):
    table = impressions.padded_inview(derived.behaviors(spark, sf))
    return table.select("impression_id", joined("padded_inview"))


@query
def item_features_inview(spark, sf):
    premium = features.premium_articles(derived.articles(spark, sf))
    table = impressions.mapped_inview(derived.behaviors(spark, sf), premium, "premium")
    flags = F.transform("premium", lambda x: x.cast("int"))
    return table.select("impression_id", F.array_join(flags, ",").alias("premium"))


@query
def item_features_lists(spark, sf):
    """Two columns of article features for the history and the in-view list of every impression."""
    articles = derived.articles(spark, sf)
    table = features.premium_articles(articles).join(features.article_length(articles), "article_id")
    rows = impressions.with_history(derived.behaviors(spark, sf), _recent(spark, sf))
    lists = impressions.mapped_lists(rows, ["article_id_fixed", "article_ids_inview"], table, {"premium": 0.0, "article_length": 0.0})

    def whole(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: x.cast("bigint")), ",").alias(name)

    return lists.select("impression_id", *[whole(c) for c in lists.columns[1:]])


@query
def loaded_split(spark, sf):
    """Impressions and list histories written as the split folders of a log, and loaded from there."""
    root = scratch(spark, "log")
    for split in features.TRAIN_VALIDATION:
        kept = derived.behaviors(spark, sf, (split,)).select(*[F.col(f.name).cast(f.dataType) for f in schemas.BEHAVIORS.fields])
        tables.write_table(kept, f"{root}/{split}/behaviors.parquet")
        tables.write_table(derived.list_history(spark, sf, (split,)).drop("split"), f"{root}/{split}/history.parquet")
    table = impressions.load_split(spark, root, features.TRAIN_VALIDATION)
    return table.select("impression_id", "user_id", "split", joined("article_id_fixed"), joined("article_ids_inview"))


@query
def rewritten_split(spark, sf):
    """A table partitioned by split, of which one split is replaced, twice as after a lost job."""
    path = scratch(spark, "impressions")
    visits = derived.visits(spark, sf).select("impression_id", "user_id", "split")
    tables.write_partitions(visits, path, ["split"])
    again = impressions.sample(features.of_splits(visits, ("validation",)), 0.5)
    for _ in range(2):
        tables.write_partitions(again, path, ["split"])
    return spark.read.parquet(path).select("impression_id", "user_id", F.col("split").cast("string").alias("split"))


@query
def training_impressions(spark, sf):
    articles, behaviors, history = (
        derived.articles(spark, sf),
        derived.behaviors(spark, sf),
        derived.history(spark, sf),
    )
    table = impressions.training_impressions(
        features.of_splits(behaviors, features.TRAIN_VALIDATION),
        features.recent_entries(features.of_splits(history, features.TRAIN_VALIDATION)),
        [features.premium_propensity(behaviors, articles), features.reading_engagement(history)],
    )
    return table.select(
        "impression_id",
        "clicked_article_id",
        "user_id",
        "split",
        "part",
        joined("article_id_fixed"),
        joined("article_ids_inview"),
        joined("labels"),
        "premium_propensity",
        "reading_engagement",
    )


@query
def test_impressions(spark, sf):
    history = derived.history(spark, sf)
    table = impressions.test_impressions(
        derived.behaviors(spark, sf),
        features.recent_entries(features.of_splits(history, ("test",))),
        features.reading_engagement(history, ("test",)),
    )
    return table.select(
        "impression_id",
        "user_id",
        joined("article_id_fixed"),
        joined("article_ids_inview"),
        joined("article_ids_clicked"),
        joined("labels"),
        "premium_propensity",
        "reading_engagement",
    )


@query
def evaluation_impressions(spark, sf):
    articles, behaviors, history = (
        derived.articles(spark, sf),
        derived.behaviors(spark, sf),
        derived.history(spark, sf),
    )
    table = impressions.evaluation_impressions(
        behaviors,
        features.recent_entries(features.of_splits(history, ("validation",))),
        [features.premium_propensity(behaviors, articles), features.reading_engagement(history)],
    )
    return table.select(
        "impression_id",
        "user_id",
        joined("article_id_fixed"),
        joined("article_ids_inview"),
        joined("article_ids_clicked"),
        joined("labels"),
        "premium_propensity",
        "reading_engagement",
    )


@query
def vector_lists(spark, sf):
    """The list functions over the vectors: tail, mean, median, differences, pairs."""
    values = F.transform("contrastive_vector", lambda x: x.cast("double"))
    table = derived.docvec(spark, sf).select("article_id", values.alias("v"))
    tail, steps = arrays.list_tail(F.col("v"), 20), arrays.list_diff(F.col("v"))
    pairs = F.transform(F.arrays_zip(F.col("v"), steps.alias("step")), lambda e: e["v"] * e["step"])
    return table.select(
        "article_id",
        F.size(tail).alias("n_tail"),
        arrays.list_mean(tail).alias("tail_mean"),
        arrays.list_median(F.col("v")).alias("median"),
        F.array_max(steps).alias("largest_step"),
        arrays.list_mean(pairs).alias("mean_product"),
    )


# Scores and ranking quality


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    vectors = scoring.vectors_for_join(derived.docvec(spark, sf))
    profile = scoring.time_decay_profile(_recent(spark, sf), vectors)
    return scoring.candidate_scores(derived.behaviors(spark, sf), profile, vectors)


@query
def time_decay_profile(spark, sf):
    vector = F.col("profile")
    total = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)
    profile = scoring.time_decay_profile(_recent(spark, sf), scoring.vectors_for_join(derived.docvec(spark, sf)))
    return profile.select(
        "user_id",
        "split",
        F.size(vector).alias("n_dims"),
        total.alias("total"),
        F.sqrt(dot(vector, vector)).alias("norm"),
        vector[0].alias("first_dim"),
        F.element_at(vector, -1).alias("last_dim"),
    )


@query
def candidate_scores(spark, sf):
    scored = ranking.normalised_scores(_scores(spark, sf))
    return scored.select(
        "impression_id", "pos", "article_id", "label", "score", "probability", "pointwise"
    )


@query
def ranked_predictions(spark, sf):
    return ranking.ranked_predictions(_scores(spark, sf)).select("impression_id", joined("ranked_scores"))


@query
def submission_lines(spark, sf):
    return ranking.submission_lines(ranking.ranked_predictions(_scores(spark, sf)))


@query
def submission_file(spark, sf):
    """The submission as files in the order of the impressions, read back line by line."""
    path = scratch(spark, "submission")
    ranked = ranking.ranked_predictions(_scores(spark, sf))
    lines = cut_lineage(ranking.submission_lines(ranked, keep=("impression_id",)))
    tables.write_ordered_lines(lines, path, ["impression_id"], file_lines=20_000)
    return tables.read_ordered_lines(spark, path)


@query
def ranking_metrics(spark, sf):
    return ranking.ranking_metrics(_scores(spark, sf), ("split",))


@query
def metrics_file(spark, sf):
    """The ranking metrics written as JSON and read back."""
    path = scratch(spark, "metrics")
    metrics = ranking.ranking_metrics(_scores(spark, sf), ("split",))
    tables.write_metrics(metrics, path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in metrics.schema.fields)
    return tables.read_metrics(spark, path, columns)


def _click_tables(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the click features to candidate rows."""
    articles, behaviors, history = (
        derived.articles(spark, sf),
        derived.behaviors(spark, sf),
        derived.history(spark, sf),
    )
    vectors = scoring.vectors_for_join(derived.docvec(spark, sf))
    profile = scoring.time_decay_profile(features.recent_entries(history), vectors)
    premium = features.premium_articles(articles)
    users = features.premium_propensity(behaviors, articles).join(features.reading_engagement(history), "user_id")

    return lambda rows: ranker.click_features(rows, profile, vectors, premium, users)


def _candidates(spark: SparkSession, sf: str, splits: Sequence[str]) -> DataFrame:
    return scoring.candidates(derived.behaviors(spark, sf, splits))


@query
def click_features(spark, sf):
    table = _click_tables(spark, sf)(_candidates(spark, sf, ("validation",)))
    return table.select("impression_id", "pos", "article_id", "label", *ranker.FEATURES)


def _ranker_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the drawn training candidates (``fitted``) and of all candidates of the other splits."""

    def build() -> DataFrame:
        train = derived.behaviors(spark, sf, features.TRAIN)
        drawn = ranker.sampled_candidates(impressions.negative_samples(train))
        asked = _candidates(spark, sf, ("validation", "test")).select(*drawn.columns)
        # Both sets take their features in one pass; fitting then reads its rows once per step. Several draws
        # of one impression share positions, so the sets are told apart by a flag.
        both = drawn.withColumn("fitted", F.lit(True)).unionByName(asked.withColumn("fitted", F.lit(False)))
        return _click_tables(spark, sf)(both)

    return stored(spark, sf, "ranker_rows", build)


def _ranker_model(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        rows = _ranker_rows(spark, sf)
        model = ranker.fit_path(rows.where("fitted"), rows.where("NOT fitted AND split = 'validation'"))
        return model.as_table(spark)

    return stored(spark, sf, "ranker_model", build)


def _fitted_scores(spark: SparkSession, sf: str, splits: Sequence[str]) -> DataFrame:
    """Click probabilities of the candidates of ``splits`` by the ranker fitted on the training split and chosen by validation."""
    model = ranker.PathModel.from_table(_ranker_model(spark, sf))
    return model.transform(_ranker_rows(spark, sf).where(~F.col("fitted") & F.col("split").isin(*splits)))


@query
def click_ranker_path(spark, sf):
    table = _ranker_model(spark, sf)
    return table.select("step", "reg_param", "auc", "chosen")


@query
def click_ranker(spark, sf):
    return ranking.with_rank(_fitted_scores(spark, sf, ("validation", "test")))


@query
def click_ranker_lines(spark, sf):
    return ranking.submission_lines(ranking.ranked_predictions(_fitted_scores(spark, sf, ("test",))))


@query
def click_ranker_metrics(spark, sf):
    return ranking.ranking_metrics(_fitted_scores(spark, sf, ("validation",)), ("split",))


# Experiments


@query
def experiment_results(spark, sf):
    table = runs.results_table(derived.run_documents(spark, sf), schemas.ABLATION_FLAGS)
    units = "newsencoder units per layer"
    return table.withColumn(units, F.array_join(units, ","))


@query
def model_variants(spark, sf):
    flags = [(F.col(flag), part) for flag, part in schemas.ABLATION_FLAGS]
    return derived.runs(spark, sf).select(F.col("run id"), runs.variant_name(flags).alias("used model"))


@query
def preprocessing_variants(spark, sf):
    flags = [(F.col(flag), part) for flag, part in schemas.PREPROCESSING_FLAGS]
    return derived.preprocessing_runs(spark, sf).select(F.col("run id"), runs.variant_name(flags).alias("used model"))


def _sweeps(spark: SparkSession, sf: str) -> str:
    """The folder that the runs were written to as files."""
    root = scratch(spark, "runs")
    runs.write_sweeps(derived.run_texts(spark, sf), root)
    return root


@query
def run_files_report(spark, sf):
    """Runs written as files, some lost or cut short, and what the reader finds of each sweep."""
    return runs.sweep_report(runs.read_sweeps(spark, _sweeps(spark, sf)))


@query
def run_files_results(spark, sf):
    """The result table of the runs whose files are whole."""
    table = runs.results_table(runs.read_runs(spark, _sweeps(spark, sf), sweeps=True), schemas.ABLATION_FLAGS)
    units = "newsencoder units per layer"
    return table.withColumn(units, F.array_join(units, ","))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    flags = [(F.col(flag), part) for flag, part in schemas.ABLATION_FLAGS]
    metrics = [F.col(f"`{m}`") for m in schemas.METRICS]
    return derived.runs(spark, sf).select(
        "run id", "npratio", "epochs", "loss", "history_size", "head_num", "head_dim", "loader", runs.variant_name(flags).alias("used model"), *metrics
    )


@query
def param_correlations(spark, sf):
    parameters = {
        "encoded loss": experiments.encoded("loss", "cross_entropy_loss"),
        "npratio": F.col("npratio"),
        "epochs": F.col("epochs"),
        "history size": F.col("history_size"),
        "head num": F.col("head_num"),
        "head dim": F.col("head_dim"),
        "encoded loader": experiments.encoded("loader", "pretransformed"),
    }
    return experiments.param_correlations(_results(spark, sf), parameters)


@query
def overall_score(spark, sf):
    table = experiments.with_overall_score(_results(spark, sf))
    return table.select("run id", "used model", "overall score").orderBy(F.desc("overall score"))


@query
def winners_per_model(spark, sf):
    winners = experiments.winners_per_model(_results(spark, sf))
    return winners.select("used model", "run id", "loss", "npratio", "overall score")


@query
def best_run(spark, sf):
    return experiments.best_run(_results(spark, sf)).select("run id", "used model", "overall score")


# Clusters


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).withColumn("label", (F.col("user_id") % 3).cast("int"))


@query
def cluster_labels(spark, sf):
    users = features.history_users(derived.history(spark, sf))
    return summaries.cluster_labels(users.withColumn("label", (F.col("user_id") % 3).cast("int")))


@query
def cluster_summary(spark, sf):
    return summaries.cluster_summary(_labelled(spark, sf))


@query
def discriminating_features(spark, sf):
    return summaries.discriminating_features(summaries.cluster_summary(_labelled(spark, sf)))


FEATURES = list(schemas.FEATURE_TYPES)


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.standardised(_profile(spark, sf), FEATURES)


@query
def standardised_users(spark, sf):
    return _scaled(spark, sf)


@query
def feature_covariances(spark, sf):
    return clustering.feature_covariances(_scaled(spark, sf), FEATURES)


def _components(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "components", lambda: clustering.principal_components(_scaled(spark, sf), FEATURES))


@query
def user_pca(spark, sf):
    values = vector_to_array("components")
    return _components(spark, sf).select(
        "user_id", F.size(values).alias("n_components"), F.transform(values, lambda x: F.round(x, 6)).alias("components")
    )


@query
def pca_shares(spark, sf):
    return clustering.fit_components(_scaled(spark, sf), FEATURES).report(spark, clustering.VARIANCE_TO_KEEP)


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The chosen mixture, a row per component, and the grid it was chosen from."""

    def build() -> DataFrame:
        choice = clustering.choose_mixture(_components(spark, sf))
        rows = [(k, restarts, bic, (k, restarts) == (choice.k, choice.restarts)) for k, restarts, bic in choice.grid]
        grid = spark.createDataFrame(rows, "k int, restarts int, bic double, chosen boolean")
        parts = mixtures.as_table(spark, choice.model)
        return parts.unionByName(grid, allowMissingColumns=True).coalesce(1)

    table = stored(spark, sf, "mixture", build)
    return table.where("component IS NOT NULL"), table.where("component IS NULL")


@query
def mixture_grid(spark, sf):
    return _mixture(spark, sf)[1].select("k", "restarts", "bic", "chosen")


def _fitted_labels(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.labelled(_components(spark, sf), mixtures.from_table(_mixture(spark, sf)[0]))


@query
def user_clusters(spark, sf):
    return _fitted_labels(spark, sf)


def _fitted_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile with the fitted label of each user; rows of one user are alike, so they have one label."""
    return stored(spark, sf, "fitted_profile", lambda: _profile(spark, sf).join(_fitted_labels(spark, sf).distinct(), "user_id"))


@query
def fitted_cluster_summary(spark, sf):
    return summaries.cluster_summary(_fitted_profile(spark, sf))


@query
def fitted_discriminating_features(spark, sf):
    return summaries.discriminating_features(summaries.cluster_summary(_fitted_profile(spark, sf)))
