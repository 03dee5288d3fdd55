"""News-log tables derived from the generic test tables, so every query grows with them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom import schemas
from pressroom.session import use_utc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _articles(spark: SparkSession, sf_dir: str) -> Column:
    """How many articles there are, counted from the files' footers rather than once per expression of the plan."""
    return F.lit(max(1, _table(spark, sf_dir, "documents").count())).cast("bigint")


def _article_id(k: Column, articles: Column, step: int = 0) -> Column:
    """An id over all ``articles``, from the event's number k and its id. Four per cent belong to no article."""
    block = F.col("event_id") % F.greatest(F.floor(articles / 100), F.lit(1))
    number = (k + 17 * step + 100 * block) % articles
    return F.when(number % 25 == 24, -1 - number).otherwise(number)


SPLITS = ("train", "validation", "test")


def _log(spark: SparkSession, sf_dir: str, splits: Sequence[str]) -> DataFrame:
    """The events of ``splits``, chosen by ranges of the stored time, so that the filter reaches the scan."""
    starts = [F.to_timestamp_ntz(F.lit(f"{day} 00:00:00")) for day in ("2024-01-22", "2024-01-29")]
    ts = F.col("ts")
    ranges = {"train": ts < starts[0], "validation": (ts >= starts[0]) & (ts < starts[1]), "test": ts >= starts[1]}
    wanted = [ranges[split] for split in SPLITS if split in splits]
    if tuple(splits) == ("train", "validation"):
        wanted = [ts < starts[1]]
    events = _table(spark, sf_dir, "events")
    if set(splits) != set(SPLITS):
        events = events.where(reduce(Column.__or__, wanted))
    return events.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        "props",
        F.when(F.col("ts") < starts[0], "train")
        .when(F.col("ts") < starts[1], "validation")
        .otherwise("test")
        .alias("split"),
    )


def _k() -> Column:
    """The number in ``{"k": <number>}``."""
    return F.substring_index(F.substring_index("props", ": ", -1), "}", 1).cast("bigint")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_labelled"))
    joined = documents.select("doc_id", "text", "n_chars").join(labels, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("article_id"),
        F.col("text").alias("body"),
        ((F.coalesce("quality", F.lit(0)) == 1) & (F.col("doc_id") % 2 == 0)).alias("premium"),
        F.when(F.col("toxic") == 1, "Negative")
        .when(F.col("quality") == 1, "Positive")
        .when(F.col("_labelled"), "Neutral")
        .alias("sentiment_label"),
        ((F.col("n_chars") % 100).cast("double") / 100).alias("sentiment_score"),
    )


def articles_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article table of the test split: all articles, every one of good quality being premium there."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), "quality")
    joined = articles(spark, sf_dir).join(labels, "article_id", "left")
    return joined.withColumn("premium", F.coalesce("quality", F.lit(0)) == 1).drop("quality")


def _visit_columns() -> list[Column]:
    return [
        F.col("event_id").alias("impression_id"),
        F.col("user_id"),
        F.col("ts").alias("impression_time"),
        F.col("split"),
        (F.col("event_id") % 3 + 1).cast("int").alias("device_type"),
        (F.col("user_id") % 4 == 0).alias("is_subscriber"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("next_read_time"),
    ]


def visits(spark: SparkSession, sf_dir: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Impressions without their article lists."""
    return _log(spark, sf_dir, splits).select(*_visit_columns())


def behaviors(spark: SparkSession, sf_dir: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Impressions with the in-view and clicked lists, five articles each in view."""
    # The lists are columns of a real log. Here they are computed, and a filter on them would repeat the
    # computation below it; a one-element explode of k keeps such filters above.
    log = _log(spark, sf_dir, splits).withColumn("k", F.explode(F.array(_k())))
    articles = _articles(spark, sf_dir)
    shown = [_article_id(F.col("k"), articles, i) for i in range(5)]
    none = F.array().cast("array<bigint>")
    return log.select(
        *_visit_columns(),
        F.array(*shown).alias("article_ids_inview"),
        F.when(F.col("event_type").isin("click", "purchase"), F.array(shown[0]))
        .when(F.col("event_type") == "signup", F.array(shown[0], shown[1]))
        .otherwise(none)
        .alias("article_ids_clicked"),
    )


def history(spark: SparkSession, sf_dir: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Long reading history, one row per entry, ordered by instant and event."""
    return _log(spark, sf_dir, splits).select(
        "user_id",
        "split",
        F.struct("ts", "event_id").alias("pos"),
        _article_id(_k(), _articles(spark, sf_dir)).alias("article_id"),
        F.col("ts").alias("impression_time"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("read_time"),
        F.when(F.col("event_id") % 7 != 0, F.least(F.col("value"), F.lit(100.0))).alias("scroll_percentage"),
    )


def list_history(spark: SparkSession, sf_dir: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """The history as the files hold it: one row per user and split, with aligned lists in the order of instant and event."""
    names = {"article_id_fixed": "article_id", "impression_time_fixed": "impression_time", "read_time_fixed": "read_time", "scroll_percentage_fixed": "scroll_percentage"}
    kinds = {f.name: f.dataType for f in schemas.HISTORY.fields}
    rows = history(spark, sf_dir, splits)
    ordered = F.array_sort(F.collect_list(F.struct("pos", *names.values())))
    lists = rows.groupBy("user_id", "split").agg(ordered.alias("_e"))
    user = F.col("user_id").cast(kinds["user_id"]).alias("user_id")
    return lists.select(user, "split", *[F.col(f"_e.{c}").cast(kinds[name]).alias(name) for name, c in names.items()])


def docvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("article_id"), F.col("embedding").alias("contrastive_vector")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat experiment results, one per part."""
    key = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        F.concat(F.lit("run_"), key).alias("run id"),
        (F.col("p_size") % 5 + 1).cast("int").alias("npratio"),
        F.lit(10).alias("epochs"),
        (key % 4 * 5 + 10).cast("int").alias("history_size"),
        (key % 3 * 4 + 12).cast("int").alias("head_num"),
        (key % 5 * 4 + 8).cast("int").alias("head_dim"),
        F.when(key % 7 < 3, "pretransformed").otherwise("lookup").alias("loader"),
        F.when(F.col("p_size") % 2 == 0, "cross_entropy_loss").otherwise("log_loss").alias("loss"),
        (key % 2 == 1).alias("use_pe"),
        (key % 4 >= 2).alias("use_rln"),
        (key % 8 >= 4).alias("use_td"),
        ((key * 31 % 97).cast("double") / 97).alias("auc"),
        ((key * 31 % 89).cast("double") / 89).alias("mrr"),
        ((key * 17 % 83).cast("double") / 83).alias("ndcg@5"),
        ((key * 13 % 79).cast("double") / 79).alias("ndcg@10"),
    )


def preprocessing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the preprocessing study: their ids and feature flags."""
    key = F.col("p_partkey")
    flags = [(F.floor(key / 2**i) % 2 == 1).alias(flag) for i, (flag, _) in enumerate(schemas.PREPROCESSING_FLAGS)]
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("run_"), key).alias("run id"), *flags)


def run_documents(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    """The same runs as the JSON documents a run folder holds, parsed with the declared schemas; made by ``tasks`` tasks if given."""
    flat = runs(spark, sf_dir)
    if tasks:
        flat = flat.repartition(tasks)
    constants = {
        "DEBUG": False,
        "DATASPLIT": "small",
        "DATA_PATH": "data",
        "DOCUMENT_EMBEDDINGS": "vectors.parquet",
        "BS_TRAIN": 128,
        "BS_TEST": 128,
        "BATCH_SIZE_TEST_WO_B": 128,
        "BATCH_SIZE_TEST_W_B": 8,
        "FRACTION_TEST": 1.0,
        "N_CHUNKS_TEST": 10,
        "CHUNKS_DONE": 0,
        "TRAIN_FRACTION": 1,
        "ATTENTION_HIDDEN_DIM": 200,
        "TITLE_SIZE": 768,
        "LEARNING_RATE": 0.0001,
        "NEWSENCODER_L2_REGULARIZATION": 0.0001,
        "OPTIMIZER": "adam",
        "DROPOUT": 0.2,
        "SEED": 123,
    }
    fields = [F.lit(v).alias(k) for k, v in constants.items()] + [
        F.array(F.lit(512), F.lit(512), F.lit(512)).alias("NEWSENCODER_UNITS_PER_LAYER"),
        F.col("loss").alias("LOSS"),
        F.col("epochs"),
        F.col("npratio"),
        F.col("history_size"),
        F.col("head_num"),
        F.col("head_dim"),
        F.col("loader").alias("nrms_loader"),
        *[F.col(flag) for flag, _ in schemas.ABLATION_FLAGS],
    ]
    config_text = F.to_json(F.struct(F.col("run id").alias("run_id"), F.struct(*fields).alias("parameters")))
    metrics_text = F.to_json(F.struct(*[F.col(f"`{m}`").alias(m) for m in schemas.METRICS]))
    return flat.select(
        F.col("run id").alias("folder"),
        F.from_json(config_text, schemas.config_schema()).alias("config"),
        F.from_json(metrics_text, schemas.metrics_schema()).alias("metrics"),
        config_text.alias("config_text"),
        metrics_text.alias("metrics_text"),
    )


def run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sweep, run_id, config, metrics): the documents of the runs as text, a hundred runs a sweep, with some lost or cut short."""
    key = F.substring_index("folder", "_", -1).cast("bigint")
    # The texts are far larger than the rows they are made of, which one task would read.
    texts = run_documents(spark, sf_dir, spark.sparkContext.defaultParallelism).select(key.alias("key"), F.col("folder").alias("run_id"), F.col("config_text").alias("config"), F.col("metrics_text").alias("metrics"))

    def amiss(name: str, lost: int, short: int) -> Column:
        whole = F.col(name)
        cut = F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int"))
        return F.when(F.col("key") % 50 == lost, None).when(F.col("key") % 50 == short, cut).otherwise(whole).alias(name)

    return texts.select(F.floor(F.col("key") / 100).alias("sweep"), "run_id", amiss("config", 3, 7), amiss("metrics", 13, 21))
