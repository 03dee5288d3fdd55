"""Declared schemas of the input tables and of the two typed result tables."""

from __future__ import annotations

from pyspark.sql import types as T

ARTICLES = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("premium", T.BooleanType()),
        T.StructField("sentiment_label", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
    ]
)

BEHAVIORS = T.StructType(
    [
        T.StructField("impression_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("impression_time", T.TimestampType()),
        T.StructField("device_type", T.IntegerType()),
        T.StructField("is_subscriber", T.BooleanType()),
        T.StructField("next_read_time", T.DoubleType()),
        T.StructField("article_ids_inview", T.ArrayType(T.LongType())),
        T.StructField("article_ids_clicked", T.ArrayType(T.LongType())),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("article_id_fixed", T.ArrayType(T.LongType())),
        T.StructField("impression_time_fixed", T.ArrayType(T.TimestampType())),
        T.StructField("read_time_fixed", T.ArrayType(T.DoubleType())),
        T.StructField("scroll_percentage_fixed", T.ArrayType(T.DoubleType())),
    ]
)

DOCVEC = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("contrastive_vector", T.ArrayType(T.FloatType())),
    ]
)

# Result column, key in the run's configuration file, type.
RUN_PARAMETERS = [
    ("debug", "DEBUG", "boolean"),
    ("datasplit", "DATASPLIT", "string"),
    ("data path", "DATA_PATH", "string"),
    ("document embeddings", "DOCUMENT_EMBEDDINGS", "string"),
    ("bs train", "BS_TRAIN", "smallint"),
    ("bs test", "BS_TEST", "smallint"),
    ("batch size test wo b", "BATCH_SIZE_TEST_WO_B", "smallint"),
    ("batch size test w b", "BATCH_SIZE_TEST_W_B", "tinyint"),
    ("fraction test", "FRACTION_TEST", "double"),
    ("n chunks test", "N_CHUNKS_TEST", "smallint"),
    ("chunks done", "CHUNKS_DONE", "smallint"),
    ("train fraction", "TRAIN_FRACTION", "smallint"),
    ("attention hidden dimension", "ATTENTION_HIDDEN_DIM", "smallint"),
    ("title size", "TITLE_SIZE", "smallint"),
    ("learning rate", "LEARNING_RATE", "double"),
    ("newsencoder l2 regularization", "NEWSENCODER_L2_REGULARIZATION", "double"),
    ("newsencoder units per layer", "NEWSENCODER_UNITS_PER_LAYER", "array<int>"),
    ("optimizer", "OPTIMIZER", "string"),
    ("loss", "LOSS", "string"),
    ("dropout", "DROPOUT", "double"),
    ("seed", "SEED", "tinyint"),
    ("epochs", "epochs", "tinyint"),
    ("history size", "history_size", "tinyint"),
    ("npratio", "npratio", "tinyint"),
    ("head num", "head_num", "tinyint"),
    ("head dim", "head_dim", "tinyint"),
    ("nrms loader", "nrms_loader", "string"),
]

# Flags of a run's configuration and the part each adds to the variant name, in name order.
ABLATION_FLAGS = [("use_pe", "PE"), ("use_rln", "RLN"), ("use_td", "TD")]
PREPROCESSING_FLAGS = [
    ("use_premium_propensity", "PP"),
    ("use_reading_engagement", "RE"),
    ("use_article_length_propensity", "ALP"),
]
PLAIN_VARIANT = "Baseline"

# Metric names in a run's metrics file.
METRICS = ["auc", "mrr", "ndcg@5", "ndcg@10"]


def config_schema() -> T.StructType:
    """Schema of a run's configuration file. Numbers are read wide and narrowed when the table is built."""
    wide = {"tinyint": "bigint", "smallint": "bigint"}
    fields = ", ".join(f"`{key}` {wide.get(kind, kind)}" for _, key, kind in RUN_PARAMETERS)
    flags = ", ".join(f"`{flag}` boolean" for flag, _ in ABLATION_FLAGS + PREPROCESSING_FLAGS)
    return T.StructType.fromDDL(f"run_id string, parameters struct<{fields}, {flags}>".replace("` ", "`: "))


def metrics_schema() -> T.StructType:
    return T.StructType([T.StructField(name, T.DoubleType()) for name in METRICS])


# The profiled user features and how each is summarised.
FEATURE_TYPES = {
    "mean_positive_score": "numerical",
    "mean_neutral_score": "numerical",
    "mean_negative_score": "numerical",
    "positive_sentiment_articles_rate": "numerical",
    "neutral_sentiment_articles_rate": "numerical",
    "negative_sentiment_articles_rate": "numerical",
    "favourite_device": "categorical",
    **{str(hour): "numerical" for hour in range(24)},
    "median_next_read_time": "numerical",
    "premium_propensity": "categorical",
    "reading_engagement": "categorical",
    "is_subscriber": "binary",
}

# Columns of a feature summary.
SUMMARY = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("feature_type", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("q25", T.DoubleType()),
        T.StructField("q75", T.DoubleType()),
        T.StructField("skewness_index", T.DoubleType()),
        T.StructField("kurtosis_index", T.DoubleType()),
        T.StructField("mode", T.DoubleType()),
        T.StructField("mode_rate", T.DoubleType()),
        T.StructField("n_unique", T.ShortType()),
        T.StructField("normalized_gini_index", T.DoubleType()),
        T.StructField("normalized_entropy_index", T.DoubleType()),
    ]
)
