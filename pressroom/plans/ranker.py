"""A click ranker fitted on sampled candidates: logistic regression over the score and side features.

``ClickRanker.fit(rows)`` minimises the loss of the given rows. ``fit_path(rows, validation)`` lets the validation
impressions decide: a path from strong to weak regularisation, each setting started from the one before, ends when the
mean AUC of the validation impressions has not risen for some settings, and the best state is kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions.scalars import sigmoid
from pressroom.operators.skew import HOT_ROWS, hot_keys, skew_join
from pressroom.plans.scoring import Vectors, join_per_pair, pair_scores
from pressroom.session import cut_lineage

FEATURES = ["match", "premium", "premium_propensity", "reading_engagement"]


def click_features(
    rows: DataFrame,
    profile: DataFrame,
    docvec: DataFrame | Vectors,
    premium: DataFrame,
    user_features: DataFrame,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Candidate rows with the feature columns; unknown articles count as free, users without features drop out."""

    def attach(pairs: DataFrame) -> DataFrame:
        hot = hot_keys(pairs.select("article_id"), ["article_id"], min_rows)
        scored = pair_scores(pairs.join(user_features, "user_id"), profile, docvec, min_rows)
        scored = scored.withColumnRenamed("score", "match")
        flagged = skew_join(scored, premium, ["article_id"], ["user_id", "split"], "left", min_rows, hot)
        return flagged.withColumn("premium", F.coalesce(F.col("premium").cast("double"), F.lit(0.0)))

    return join_per_pair(rows, attach, min_rows)


def sampled_candidates(samples: DataFrame) -> DataFrame:
    """Long form of negative samples: one row per candidate with its label."""
    zipped = F.arrays_zip("article_ids_inview", "labels")
    rows = samples.select("impression_id", "user_id", "split", F.posexplode(zipped).alias("pos", "_c"))
    return rows.select(
        "impression_id",
        "user_id",
        "split",
        "pos",
        F.col("_c.article_ids_inview").alias("article_id"),
        F.col("_c.labels").alias("label"),
    )


@dataclass
class ClickRankerModel:
    model: PipelineModel

    def transform(self, rows: DataFrame) -> DataFrame:
        """``impression_id, split, pos, label, score`` with the click probability as score."""
        scored = self.model.transform(rows)
        return scored.select(
            "impression_id",
            "split",
            "pos",
            "label",
            vector_to_array("click_probability")[1].alias("score"),
        )


@dataclass
class ClickRanker:
    max_iter: int = 20
    reg_param: float = 0.0

    def fit(self, rows: DataFrame) -> ClickRankerModel:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="click_features")
        regression = LogisticRegression(
            featuresCol="click_features",
            labelCol="label",
            probabilityCol="click_probability",
            maxIter=self.max_iter,
            regParam=self.reg_param,
        )
        return ClickRankerModel(Pipeline(stages=[assembler, regression]).fit(rows))


# Fit with validation

#: From strong to weak; each is started from the result of the one before.
REG_PATH = (10.0, 3.0, 1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001, 0.0)
PATIENCE = 4


@dataclass(frozen=True)
class Setting:
    """A state of the path: weights of the features and the intercept, and the mean AUC of the validation impressions."""

    reg_param: float
    weights: tuple[float, ...]
    auc: float
    passes: int


@dataclass(frozen=True)
class PathModel:
    """The states in the order they were tried, and which one is kept."""

    settings: tuple[Setting, ...]
    best: int
    features: tuple[str, ...] = tuple(FEATURES)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``impression_id, split, pos, label, score`` with the click probability as score."""
        score = sigmoid(linear(self.settings[self.best].weights, [F.col(f).cast("double") for f in self.features]))
        return rows.select("impression_id", "split", "pos", "label", score.alias("score"))

    def as_table(self, spark: SparkSession) -> DataFrame:
        """One row per state: ``step, reg_param, auc, passes, chosen, weights``, and the features' names."""
        rows = [(i, s.reg_param, s.auc, s.passes, i == self.best, list(s.weights), list(self.features)) for i, s in enumerate(self.settings)]
        return spark.createDataFrame(
            rows, "step int, reg_param double, auc double, passes int, chosen boolean, weights array<double>, features array<string>"
        )

    @staticmethod
    def from_table(table: DataFrame) -> PathModel:
        rows = table.orderBy("step").collect()
        settings = tuple(Setting(r["reg_param"], tuple(r["weights"]), r["auc"], r["passes"]) for r in rows)
        return PathModel(settings, [r["chosen"] for r in rows].index(True), tuple(rows[0]["features"]))


def linear(weights: Sequence[float], values: Sequence[Column]) -> Column:
    """The intercept, which is the last weight, plus the weighted values."""
    return sum((v * float(w) for v, w in zip(values, weights)), F.lit(float(weights[-1])))


def newton_sums(rows: DataFrame, weights: np.ndarray, values: Sequence[Column]) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and second derivatives summed over the rows: one aggregation, combined in the tasks."""
    z = linear(weights, [F.col(f"x{i}") for i in range(len(values))])
    inputs = rows.select(F.col("label").cast("double").alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(values)])
    made = inputs.withColumn("z", z).withColumn("p", sigmoid(F.col("z")))
    xs = [*[F.col(f"x{i}") for i in range(len(values))], F.lit(1.0)]
    n = len(xs)
    loss = F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))
    curve = F.col("p") * (1 - F.col("p"))
    sums = [F.sum(loss)] + [F.sum((F.col("p") - F.col("y")) * x) for x in xs]
    sums += [F.sum(curve * xs[i] * xs[j]) for i in range(n) for j in range(i, n)]
    found = np.array([v or 0.0 for v in made.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()], dtype=np.float64)
    second = np.zeros((n, n))
    second[np.triu_indices(n)] = found[1 + n :]
    return float(found[0]), found[1 : 1 + n], second + np.triu(second, 1).T


#: Share of the loss by which its sum over many rows may be off: rounding grows with the rows, and the order of the tasks changes it.
LOSS_NOISE = 1e-9


def newton(
    rows: DataFrame, n: int, start: np.ndarray, reg_param: float, values: Sequence[Column], max_passes: int, tolerance: float = 1e-7
) -> tuple[np.ndarray, int]:
    """Weights of the smallest mean loss plus half ``reg_param`` times the squared weights, without the intercept's.

    A rise of the loss within its rounding does not count as too far a step. Near the smallest loss all steps look alike, and
    halving them there would take every pass that is allowed, the more surely the more rows there are.
    """
    penalty = np.append(np.full(len(start) - 1, reg_param), 0.0)
    here, before, least = start, start, math.inf
    for turn in range(1, max_passes + 1):
        loss, gradient, second = newton_sums(rows, here, values)
        total = loss / n + 0.5 * float((penalty * here * here).sum())
        if total > least + LOSS_NOISE * abs(least) + 1e-12:
            here = (here + before) / 2  # too far: half the step
            continue
        step = np.linalg.lstsq(second / n + np.diag(penalty), gradient / n + penalty * here, rcond=1e-12)[0]
        before, least, here = here, total, here - step
        if np.abs(step).max() < tolerance:
            break
    return here, turn


def validation_lists(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per impression that has both classes: its clicked and its other candidates, as arrays of feature values.

    Written once; every validation is then a scan without a shuffle. A row holds one in-view list.
    """
    candidate = F.struct("label", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    lists = rows.dropna(subset=list(features)).groupBy("impression_id", "split").agg(F.collect_list(candidate).alias("_all"))

    def of(label: int, name: str) -> Column:
        return F.transform(F.filter("_all", lambda c: c["label"] == label), lambda c: c["x"]).alias(name)

    return cut_lineage(lists.select(of(1, "clicked"), of(0, "others")).where((F.size("clicked") > 0) & (F.size("others") > 0)))


def mean_auc(lists: DataFrame, weights: Sequence[float]) -> float:
    """Mean AUC of the impressions of ``validation_lists``; NaN without any."""
    factors = F.array(*[F.lit(float(w)) for w in weights[:-1]])

    def scores(name: str) -> Column:
        return F.transform(name, lambda x: F.aggregate(F.zip_with(x, factors, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))

    scored = lists.select(scores("clicked").alias("up"), scores("others").alias("down"))

    def won(a: Column, b: Column) -> Column:
        return F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)

    pairs = F.aggregate("up", F.lit(0.0), lambda s, a: s + F.aggregate("down", F.lit(0.0), lambda t, b: t + won(a, b)))
    found = scored.agg(F.avg(pairs / (F.size("up") * F.size("down")))).first()[0]
    return math.nan if found is None else found


def fit_path(
    rows: DataFrame,
    validation: DataFrame,
    features: Sequence[str] = tuple(FEATURES),
    reg_params: Sequence[float] = REG_PATH,
    patience: int = PATIENCE,
    max_passes: int = 25,
) -> PathModel:
    """Fit on ``rows`` (features and label) and choose by ``validation`` (the same, with impression_id and split).

    The path ends when ``patience`` settings in a row have not raised the best mean AUC. Of equal ones the earlier, more
    regularised state stays. Features are scaled by their deviation for the penalty; a constant feature has weight 0. Rows with a
    null feature are left out of the fit and of the validation. What is fitted is written once, as it is read once per Newton step.
    """
    features = list(features)
    known = cut_lineage(rows.select("label", *[F.col(f).cast("double").alias(f) for f in features]).dropna())
    moments = known.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]
    ).first()
    if not moments["n"]:
        raise ValueError("no rows to fit")
    means = np.array([moments[f"m_{f}"] for f in features])
    scales = np.array([moments[f"s_{f}"] for f in features])
    live = scales > 0
    values = [(F.col(f) - float(m)) / float(s) if s > 0 else F.lit(0.0) for f, m, s in zip(features, means, scales)]
    lists = validation_lists(validation, features)
    state, settings, best = np.zeros(len(features) + 1), [], 0
    for reg_param in reg_params:
        state, passes = newton(known, moments["n"], state, reg_param, values, max_passes)
        slopes = np.where(live, state[:-1] / np.where(live, scales, 1.0), 0.0)
        weights = (*slopes.tolist(), float(state[-1] - (slopes * means).sum()))
        settings.append(Setting(float(reg_param), weights, mean_auc(lists, weights), passes))
        if settings[-1].auc > settings[best].auc:
            best = len(settings) - 1
        if len(settings) - 1 - best >= patience:
            break
    return PathModel(tuple(settings), best, tuple(features))
