from __future__ import annotations

import math
import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import plan_of, tuples
from pyspark.sql import functions as F
from test_features import DAY, behaviors, history

from pressroom.plans import features, ranker, scoring
from pressroom.session import cut_lineage
from pressroom.sources.tables import long_history

DIMS = 5


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(9)
    vectors = {a: [rng.uniform(-1, 1) for _ in range(DIMS)] for a in range(30)}
    docvec = spark.createDataFrame(list(vectors.items()), "article_id bigint, contrastive_vector array<float>")
    reading = {u: [rng.randrange(35) for _ in range(rng.choice([1, 4, 30]))] for u in range(1, 8)}
    reading[8] = [31, 33]  # unknown articles only
    lists = history(
        spark,
        *[(u, "train", ids, [DAY + timedelta(minutes=i) for i in range(len(ids))], None, None) for u, ids in reading.items()],
    )
    rows = []
    for i in range(90):
        shown = rng.sample(range(33), 4)
        user = 1 if i % 3 == 0 else rng.randrange(1, 9)
        rows.append({"user_id": user, "article_ids_inview": shown, "article_ids_clicked": shown[:1]})
    return vectors, docvec, reading, features.recent_entries(long_history(lists)), behaviors(spark, rows), rows


def profile_of(vectors, ids):
    recent = ids[-20:]
    known = [(np.exp(-0.05 * lag), np.float32(vectors[a])) for lag, a in enumerate(reversed(recent)) if a in vectors]
    return sum(w * v.astype(float) for w, v in known) / sum(w for w, _ in known) if known else None


def test_profile_is_the_weighted_mean(data):
    vectors, docvec, reading, recent, _, _ = data
    got = {r["user_id"]: r["profile"] for r in scoring.time_decay_profile(recent, docvec).collect()}
    assert 8 not in got
    for user, ids in reading.items():
        expected = profile_of(vectors, ids)
        if expected is not None:
            assert got[user] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("min_rows", [0, 10**6])
def test_scores_match_brute_force(data, min_rows):
    vectors, docvec, reading, recent, log, rows = data
    scored = scoring.candidate_scores(log, scoring.time_decay_profile(recent, docvec), docvec, min_rows)
    got = {(r["impression_id"], r["pos"]): r for r in scored.collect()}
    assert len(got) == 360
    for i, row in enumerate(rows):
        profile = profile_of(vectors, reading[row["user_id"]])
        for pos, article in enumerate(row["article_ids_inview"]):
            known = profile is not None and article in vectors
            expected = float(np.dot(profile, np.float32(vectors[article]).astype(float))) if known else 0.0
            assert got[i, pos]["score"] == pytest.approx(expected, abs=1e-9)
            assert got[i, pos]["label"] == int(pos == 0)
            assert got[i, pos]["article_id"] == article


def test_vectors_are_broadcast_only_below_the_limit(spark, data):
    _, docvec, _, recent, log, _ = data
    narrow = scoring.vectors_for_join(docvec)
    assert narrow.broadcast and "SortMergeJoin" not in plan_of(scoring.time_decay_profile(recent, narrow))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = scoring.vectors_for_join(docvec, limit=100)
        profile = scoring.time_decay_profile(recent, wide)
        assert not wide.broadcast and "SortMergeJoin" in plan_of(profile)
        shuffled = tuples(scoring.candidate_scores(log, profile, wide).withColumn("s", F.round("score", 9)), "impression_id", "pos", "s")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    profile = scoring.time_decay_profile(recent, docvec)
    scores = scoring.candidate_scores(log, profile, docvec).withColumn("s", F.round("score", 9))
    assert tuples(scores, "impression_id", "pos", "s") == shuffled


def test_ranker_finds_a_planted_signal(spark):
    rng = np.random.default_rng(10)
    n = 3000
    match, premium = rng.normal(size=n), rng.integers(0, 2, n)
    propensity, engagement = rng.integers(1, 4, n), rng.integers(1, 5, n)
    logit = 1.5 * match - 0.8 * premium + 0.3 * propensity - 0.5
    label = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    rows = [
        (int(i), "train", 0, int(label[i]), float(match[i]), float(premium[i]), int(propensity[i]), int(engagement[i]))
        for i in range(n)
    ]
    table = spark.createDataFrame(
        rows,
        "impression_id bigint, split string, pos int, label int, match double, premium double, "
        "premium_propensity int, reading_engagement int",
    )
    model = ranker.ClickRanker(max_iter=50).fit(table)
    coefficients = model.model.stages[-1].coefficients.toArray()

    # Newton's method on the same rows.
    x = np.column_stack([match, premium, propensity, engagement, np.ones(n)])
    beta = np.zeros(5)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (label - p))
    assert coefficients == pytest.approx(beta[:4], abs=1e-2)

    scores = {r["impression_id"]: r["score"] for r in model.transform(table).collect()}
    order = np.argsort([scores[i] for i in range(n)])
    ranks = np.empty(n)
    ranks[order] = np.arange(1, n + 1)
    positives = label.sum()
    auc = (ranks[label == 1].sum() - positives * (positives + 1) / 2) / (positives * (n - positives))
    assert auc > 0.7


def test_click_features(spark, data):
    _, docvec, _, recent, log, _ = data
    premium = spark.createDataFrame([(a, float(a % 2)) for a in range(20)], "article_id bigint, premium float")
    users = spark.createDataFrame([(1, 2, 3), (2, 1, 1)], "user_id bigint, premium_propensity int, reading_engagement int")
    profile = scoring.time_decay_profile(recent, docvec)
    rows = ranker.click_features(scoring.candidates(log), profile, docvec, premium, users)
    expected = scoring.candidate_scores(log, profile, docvec).where("user_id in (1, 2)")
    assert tuples(rows.withColumn("m", F.round("match", 9)), "impression_id", "pos", "m") == tuples(
        expected.withColumn("m", F.round("score", 9)), "impression_id", "pos", "m"
    )
    for row in rows.collect():
        assert row["premium"] == (row["article_id"] % 2 if row["article_id"] < 20 else 0)


def plain_newton(x, y, beta, reg_param):
    penalty = np.append(np.full(x.shape[1] - 1, reg_param), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(penalty), x.T @ (p - y) / len(x) + penalty * beta)
    return beta


def test_path_is_the_one_of_a_plain_search(spark):
    """Every state, its AUC, where the path ends and which state is kept equal a search with matrices."""
    rng = np.random.default_rng(4)
    train, check = rng.normal(size=(60, 4)), rng.normal(size=(600, 4))  # few rows, so that weak penalties overfit
    planted = np.array([1.0, 0.0, 0.0, 0.0])
    y = (rng.random(60) < 1 / (1 + np.exp(-train @ planted))).astype(int)
    z = (rng.random(600) < 1 / (1 + np.exp(-check @ planted))).astype(int)

    def frame(x, labels):
        rows = [(i // 6, "validation", i % 6, int(l), *map(float, v)) for i, (v, l) in enumerate(zip(x, labels))]
        return spark.createDataFrame(rows, "impression_id bigint, split string, pos int, label int, " + ", ".join(f"{f} double" for f in ranker.FEATURES))

    found = ranker.fit_path(frame(train, y), frame(check, z), patience=2)

    def auc(scores):
        each = []
        for i in range(100):
            s, label = scores[6 * i : 6 * i + 6], z[6 * i : 6 * i + 6]
            up, down = s[label == 1], s[label == 0]
            if len(up) and len(down):
                each.append(((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / (len(up) * len(down)))
        return np.mean(each)

    mean, std = train.mean(0), train.std(0)
    x = np.column_stack([(train - mean) / std, np.ones(60)])
    beta, told, best = np.zeros(5), [], 0
    for reg_param in ranker.REG_PATH:
        beta = plain_newton(x, y, beta, reg_param)
        told.append((reg_param, auc(check @ (beta[:4] / std)), beta[:4] / std))
        best = len(told) - 1 if told[-1][1] > told[best][1] else best
        if len(told) - 1 - best >= 2:
            break
    assert [s.reg_param for s in found.settings] == [r for r, _, _ in told] and found.best == best
    assert len(told) < len(ranker.REG_PATH)
    for s, (_, area, slopes) in zip(found.settings, told):
        assert s.auc == pytest.approx(area, abs=1e-12) and s.weights[:4] == pytest.approx(slopes, abs=1e-6)
    scored = {(r["impression_id"], r["pos"]): r["score"] for r in found.transform(frame(check, z)).collect()}
    kept = found.settings[best].weights
    assert scored[3, 2] == pytest.approx(1 / (1 + math.exp(-(check[20] @ np.array(kept[:4]) + kept[4]))))
    back = ranker.PathModel.from_table(cut_lineage(found.as_table(spark)))
    assert back == found


def test_path_bears_constant_features_and_separable_rows(spark):
    rows = [(i, "train", 0, int(i > 5), float(i), 1.0, 0.0, None if i == 3 else 2.0) for i in range(12)]
    table = spark.createDataFrame(rows, "impression_id bigint, split string, pos int, label int, " + ", ".join(f"{f} double" for f in ranker.FEATURES))
    one = table.withColumn("impression_id", F.lit(1).cast("bigint"))
    found = ranker.fit_path(table, one, reg_params=(1.0, 0.0), max_passes=8)
    assert [s.auc for s in found.settings] == [1.0, 1.0] and found.best == 0
    assert found.settings[0].weights[1:4] == (0.0, 0.0, 0.0) and found.settings[0].weights[0] > 0
    with pytest.raises(ValueError):
        ranker.fit_path(table.limit(0), one)


def test_rounding_of_the_loss_costs_no_passes(spark, monkeypatch):
    """The sum over many rows comes in another order each time; a loss that differs by that does not halve the step for ever."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = (rng.random(400) < 1 / (1 + np.exp(-x @ np.array([1.0, 0.5, 0.0, -0.5])))).astype(int)
    rows = [(i // 5, "validation", i % 5, int(l), *map(float, v)) for i, (v, l) in enumerate(zip(x, y))]
    table = spark.createDataFrame(rows, "impression_id bigint, split string, pos int, label int, " + ", ".join(f"{f} double" for f in ranker.FEATURES))
    calm = ranker.fit_path(table, table, reg_params=(1.0, 0.1, 0.0))
    plain, calls = ranker.newton_sums, []

    def rough(*a):
        loss, gradient, second = plain(*a)
        calls.append(1)
        return loss * (1 + len(calls) * 3e-12), gradient, second  # each sum a little above the one before

    monkeypatch.setattr(ranker, "newton_sums", rough)
    found = ranker.fit_path(table, table, reg_params=(1.0, 0.1, 0.0))
    assert [s.passes for s in found.settings] == [s.passes for s in calm.settings] and max(s.passes for s in found.settings) < 8
    for s, t in zip(found.settings, calm.settings):
        assert s.weights == pytest.approx(t.weights, abs=1e-9)
