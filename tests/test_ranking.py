from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import tuples

from pressroom.operators import ranking

SCHEMA = "impression_id bigint, pos int, score double, label tinyint"


def frame(spark, lists):
    rows = [(i, p, float(s), l) for i, pairs in lists.items() for p, (s, l) in enumerate(pairs)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def brute_force(pairs):
    order = sorted(range(len(pairs)), key=lambda p: (-pairs[p][0], p))
    labels = [pairs[p][1] for p in order]
    positives = [s for s, l in pairs if l]
    negatives = [s for s, l in pairs if not l]
    wins = [1.0 if p > n else 0.5 if p == n else 0.0 for p in positives for n in negatives]
    auc = sum(wins) / len(wins) if wins else None
    if not positives:
        return auc, None, None, None
    mrr = sum(l / (i + 1) for i, l in enumerate(labels)) / len(positives)

    def ndcg(k):
        gain = sum(l / math.log2(i + 2) for i, l in enumerate(labels[:k]))
        return gain / sum(l / math.log2(i + 2) for i, l in enumerate(sorted(labels, reverse=True)[:k]))

    return auc, mrr, ndcg(5), ndcg(10)


EDGES = {
    1: [(0.5, 1), (0.5, 0), (0.5, 0)],  # all tied
    2: [(0.1, 0), (0.2, 0)],  # no click
    3: [(0.1, 1), (0.2, 1)],  # all clicked
    4: [(0.3, 1)],  # one candidate
    5: [(0.3, 0)],
    6: [(3.0, 0), (2.0, 0), (2.0, 1), (1.0, 1)],
}


def check(spark, lists):
    got = {r["impression_id"]: tuple(r)[1:] for r in ranking.impression_metrics(frame(spark, lists)).collect()}
    assert set(got) == set(lists)
    for i, pairs in lists.items():
        assert got[i] == tuple(v if v is None else pytest.approx(v, abs=1e-12) for v in brute_force(pairs)), (i, pairs)
    (total,) = ranking.ranking_metrics(frame(spark, lists)).collect()
    expected = [brute_force(p) for p in lists.values()]
    for name, column in zip(("auc", "mrr", "ndcg@5", "ndcg@10"), range(4)):
        assert total[name] == pytest.approx(np.mean([e[column] for e in expected if e[column] is not None]))
        assert 0 <= total[name] <= 1
    assert total["n_impressions"] == len(lists)
    assert total["n_skipped"] == sum(e[0] is None for e in expected)


def test_metrics_of_edge_cases(spark):
    check(spark, EDGES)


def test_metrics_of_random_lists(spark):
    rng = random.Random(8)
    check(
        spark,
        {i: [(rng.choice([0.1, 0.2, 0.2, rng.random()]), rng.randrange(2)) for _ in range(rng.randint(1, 14))] for i in range(80)},
    )


def test_ranks_are_a_permutation_with_earlier_positions_first(spark):
    ranked = {r["impression_id"]: r["ranked_scores"] for r in ranking.ranked_predictions(frame(spark, EDGES)).collect()}
    assert ranked == {1: [1, 2, 3], 2: [2, 1], 3: [2, 1], 4: [1], 5: [1], 6: [1, 2, 3, 4]}


def test_submission_lines_and_score_lists(spark):
    table = frame(spark, {7: [(0.1, 0), (0.9, 1), (0.5, 0)]})
    assert tuples(ranking.submission_lines(ranking.ranked_predictions(table))) == [("7 [3,1,2]",)]
    assert ranking.score_lists(table).first()["scores"] == [0.1, 0.9, 0.5]


def test_normalised_scores(spark):
    rows = ranking.normalised_scores(frame(spark, {1: [(1000.0, 0), (999.0, 0)], 2: [(0.0, 0)]})).collect()
    got = {(r["impression_id"], r["pos"]): (r["probability"], r["pointwise"]) for r in rows}
    assert got[1, 0][0] == pytest.approx(1 / (1 + math.exp(-1)))
    assert got[1, 0][0] + got[1, 1][0] == pytest.approx(1)
    assert got[2, 0] == (1.0, 0.5)


def test_all_windows_share_one_shuffle(spark):
    from conftest import plan_of

    table = frame(spark, EDGES)
    assert plan_of(ranking.impression_metrics(table)).count("Exchange\n") == 1
