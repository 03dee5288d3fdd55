"""The plans for hot keys on the given tables: a threshold of 20 rows makes many users and articles hot."""

from __future__ import annotations

import inspect

import pytest
from tools.check import compare, connect

from pressroom.operators import quantiles, skew
from pressroom.plans import features, impressions, ranker, scoring

from __spark_entry__ import oracle_sql, queries

QUERIES = [
    "median_next_read_time", "premium_clicks", "premium_propensity", "article_length_propensity", "sentiment_stats",
    "impressions_with_history", "item_features_inview", "training_impressions", "test_impressions",
    "evaluation_impressions", "time_decay_profile", "candidate_scores", "click_features", "user_profile",
]


@pytest.fixture
def hot_from_20(monkeypatch):
    for module in (quantiles, skew, features, impressions, ranker, scoring):
        for _, function in inspect.getmembers(module, inspect.isfunction):
            given = tuple(20 if value == skew.HOT_ROWS else value for value in function.__defaults__ or ())
            monkeypatch.setattr(function, "__defaults__", given or None)
    vectors = scoring.Vectors.joined
    given = tuple(20 if value == skew.HOT_ROWS else value for value in vectors.__defaults__)
    monkeypatch.setattr(vectors, "__defaults__", given)
    monkeypatch.setattr(scoring.vectors_for_join, "__defaults__", (0,))


@pytest.mark.parametrize("name", QUERIES)
def test_hot_plans_equal_the_sql(spark, small, hot_from_20, name):
    assert compare(spark, connect(small), small, name, queries()[name], oracle_sql()[name]) is None
