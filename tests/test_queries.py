"""Every registered query at the smallest scale, against its SQL where it has one."""

from __future__ import annotations

import pytest
from conftest import plan_of
from tools.check import compare, connect

from pressroom.operators import sessions
from pressroom.plans.catalog import QUERIES

from __spark_entry__ import entry, oracle_sql, queries

WITHOUT_SQL = {
    "click_ranker", "click_ranker_lines", "click_ranker_metrics", "click_ranker_path", "user_clusters", "user_pca", "pca_shares",
    "mixture_grid", "fitted_cluster_summary", "fitted_discriminating_features",
}
EAGER = WITHOUT_SQL | {"user_profile", "cluster_summary", "discriminating_features", "feature_covariances", "standardised_users"}


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


def test_every_query_but_the_fitted_ones_has_sql():
    assert set(QUERIES) - set(oracle_sql()) == WITHOUT_SQL
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, db, name):
    assert compare(spark, db, small, name, queries()[name], oracle_sql().get(name)) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_plans_hold_no_python_and_no_cross_join(spark, small, name):
    text = plan_of(queries()[name](spark, small))
    for unwanted in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "NestedLoopJoin"):
        assert unwanted not in text


def test_scans_read_only_what_is_needed(spark, small):
    text = plan_of(queries()["favourite_device"](spark, small))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text
    text = plan_of(queries()["premium_articles"](spark, small))
    assert "text" not in text and "n_chars" not in text


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "user_id" and df.count() > 0


def reads_of(frames) -> int:
    return sum(plan_of(df).count("/events.parquet]") for df in frames)


@pytest.mark.parametrize("min_rows, reads", [(200_000, 5), (20, 6)])
def test_the_profile_reads_the_log_few_times(spark, small, monkeypatch, min_rows, reads):
    """In all plans of the profile together; with hot users, their rows are read once more."""
    from pressroom.operators import quantiles
    from pressroom.plans import features
    from pressroom.sources import derived

    made = []
    for module in (features, quantiles):
        plain = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, plain=plain: made.append(df) or plain(df))
    history, visits = (f(spark, small, features.TRAIN_VALIDATION) for f in (derived.history, derived.visits))
    table = features.whole_profile(history, visits, derived.behaviors(spark, small, features.TRAIN), derived.articles(spark, small), min_rows=min_rows)
    rows = sorted(map(tuple, table.collect()), key=repr)
    assert len(rows) > 10 and reads_of([*made, table]) <= reads
    parts = [
        features.sentiment_stats(features.recent_entries(history), derived.articles(spark, small)), features.visit_profile(visits),
        sessions.time_profile(sessions.meaningful(sessions.user_sessions(history))), features.median_next_read_time(visits),
        features.premium_propensity(derived.behaviors(spark, small, features.TRAIN), derived.articles(spark, small)),
    ]
    assert rows == sorted(map(tuple, features.user_profile(features.history_profile(history), parts).collect()), key=repr)


def test_split_filters_reach_the_scan(spark, small):
    text = plan_of(queries()["reading_engagement"](spark, small))
    assert "LessThan(ts" in text


def test_articles_in_view_grow_with_the_documents(spark, small):
    from pressroom.sources import derived

    known = derived.articles(spark, small).select("article_id")
    read = derived.history(spark, small).select("article_id").distinct().join(known, "article_id", "left_semi")
    assert read.count() > 0.5 * known.count()
