from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from conftest import plan_of, tuples
from pyspark.sql import functions as F
from test_features import DAY, behaviors, history, times

from pressroom.plans import features, impressions
from pressroom.sources.tables import long_history


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        {"user_id": 1, "article_ids_inview": [10, 20, 30], "article_ids_clicked": [20]},
        {"user_id": 1, "article_ids_inview": [10, 20], "article_ids_clicked": [10, 20]},  # nothing unclicked
        {"user_id": 2, "article_ids_inview": [10, 20, 30, 40], "article_ids_clicked": [40, 10]},
        {"user_id": 3, "article_ids_inview": [10], "article_ids_clicked": []},
        {"user_id": 4, "article_ids_inview": [10], "article_ids_clicked": None},
    ]
    return behaviors(spark, [{**r, "impression_time": DAY + timedelta(days=i)} for i, r in enumerate(rows)])


@pytest.fixture(scope="module")
def recent(spark):
    lists = history(
        spark,
        (1, "train", [1, 2, 3], times(0, 1, 2), None, None),
        (2, "train", list(range(100, 125)), [DAY + timedelta(minutes=i) for i in range(25)], None, None),
        (3, "train", [], [], None, None),
    )
    return features.recent_entries(long_history(lists))


def test_negatives(log):
    rows = impressions.negative_samples(log, per_click=3).collect()
    assert sorted((r["impression_id"], r["clicked_article_id"]) for r in rows) == [(0, 20), (2, 10), (2, 40)]
    for row in rows:
        assert len(row["article_ids_inview"]) == len(row["labels"]) == 4
        positives = [a for a, label in zip(row["article_ids_inview"], row["labels"]) if label == 1]
        negatives = {a for a, label in zip(row["article_ids_inview"], row["labels"]) if label == 0}
        assert positives == [row["clicked_article_id"]]
        assert negatives <= {0: {10, 30}, 2: {20, 30}}[row["impression_id"]]


def test_negatives_do_not_depend_on_partitions_but_on_the_seed(spark):
    table = behaviors(
        spark, [{"user_id": i, "article_ids_inview": list(range(9)), "article_ids_clicked": [i % 9]} for i in range(60)]
    )
    columns = ["impression_id", "article_ids_inview", "labels"]
    one = tuples(impressions.negative_samples(table.repartition(1)), *columns)
    assert one == tuples(impressions.negative_samples(table.repartition(5)), *columns)
    assert one != tuples(impressions.negative_samples(table, seed=7), *columns)
    places = {row[2].index(1) for row in one}
    assert len(places) > 3  # the clicked article is shuffled among the candidates


def test_labels_follow_the_list(log):
    got = {r["impression_id"]: r["labels"] for r in impressions.binary_labels(log).collect()}
    assert got == {0: [0, 1, 0], 1: [1, 1], 2: [1, 0, 0, 1], 3: [0], 4: [0]}


def test_sample(spark):
    table = spark.range(4000).withColumnRenamed("id", "impression_id")
    some = tuples(impressions.sample(table, 0.25))
    assert some == tuples(impressions.sample(table.repartition(9), 0.25))
    assert 850 < len(some) < 1150
    assert set(some) < set(tuples(impressions.sample(table, 0.5)))
    assert impressions.sample(table, 1.0).count() == 4000
    assert impressions.sample(table, 0.0).count() == 0


def test_temporal_split(log):
    parts = {r["impression_id"]: r["part"] for r in impressions.temporal_split(log).collect()}
    assert parts == {0: "train", 1: "train", 2: "train", 3: "validation", 4: "validation"}


def test_split_at_midnight(spark):
    midnight = datetime(2024, 3, 1, tzinfo=timezone.utc)
    rows = [{"user_id": 1, "impression_time": midnight + timedelta(microseconds=d)} for d in (-1, 0)]
    rows.append({"user_id": 1, "impression_time": midnight + timedelta(days=1, hours=23)})
    parts = {r["impression_id"]: r["part"] for r in impressions.temporal_split(behaviors(spark, rows)).collect()}
    assert parts == {0: "train", 1: "validation", 2: "validation"}


@pytest.mark.parametrize("min_rows", [0, 10**6])
def test_history_is_padded_on_the_left(log, recent, min_rows):
    joined = impressions.with_history(log, recent, 4, min_rows=min_rows)
    got = {r["impression_id"]: r["article_id_fixed"] for r in joined.collect()}
    # The user without any history row drops out, the one with an empty history does not.
    assert got == {0: [0, 1, 2, 3], 1: [0, 1, 2, 3], 2: [121, 122, 123, 124], 3: [0, 0, 0, 0]}


def test_padded_inview(log):
    got = {r["impression_id"]: r["padded_inview"] for r in impressions.padded_inview(log).collect()}
    assert got[3] == [10, 0, 0, 0] and got[2] == [10, 20, 30, 40]


@pytest.mark.parametrize("min_rows", [0, 10**6])
def test_mapped_inview(spark, log, min_rows):
    mapping = spark.createDataFrame([(10, 1.0), (30, None)], "article_id bigint, premium float")
    empty = behaviors(spark, [{"impression_id": 9, "user_id": 1}])
    got = {
        r["impression_id"]: r["premium"]
        for r in impressions.mapped_inview(log.unionByName(empty), mapping, "premium", min_rows=min_rows).collect()
    }
    assert got == {0: [1, 0, 0], 1: [1, 0], 2: [1, 0, 0, 0], 3: [1], 4: [1], 9: []}


@pytest.mark.parametrize("min_rows", [0, 10**6])
def test_training_impressions(spark, log, recent, min_rows):
    one = spark.createDataFrame([(1, 2), (2, 3)], "user_id bigint, premium_propensity int")
    two = spark.createDataFrame([(2, 4)], "user_id bigint, reading_engagement int")
    rows = impressions.training_impressions(log, recent, [one, two], min_rows=min_rows).collect()
    assert sorted(r["clicked_article_id"] for r in rows) == [10, 40]
    # The latest remaining impression sets the cut.
    assert {r["part"] for r in rows} == {"validation"}
    assert all(len(r["article_id_fixed"]) == 20 and len(r["labels"]) == 6 for r in rows)
    steps = (
        impressions.negative_samples(log)
        .transform(impressions.with_history, recent=recent)
        .transform(impressions.with_user_features, features=one.join(two, "user_id"), min_rows=min_rows)
    )
    columns = ["impression_id", "article_ids_inview", "labels", "article_id_fixed"]
    assert tuples(steps, *columns) == sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_test_impressions(spark, log, recent):
    engagement = spark.createDataFrame([(1, 3)], "user_id bigint, reading_engagement int")
    test = log.withColumn("split", F.when(F.col("impression_id") == 0, "test").otherwise("train"))
    recent_test = recent.withColumn("split", F.lit("test"))
    (row,) = impressions.test_impressions(test, recent_test, engagement).collect()
    assert (row["impression_id"], row["labels"], row["article_ids_clicked"]) == (0, [0, 0, 0], [])
    assert (row["premium_propensity"], row["reading_engagement"]) == (0, 3)


def test_negatives_without_replacement(spark, log):
    rows = impressions.negative_samples(log, per_click=2, with_replacement=False).collect()
    assert sorted((r["impression_id"], r["clicked_article_id"]) for r in rows) == [(0, 20), (2, 10), (2, 40)]
    for row in rows:
        drawn = [a for a, label in zip(row["article_ids_inview"], row["labels"]) if label == 0]
        assert sorted(drawn) == {0: [10, 30], 2: [20, 30]}[row["impression_id"]]
    few = impressions.negative_samples(log, per_click=5, with_replacement=False).collect()
    assert all(len(set(r["article_ids_inview"])) == len(r["article_ids_inview"]) == 3 for r in few)  # two unclicked articles only
    many = behaviors(spark, [{"user_id": i, "article_ids_inview": list(range(12)), "article_ids_clicked": [i % 12]} for i in range(200)])
    one, other = (impressions.negative_samples(many.repartition(n), per_click=3, with_replacement=False) for n in (1, 6))
    assert tuples(one, "impression_id", "article_ids_inview", "labels") == tuples(other, "impression_id", "article_ids_inview", "labels")
    seen = [a for r in one.collect() for a, label in zip(r["article_ids_inview"], r["labels"]) if label == 0]
    assert all(seen.count(a) > 20 for a in range(12)) and len({r["labels"].index(1) for r in one.collect()}) == 4


@pytest.mark.parametrize("min_rows", [200_000, 2])
def test_lists_are_mapped_together(spark, min_rows):
    mapping = spark.createDataFrame([(1, 0.5, 10), (2, None, 20), (3, 1.5, 30)], "article_id bigint, x double, y int")
    rows = [(0, [1, 2, 9], [3, 1]), (1, [], None), (2, [None, 3], [9]), (3, [1] * 30, [3, 3])]
    table = spark.createDataFrame(rows, "impression_id bigint, seen array<bigint>, shown array<bigint>").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in impressions.mapped_lists(table, ["seen", "shown"], mapping, {"x": 0.0, "y": -1.0}, min_rows=min_rows).collect()}
    values = {1: (0.5, 10.0), 2: (0.0, 20.0), 3: (1.5, 30.0)}
    for i, seen, shown in rows:
        want = [[values.get(a, (0.0, -1.0))[j] for a in ids or []] for ids in (seen, shown) for j in (0, 1)]
        assert got[i] == tuple(want)


def test_mapped_lists_join_once(spark):
    mapping = spark.createDataFrame([(1, 0.5, 10)], "article_id bigint, x double, y int")
    table = spark.createDataFrame([(0, [1], [2])], "impression_id bigint, seen array<bigint>, shown array<bigint>")
    text = plan_of(impressions.mapped_lists(table, ["seen", "shown"], mapping, {"x": 0.0, "y": 0.0}))
    assert text.count("\n(") and text.split("Physical Plan")[1].split("\n\n")[0].count("LeftOuter") <= 3
