from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from pressroom.operators.sessions import (
    meaningful,
    session_hour_propensity,
    sessions_of_entries,
    time_profile,
    user_sessions,
    user_sessions_from_lists,
)
from pressroom.sources.tables import long_history

HISTORY = """user_id bigint, split string, article_id_fixed array<bigint>, impression_time_fixed array<timestamp>,
read_time_fixed array<double>, scroll_percentage_fixed array<double>"""
COLUMNS = ["user_id", "split", "session_no", "n_impressions", "start_us", "end_us", "session_hour"]
START = datetime(2024, 1, 1, 10, 0, 0, tzinfo=timezone.utc)


def lists(spark, rows):
    data = [(u, s, None if t is None else [1] * len(t), t, None, None) for u, s, t in rows]
    return spark.createDataFrame(data, HISTORY)


def at(*offsets):
    return [START + timedelta(microseconds=o) for o in offsets]


HOUR = 3_600_000_000


def sizes(sessions):
    return tuples(sessions, "user_id", "split", "n_impressions")


def test_a_gap_of_exactly_one_hour_does_not_break(spark):
    history = lists(spark, [(1, "train", at(0, HOUR)), (2, "train", at(0, HOUR + 1))])
    expected = [(1, "train", 2), (2, "train", 1), (2, "train", 1)]
    assert sizes(user_sessions(long_history(history))) == expected
    assert sizes(user_sessions_from_lists(history)) == expected


def test_splits_never_share_a_session(spark):
    history = lists(spark, [(1, "train", at(0, 1)), (1, "validation", at(2, 3, 4))])
    for sessions in (user_sessions(long_history(history)), user_sessions_from_lists(history)):
        assert tuples(sessions, "split", "session_no", "n_impressions") == [("train", 1, 2), ("validation", 2, 3)]


def test_lists_out_of_order_are_read_in_list_order(spark):
    history = lists(spark, [(1, "train", at(2 * HOUR, 0, 2 * HOUR))])
    assert sizes(user_sessions_from_lists(history)) == [(1, "train", 1), (1, "train", 2)]


def test_null_instants_break_lists_and_are_ignored_in_time_order(spark):
    history = lists(spark, [(1, "train", [START, None, START])])
    assert sizes(user_sessions_from_lists(history)) == [(1, "train", 1)] * 3
    assert sizes(user_sessions(long_history(history))) == [(1, "train", 2)]


def test_empty_histories_have_no_meaningful_session(spark):
    history = lists(spark, [(1, "train", []), (2, "train", None)])
    assert meaningful(user_sessions(long_history(history))).count() == 0
    assert meaningful(user_sessions_from_lists(history)).count() == 0


def test_hour_of_the_mean_instant(spark):
    # 10:00 and 10:59 and 11:58: the mean is 10:59.
    history = lists(spark, [(1, "train", at(0, 59 * 60_000_000, 118 * 60_000_000))])
    for sessions in (user_sessions(long_history(history)), user_sessions_from_lists(history)):
        assert tuples(sessions, "session_hour") == [(10,)]


def test_cells_equal_row_by_row_sessions(spark):
    rng = random.Random(4)
    rows = []
    for user in range(12):
        for split in ("train", "validation"):
            steps = [rng.choice([1, 1000, HOUR // 2, HOUR - 1, HOUR, HOUR + 1, 3 * HOUR]) for _ in range(60)]
            offsets, total = [], rng.randrange(HOUR)
            for step in steps:
                total += step
                offsets.append(total)
            rows.append((user, split, at(*offsets)))
    history = lists(spark, rows)
    by_cell = user_sessions(long_history(history).repartition(7))
    by_row = user_sessions_from_lists(history)
    assert tuples(by_cell, *COLUMNS) == tuples(by_row, *COLUMNS)
    assert by_cell.agg(F.sum("n_impressions")).first()[0] == 12 * 2 * 60


def test_cells_are_counted_before_the_shuffle(spark):
    # One user with all the rows: what leaves the input tasks is one row per task and hour.
    history = spark.range(0, 20_000, numPartitions=4).select(
        F.lit(1).alias("user_id"),
        F.lit("train").alias("split"),
        F.timestamp_seconds(F.lit(1_704_103_200) + F.col("id") % 7200).alias("impression_time"),
    )
    assert tuples(user_sessions(history), "n_impressions") == [(20_000,)]


def test_profile_shares_sum_to_one(spark):
    rng = random.Random(5)
    rows = [(u, "train", at(*sorted(rng.randrange(300 * HOUR) for _ in range(80)))) for u in range(5)]
    sessions = meaningful(user_sessions(long_history(lists(spark, rows))))
    profile = time_profile(sessions)
    assert profile.columns == ["user_id", *[str(h) for h in range(24)]]
    wide = {r["user_id"]: [r[str(h)] for h in range(24)] for r in profile.collect()}
    for shares in wide.values():
        assert sum(shares) == pytest.approx(1, abs=1e-5)
    for row in session_hour_propensity(sessions).collect():
        assert wide[row["user_id"]][row["session_hour"]] == row["propensity"]


def plain_sessions(rows, gap=HOUR):
    """Sessions of (user, split, offsets or None) in list order, one entry at a time."""
    found = []
    for user in sorted({u for u, _, _ in rows}):
        number = 0
        for _, split, offsets in sorted((r for r in rows if r[0] == user), key=lambda r: r[1]):
            before, first = None, True
            for o in offsets or [None]:
                if first or o is None or before is None or o - before > gap:
                    number += 1
                    found.append([user, split, number, 0, None, None])
                last = found[-1]
                last[3] += 1
                if o is not None:
                    last[4], last[5] = min(o, last[4] if last[4] is not None else o), max(o, last[5] if last[5] is not None else o)
                before, first = o, False
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("chunk", [1, 3, 16, 4_096])
def test_partial_sessions_are_stitched_across_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for user in range(12):
        for split in ("train", "validation"):
            steps = [rng.choice([0, HOUR // 3, HOUR, HOUR + 1, -HOUR, 5 * HOUR]) for _ in range(rng.randint(0, 40))]
            offsets, now = [], 0
            for step in steps:
                now += step
                offsets.append(None if rng.random() < 0.1 else now)
            rows.append((user, split, None if user == 3 and split == "train" else offsets))
    table = lists(spark, [(u, s, None if o is None else [None if x is None else START + timedelta(microseconds=x) for x in o]) for u, s, o in rows])
    base = int(START.timestamp()) * 1_000_000
    got = [
        (r.user_id, r.split, r.session_no, r.n_impressions, *[None if x is None else x - base for x in (r.start_us, r.end_us)])
        for r in user_sessions_from_lists(table, chunk=chunk).collect()
    ]
    assert sorted(got, key=repr) == plain_sessions(rows)


def test_a_user_with_very_many_entries_is_the_work_of_many_tasks(spark):
    """Half of all entries are one user's; no window holds more than a chunk of them."""
    long = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).cast("bigint").alias("user_id"), F.lit("train").alias("split"),
        F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 2)).otherwise(0).alias("_pos"), (F.col("id") * F.lit(HOUR // 4)).alias("_us"),
    )
    found = sessions_of_entries(long, chunk=500)
    hot = found.where("user_id = -1").collect()
    assert len(hot) == 1 and hot[0].n_impressions == 20_000 and found.count() == 20_001
    shuffled = long.withColumn("_chunk", F.floor(F.col("_pos") / 500)).repartition(32, "user_id", "split", "_chunk")
    tasks = shuffled.where("user_id = -1").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 15
