from __future__ import annotations

import pytest
from conftest import plan_of, tuples
from pyspark.sql import functions as F

from pressroom.operators.skew import first_rows, hot_keys, skew_join, with_salts


@pytest.fixture(scope="module")
def sides(spark):
    # Key 0 holds more than a third of the rows; key 99 has no partner.
    big = spark.range(900).select(
        F.col("id"), F.when(F.col("id") % 5 < 2, 0).when(F.col("id") % 100 == 2, 99).otherwise(F.col("id") % 7).alias("k")
    )
    small = spark.createDataFrame([(k, f"v{k}") for k in range(12)], "k bigint, v string")
    return big, small


def test_hot_keys(sides):
    big, _ = sides
    assert [r["k"] for r in hot_keys(big, ["k"], 200).collect()] == [0]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("min_rows", [0, 200, 10**6])
def test_skew_join_equals_the_plain_join(sides, how, min_rows):
    big, small = sides
    expected = tuples(big.join(small, "k", how), "id", "k", "v")
    got = tuples(skew_join(big, small, ["k"], ["id"], how, min_rows=min_rows), "id", "k", "v")
    assert got == expected


@pytest.fixture
def plain_joins(spark):
    """Neither broadcasts nor adaptive plans, so that tasks show where the join puts rows."""
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"
    saved = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ("-1", "false", "16")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, saved):
        spark.conf.set(name, value)


def tasks(df) -> int:
    # Counting a column of the other side keeps the join from being optimized away.
    return len(df.groupBy(F.spark_partition_id()).agg(F.count("v")).collect())


def test_hot_rows_are_spread_by_their_number(plain_joins, sides):
    big, small = sides
    joined = skew_join(big, small, ["k"], ["id"], min_rows=40)
    assert tasks(joined.where("k = 0")) > 4
    assert tasks(joined.where("k = 5")) <= 3


def test_a_key_ten_times_hotter_has_ten_times_the_salts(spark):
    rows = spark.range(11_000).select(F.when(F.col("id") < 1_000, 1).otherwise(2).alias("k"))
    hot = hot_keys(rows, ["k"], 100)
    salts = with_salts(rows.distinct(), hot, ["k"], 100)
    assert tuples(salts) == [(1, 10), (2, 100)]


def test_null_keys_are_spread(plain_joins, spark, sides):
    _, small = sides
    big = spark.range(2_000).select("id", F.when(F.col("id") < 0, F.col("id")).alias("k"))
    joined = skew_join(big, small, ["k"], ["id"], "left", min_rows=10**6)
    assert tasks(joined) == 16
    assert joined.where("v IS NULL").count() == 2_000


def test_the_hot_list_has_a_fixed_length(sides):
    big, _ = sides
    counts = sorted((-r["count"], r["k"]) for r in big.groupBy("k").count().collect())
    assert [(-r["_rows"], r["k"]) for r in hot_keys(big, ["k"], 0, most=2).collect()] == counts[:2]
    assert hot_keys(big.where("k IS NULL"), ["k"], 0).count() == 0


def test_skew_join_rejects_other_types(sides):
    with pytest.raises(ValueError):
        skew_join(*sides, ["k"], ["id"], "full")


def test_first_rows_are_limited_before_the_shuffle(sides):
    big, _ = sides
    top = first_rows(big, ["k"], [F.desc("id")], 3, "rank")
    text = plan_of(top)
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")
    per_key = {}
    for row in top.collect():
        per_key.setdefault(row["k"], []).append(row["rank"])
    assert all(sorted(ranks) == [1, 2, 3] for ranks in per_key.values())
