from __future__ import annotations

import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressroom.functions import arrays
from pressroom.functions.scalars import id_hash, sigmoid, two_level


def cell(spark, values, kind, expression):
    return spark.createDataFrame([(values,)], f"a {kind}").select(expression(F.col("a")).alias("x")).first()["x"]


def test_tail_keeps_short_lists(spark):
    for values, expected in (([1, 2, 3], [2, 3]), ([1], [1]), ([], []), (None, None), ([1, None], [1, None])):
        assert cell(spark, values, "array<int>", lambda a: arrays.list_tail(a, 2)) == expected


def test_mean_and_median_skip_nulls(spark):
    for values, mean, median in (
        ([1.0, None, 3.0], 2.0, 2.0),
        ([5.0, 1.0, 3.0], 3.0, 3.0),
        ([None, None], None, None),
        ([], None, None),
        (None, None, None),
    ):
        assert cell(spark, values, "array<double>", arrays.list_mean) == mean
        assert cell(spark, values, "array<double>", arrays.list_median) == median


def test_diff_starts_with_null(spark):
    assert cell(spark, [1, 4, 2], "array<int>", arrays.list_diff) == [None, 3, -2]
    assert cell(spark, [], "array<int>", arrays.list_diff) == []


def test_padding(spark):
    right = lambda a: arrays.pad_right(a, 3, 0)
    left = lambda a: arrays.pad_left(a, 3, 0)
    for values, on_right, on_left in (
        ([7], [7, 0, 0], [0, 0, 7]),
        ([1, 2, 3, 4], [1, 2, 3], [2, 3, 4]),
        (None, [0, 0, 0], [0, 0, 0]),
        ([None, 5], [0, 5, 0], [0, 0, 5]),
    ):
        assert cell(spark, values, "array<bigint>", right) == on_right
        assert cell(spark, values, "array<bigint>", left) == on_left


def test_dot_and_sigmoid(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "u array<float>, v array<float>")
    assert df.select(arrays.dot(F.col("u"), F.col("v"))).first()[0] == 1.0
    assert df.select(sigmoid(F.lit(0.0))).first()[0] == 0.5


def test_two_level_treats_null_as_failed(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean")
    got = [r[0] for r in df.select(two_level(F.col("a"), F.col("b"))).collect()]
    assert got == [1, 2, 2, 3, 4, 4, 3, 4, 4]


def test_id_hash_is_the_md5_prefix(spark):
    import hashlib

    expected = int(hashlib.md5(b"17|4|order|123").hexdigest()[:8], 16)
    df = spark.range(17, 18)
    assert df.select(id_hash(F.col("id"), 4, "order", 123)).first()[0] == expected


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(-50, 50)), max_size=9), min_size=1, max_size=8))
def test_median_matches_the_library(spark, lists):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, a array<int>")
    got = {r["i"]: r["m"] for r in df.select("i", arrays.list_median(F.col("a")).alias("m")).collect()}
    for i, values in enumerate(lists):
        known = [v for v in values if v is not None]
        assert got[i] == (statistics.median(known) if known else None)
