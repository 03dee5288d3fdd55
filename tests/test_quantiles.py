from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.operators.quantiles import MEDIAN_RANKS, grouped_median, nearest_rank, ranked_values, value_range

RANKS = {**MEDIAN_RANKS, "q25": nearest_rank(0.25), "q75": nearest_rank(0.75)}


def test_ranges_keep_the_order(spark):
    rng = random.Random(1)
    values = sorted([rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(3000)] + [0.0, -0.0, 1.0, -1.0])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_range(F.col("v")).alias("r"))
    ranges = [r["r"] for r in sorted(df.collect(), key=lambda r: r["v"])]
    assert ranges == sorted(ranges)


def test_ranked_values_match_sorting(spark):
    rng = random.Random(2)
    groups = {
        "few": [3.0, 1.0],
        "one": [5.5],
        "ties": [2.0] * 40 + [7.0] * 41,
        "mixed": [rng.uniform(-100, 100) for _ in range(501)],
        "tight": [1 + rng.random() * 1e-5 for _ in range(400)],
        "none": [None, float("nan")],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("few", None)]
    rng.shuffle(rows)
    got = {r["g"]: r for r in ranked_values(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", RANKS).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, row in got.items():
        values = sorted(groups[g])
        n = len(values)
        assert (row["lower"] + row["upper"]) / 2 == pytest.approx(np.median(values), abs=0)
        for name, q in (("q25", 0.25), ("q75", 0.75)):
            assert row[name] == values[int(np.floor(q * (n - 1) + 0.5))]


@pytest.mark.parametrize("min_rows", [0, 20, 10**9])
def test_grouped_median_is_the_same_for_any_limit(spark, min_rows):
    rng = random.Random(3)
    rows = [(u, rng.choice([None, round(rng.expovariate(0.01), 2)])) for u in range(6) for _ in range(7 * u + 1)]
    rows += [(9, None)] * 30 + [(9, 4.0)] + [(10, None)] * 25
    got = {r["u"]: r["m"] for r in grouped_median(spark.createDataFrame(rows, "u int, v double"), "u", "v", "m", min_rows).collect()}
    assert set(got) == {u for u, _ in rows}
    for u, median in got.items():
        known = [v for key, v in rows if key == u and v is not None]
        assert median == (pytest.approx(np.median(known), rel=1e-12) if known else None)


@pytest.mark.parametrize("min_rows", [0, 3, 1_000])
def test_grouped_median_of_nan_infinity_and_null_keys(spark, min_rows):
    nan, inf = float("nan"), float("inf")
    rows = [(1, v) for v in (1.0, 2.0, nan, nan, nan)] + [(2, v) for v in (1.0, 3.0, inf, nan)] + [(3, -inf), (3, 5.0)]
    rows += [(None, v) for v in (4.0, 6.0, 8.0, None)]
    table = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: str(r.m) for r in grouped_median(table, "k", "v", "m", min_rows).collect()}
    assert got == {1: "nan", 2: "inf", 3: "-inf", None: "6.0"}
    assert grouped_median(table, "k", "v", "m", min_rows).count() == 4


@pytest.mark.parametrize("counted", [False, True])
def test_hot_null_keys_are_taken_apart(spark, monkeypatch, counted):
    """A third of all rows have no key; they go by value ranges over many tasks, as those of any large key."""
    from pressroom.operators import quantiles

    rng = random.Random(8)
    rows = [(None if i % 3 == 0 else i % 50, rng.expovariate(0.01)) for i in range(3_000)]
    table = spark.createDataFrame(rows, "k int, v double").repartition(16)
    apart = []
    plain = quantiles.ranked_values
    monkeypatch.setattr(quantiles, "ranked_values", lambda df, *a, **k: apart.append(df) or plain(df, *a, **k))
    counts = table.groupBy("k").agg(F.count(F.lit(1)).alias("_rows")) if counted else None
    got = {r.k: r.m for r in grouped_median(table, "k", "v", "m", 500, counted=counts).collect()}
    for key in [None, *range(50)]:
        known = [v for k, v in rows if k == key]
        assert key not in got and not known or got[key] == pytest.approx(np.median(known), rel=1e-12)
    assert [r[0] for r in apart[0].select("_key.key").distinct().collect()] == [None] and apart[0].count() == 1_000


def test_counted_medians_without_large_keys_read_once(spark):
    table = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 1.0)], "k int, v double")
    counts = table.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    assert {r.k: r.m for r in grouped_median(table, "k", "v", "m", 10, counted=counts).collect()} == {1: 3.0, None: 1.0}
