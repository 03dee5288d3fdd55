"""Approximate neighbours against all cosines."""

from __future__ import annotations

import numpy as np
import pytest

from pressroom.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, score double, k1 string, v string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.0, "x", None, "y") for i, v in rows], SCHEMA).repartition(3)


def exact(rows, every=50, nearest=5):
    ids, vectors = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    sizes = np.sqrt((vectors * vectors).sum(axis=1))
    found = {}
    for i, v, size in zip(ids, vectors, sizes):
        if i % every == 0:
            scores = (vectors * v).sum(axis=1) / (sizes * size)
            found[i] = sorted((-s, j) for s, j in zip(scores.tolist(), ids) if j != i)[:nearest]
    return found


def found(frame, **options):
    got: dict[int, list] = {}
    for r in sorted(neighbours.nearest_neighbours(frame, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) and got[q] == sorted(got[q]) for q in want)
    return np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("cell", [64, 1_024])
def test_recall_and_scores(spark, cell):
    rng = np.random.default_rng(cell)
    centres = rng.normal(size=(40, 48))
    rows = [(i, (centres[i % 40] + 0.4 * rng.normal(size=48)).tolist()) for i in range(2_500)]
    got, want = found(frame(spark, rows), cell=cell, sample=500), exact(rows)
    assert recall(got, want) >= 0.9
    scores = {q: dict((j, s) for s, j in exact(rows, nearest=2_500)[q]) for q in list(want)[:5]}
    assert all(abs(scores[q][j] - s) < 1e-12 for q in scores for s, j in got[q])


def test_isotropic_vectors(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert recall(found(frame(spark, rows)), exact(rows)) >= 0.9


def test_copies_and_ties(spark):
    """A third of all rows are one vector; ties go to the smaller id, whatever the number of copies."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).round(1).tolist()) for i in range(1, 900)]
    rows += [(1_000 + i, [2.0, 4.0, 6.0, 8.0]) for i in range(10)]
    got, want = found(frame(spark, rows + rows[:20]), cell=32), exact(rows)
    hot = [q for q in want if q % 3 == 0 and q < 900]
    assert all([j for _, j in got[q]] == [j for _, j in want[q]] for q in hot)
    assert recall(got, want) >= 0.9


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, -0.0]), (50, [nan, 1.0]), (100, [inf, 1.0]), (150, [None, 1.0]), (None, [1.0, 0.0]), (200, [-1.0])]
    got = found(frame(spark, rows))
    assert {q: [j for _, j in x] for q, x in got.items()} == {0: [1, 200], 200: [1, 0]}
    assert found(frame(spark, rows[:1])) == {} and found(spark.createDataFrame([], SCHEMA)) == {}


def test_extreme_lengths(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1.0, 0.0]), (3, [-1e300, 0.0])]
    wide = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(wide)
    assert [j for _, j in got[0]] == [1, 2, 3] and abs(got[0][0][0] + 1) < 1e-12


def test_chi_square():
    # Quantiles of chi-square with 2 and 16 degrees of freedom.
    assert abs(neighbours.stretch(0.95, 2) - 5.991465) < 1e-5 and abs(neighbours.stretch(0.95, 16) - 26.296228) < 1e-5
