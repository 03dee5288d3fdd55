"""The fitted queries at the smallest scale: the choice by BIC, labels, their summaries, and the ranker's path."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from test_clusters import brute_categorical, brute_numerical, close, log_density

from pressroom import schemas
from pressroom.plans import catalog, mixtures, ranker
from pressroom.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def fitted(spark, small):
    rows = catalog._components(spark, small).select("user_id", vector_to_array("components").alias("x")).collect()
    model = mixtures.from_table(catalog._mixture(spark, small)[0])
    return [r.user_id for r in rows], np.array([r.x for r in rows]), model


def test_the_smallest_bic_is_chosen(spark, small, fitted):
    _, x, model = fitted
    grid = QUERIES["mixture_grid"](spark, small).collect()
    assert {(r.k, r.restarts) for r in grid} == {(k, n) for k in range(8, 15) for n in (5, 8, 10)}
    least = min(grid, key=lambda r: (r.bic, r.k, r.restarts))
    assert [(r.k, r.restarts) for r in grid if r.chosen] == [(least.k, least.restarts)] and model.k == least.k
    free = mixtures.parameter_count(model.k, x.shape[1])
    assert least.bic == pytest.approx(-2 * log_density(x, model) + free * math.log(len(x)), rel=1e-6)
    assert np.linalg.eigvalsh(model.covariances).min() > 0.99e-6


def test_labels_are_the_largest_densities(spark, small, fitted):
    users, x, model = fitted
    parts = [[log_density(p[None], mixtures.Mixture(model.weights[i : i + 1], model.means[i : i + 1], model.covariances[i : i + 1])) for i in range(model.k)] for p in x]
    want = {u: int(np.argmax(p)) for u, p in zip(users, parts)}
    assert {r.user_id: r.label for r in QUERIES["user_clusters"](spark, small).collect()} == want


def test_summaries_of_fitted_labels(spark, small, fitted):
    users, x, model = fitted
    label = dict(zip(users, model.predict(x).tolist()))
    profile = catalog._profile(spark, small).collect()
    assert len(profile) == len(users)
    got = {(r["scope"], r["feature"]): r for r in QUERIES["fitted_cluster_summary"](spark, small).collect()}
    scopes = {**{str(i): [r for r in profile if label[r.user_id] == i] for i in set(label.values())}, "global": profile}
    assert set(got) == {(s, f) for s in scopes for f in schemas.FEATURE_TYPES}
    for (scope, feature), row in got.items():
        values = [r[feature] if r[feature] is None else float(r[feature]) for r in scopes[scope]]
        if schemas.FEATURE_TYPES[feature] == "numerical":
            want = brute_numerical(values)
            want = [*want[:2], None if len([v for v in values if v is not None]) < 2 else want[2], *want[3:]]
            assert [row[c] for c in ("mean", "median")] == [pytest.approx(v, abs=1e-5) for v in want[:2]]
            assert row["q25"] == pytest.approx(want[3], abs=1e-5) and row["q75"] == pytest.approx(want[4], abs=1e-5)
        else:
            mode, rate, kinds, gini, entropy = brute_categorical(values)
            assert row["mode"] == mode and row["n_unique"] == kinds
            assert [row["mode_rate"], row["normalized_gini_index"], row["normalized_entropy_index"]] == [pytest.approx(v, abs=1e-5) for v in (rate, gini, entropy)]
    flags = QUERIES["fitted_discriminating_features"](spark, small).collect()
    assert {r.label for r in flags} == set(scopes) - {"global"} and 0 < sum(r.is_discriminating for r in flags) < len(flags)
    for r in flags:
        if r.feature_type == "numerical":
            own, whole = got[r.label, r.feature]["mean"], got["global", r.feature]["mean"]
            assert r.means_relative_difference == (pytest.approx(abs(own - whole) / whole, rel=1e-3, abs=1e-5) if whole else None)


def test_ranker_is_fitted_once_and_chosen_by_validation(spark, small):
    path = sorted(QUERIES["click_ranker_path"](spark, small).collect(), key=lambda r: r.step)
    best = max(path, key=lambda r: (r.auc, -r.step))
    assert [r.step for r in path if r.chosen] == [best.step] and path[0].reg_param == ranker.REG_PATH[0]
    metrics = {r["split"]: r for r in QUERIES["click_ranker_metrics"](spark, small).collect()}
    assert metrics["validation"]["auc"] == pytest.approx(best.auc, abs=2e-6)
    before = dict(catalog._STORED)
    assert QUERIES["click_ranker"](spark, small).where("split = 'test'").count() > 0
    assert catalog._STORED == before


def test_stored_tables_are_of_one_folder_and_state(spark, small, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(len(made))

    folder = tmp_path / "tables"
    folder.mkdir()
    (folder / "a").write_text("1")
    assert [catalog.stored(spark, str(folder), "t", build).count() for _ in range(2)] == [1, 1]
    (folder / "b").write_text("22")  # the folder has changed
    assert catalog.stored(spark, str(folder), "t", build).count() == 2
