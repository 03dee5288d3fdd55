from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from conftest import tuples
from pyspark.sql import functions as F

from pressroom import schemas
from pressroom.plans import experiments
from pressroom.sources import runs


def write_run(folder, i, flags, **parameters):
    values = {
        "DEBUG": False, "DATASPLIT": "demo", "DATA_PATH": "d", "DOCUMENT_EMBEDDINGS": "e", "BS_TRAIN": 128,
        "BS_TEST": 128, "BATCH_SIZE_TEST_WO_B": 128, "BATCH_SIZE_TEST_W_B": 8, "FRACTION_TEST": 1.0,
        "N_CHUNKS_TEST": 10, "CHUNKS_DONE": 0, "TRAIN_FRACTION": 1, "ATTENTION_HIDDEN_DIM": 200, "TITLE_SIZE": 768,
        "LEARNING_RATE": 0.0001, "NEWSENCODER_L2_REGULARIZATION": 0.0001,
        "NEWSENCODER_UNITS_PER_LAYER": [512, 512], "OPTIMIZER": "adam", "LOSS": "log_loss", "DROPOUT": 0.2,
        "SEED": 123, "epochs": 5, "history_size": 20, "npratio": 4, "head_num": 16, "head_dim": 16,
        "nrms_loader": "plain", **flags, **parameters,
    }
    run = folder / f"run_{i}"
    run.mkdir()
    (run / "config.json").write_text(json.dumps({"run_id": f"run_{i}", "parameters": values}, indent=2))
    (run / "metrics.json").write_text(json.dumps({"auc": 0.5 + i / 100, "mrr": 0.4, "ndcg@5": 0.3, "ndcg@10": 0.2}))


def test_results_from_run_folders(spark, tmp_path):
    for i, (pe, rln, td) in enumerate(itertools.product([False, True], repeat=3)):
        write_run(tmp_path, i, {"use_pe": pe, "use_rln": rln, "use_td": td}, epochs=i)
    (tmp_path / "manifest.json").write_text("{}")
    lonely = tmp_path / "run_9"
    lonely.mkdir()
    (lonely / "config.json").write_text(json.dumps({"run_id": "run_9", "parameters": {}}))
    table = runs.results_table(runs.read_runs(spark, str(tmp_path)), schemas.ABLATION_FLAGS)
    assert [f.name for f in table.schema.fields] == [
        "run id", *[name for name, _, _ in schemas.RUN_PARAMETERS], "used model", *schemas.METRICS
    ]
    types = dict(table.dtypes)
    assert (types["epochs"], types["bs train"], types["newsencoder units per layer"]) == ("tinyint", "smallint", "array<int>")
    rows = {r["run id"]: r for r in table.collect()}
    assert len(rows) == 8
    assert [rows[f"run_{i}"]["used model"] for i in range(8)] == [
        "Baseline", "TD", "RLN", "RLN+TD", "PE", "PE+TD", "PE+RLN", "PE+RLN+TD"
    ]
    assert rows["run_3"]["epochs"] == 3 and rows["run_3"]["auc"] == 0.53
    assert rows["run_3"]["newsencoder units per layer"] == [512, 512]


def test_preprocessing_variants(spark, tmp_path):
    names = [flag for flag, _ in schemas.PREPROCESSING_FLAGS]
    for i, values in enumerate(itertools.product([False, True], repeat=3)):
        write_run(tmp_path, i, dict(zip(names, values)))
    table = runs.results_table(runs.read_runs(spark, str(tmp_path)), schemas.PREPROCESSING_FLAGS)
    got = {r["run id"]: r["used model"] for r in table.collect()}
    assert [got[f"run_{i}"] for i in range(8)] == ["Baseline", "ALP", "RE", "RE+ALP", "PP", "PP+ALP", "PP+RE", "PP+RE+ALP"]


def results(spark, rows):
    return spark.createDataFrame(rows, "`run id` string, `used model` string, x double, auc double, mrr double, `ndcg@5` double, `ndcg@10` double")


def test_scores_and_winners(spark):
    table = results(
        spark,
        [("a", "M", 1.0, 0.8, 0.5, 0.5, 0.5), ("b", "M", 2.0, 0.8, 0.5, 0.5, 0.5), ("c", "M", 3.0, 0.1, 0.1, 0.1, 0.1),
         ("d", "N", 4.0, 0.2, 0.9, 0.0, 1.0)],
    )
    scores = {r["run id"]: r["overall score"] for r in experiments.with_overall_score(table).collect()}
    assert scores["a"] == pytest.approx(0.65) and scores["d"] == pytest.approx(0.47)
    assert tuples(experiments.winners_per_model(table), "run id") == [("a",), ("b",), ("d",)]
    assert tuples(experiments.best_run(table), "run id") == [("a",)]


def test_correlations(spark):
    rng = np.random.default_rng(11)
    values = rng.random((40, 5))
    table = results(spark, [(f"r{i}", "M", *map(float, v)) for i, v in enumerate(values)])
    parameters = {"x": F.col("x"), "constant": F.lit(3), "minus": -F.col("x")}
    rows = experiments.param_correlations(table, parameters).collect()
    assert len(rows) == 12
    for i, metric in enumerate(schemas.METRICS):
        mine = {r["parameter"]: r for r in rows if r["metric"] == metric}
        expected = np.corrcoef(values[:, 0], values[:, i + 1])[0, 1]
        assert mine["x"]["correlation"] == pytest.approx(expected)
        assert mine["minus"]["correlation"] == pytest.approx(-expected)
        assert mine["constant"]["correlation"] is None and mine["constant"]["rank"] == 3
        assert mine["x" if expected > 0 else "minus"]["rank"] == 1


def test_correlation_of_one_row_is_unknown(spark):
    table = results(spark, [("a", "M", 1.0, 0.8, 0.5, 0.5, 0.5)])
    assert {r["correlation"] for r in experiments.param_correlations(table, {"x": F.col("x")}).collect()} == {None}


def test_correlation_uses_complete_pairs(spark):
    table = results(spark, [("a", "M", 1.0, 0.1, 0.5, 0.5, 0.5), ("b", "M", 2.0, 0.3, 0.5, 0.5, 0.5), ("c", "M", None, 9.0, 0.5, 0.5, 0.5)])
    got = {r["metric"]: r["correlation"] for r in experiments.param_correlations(table, {"x": F.col("x")}).collect()}
    assert got["auc"] == pytest.approx(1.0) and got["mrr"] is None


def test_encoding(spark):
    table = spark.createDataFrame([("cross_entropy_loss",), ("log_loss",), (None,)], "loss string")
    got = [r[0] for r in table.select(experiments.encoded("loss", "cross_entropy_loss")).collect()]
    assert got == [1, 2, 2]
    assert math.isclose(sum(experiments.SCORE_WEIGHTS.values()), 1)


def test_run_folders_that_are_not_whole(spark, tmp_path):
    whole = {"config": '{"run_id": "r", "parameters": {"SEED": 3}}', "metrics": '{"auc": 0.5}'}
    spoilt = {"complete": {}, "no config": {"config": None}, "no metrics": {"metrics": None}, "corrupt config": {"config": '{"run_id": '}, "corrupt metrics": {"metrics": "{{"}}
    for status, change in spoilt.items():
        folder = tmp_path / status.replace(" ", "_")
        folder.mkdir()
        for name, text in {**whole, **change}.items():
            if text is not None:
                (folder / f"{name}.json").write_text(text)
    got = {r["folder"]: r for r in runs.run_folders(spark, str(tmp_path)).collect()}
    assert {f: r["status"] for f, r in got.items()} == {s.replace(" ", "_"): s for s in spoilt}
    assert got["complete"]["config"]["parameters"]["SEED"] == 3 and got["corrupt_config"]["config"] is None
    assert tuples(runs.read_runs(spark, str(tmp_path)), "folder") == [("complete",)]


def test_sweeps(spark, tmp_path):
    rows = [("1", f"run_{i}", None if i == 0 else '{"run_id": "run_%d", "parameters": {"SEED": %d}}' % (i, i), None if i == 1 else '{"auc": 0.5}' if i != 2 else '{"auc"') for i in range(6)]
    rows.append(("2", "run_9", "{", "{"))
    runs.write_sweeps(spark.createDataFrame(rows, "sweep string, run_id string, config string, metrics string"), str(tmp_path))
    read = runs.read_sweeps(spark, str(tmp_path))
    assert {r["run_id"]: r["status"] for r in read.collect()} == {
        "run_0": "no config", "run_1": "no metrics", "run_2": "corrupt metrics", "run_3": "complete", "run_4": "complete", "run_5": "complete", "run_9": "corrupt config"
    }
    report = {r["sweep"]: r for r in runs.sweep_report(read).collect()}
    assert (report["1"]["n_runs"], report["1"]["n_complete"], report["1"]["n_corrupt_metrics"]) == (6, 3, 1) and report["2"]["n_corrupt_config"] == 1


def test_files_of_sweeps_do_not_grow_with_the_sweeps(spark, tmp_path):
    names = [f"s{i}" for i in range(40)] + ["a/b", "tab\there", "new\nline", "50%", None]
    rows = [(s, f"run_{i}", '{"run_id": "run_%d", "parameters": {"SEED": 1}}' % i, '{"auc": 0.5}') for i, s in enumerate(names)]
    runs.write_sweeps(spark.createDataFrame(rows, "sweep string, run_id string, config string, metrics string").coalesce(2), str(tmp_path))
    for name in ("config", "metrics"):
        assert 1 <= len(list((tmp_path / name).rglob("*.txt"))) <= 2
    read = runs.read_sweeps(spark, str(tmp_path))
    got = {r["run_id"]: (r["sweep"], r["status"]) for r in read.collect()}
    assert got == {f"run_{i}": (runs.NO_SWEEP if s is None else s, "complete") for i, s in enumerate(names)}
    assert {r["n_runs"] for r in runs.sweep_report(read).collect()} == {1}
