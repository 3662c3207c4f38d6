"""Calibrated support vector machines, pairwise coupling and parameter search."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tabflow.operators import models as M

SVM = M.REGISTRY[("classification", "svm")]


def blobs(n, seed, classes, spread):
    rng = random.Random(seed)
    centres = {"a": (0, 0), "b": (2, 0), "c": (0, 2)}
    out = []
    for i in range(n):
        c = rng.choices(classes, [3, 1, 2][:len(classes)])[0]
        x, y = centres[c]
        out.append((i, rng.gauss(x, spread), 10 * rng.gauss(y, spread), c))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, x double, y double, c string")


def test_calibrated_probabilities_beat_raw_margins_by_brier_score(spark):
    tr, te = frame(spark, blobs(500, 1, "ab", 1.3)), frame(spark, blobs(600, 2, "ab", 1.3))
    brier = {}
    for cal in (True, False):
        pred = M.fit_predict(SVM, tr, te, ["x", "y"], "c", "classification", {"calibrate": cal})
        brier[cal] = pred.agg(F.avg((F.col("prob_pos") - (F.col("label") == "b").cast("double")) ** 2)).first()[0]
        assert pred.where("prob_pos < 0 or prob_pos > 1 or prob_pos is null").count() == 0
        metrics = {r["metric"]: r["value"] for r in M.score_predictions(pred, "classification", ["a", "b"]).collect()}
        assert metrics["roc_auc"] > 0.8
    assert brier[True] <= brier[False]


def test_coupled_probabilities_of_three_classes(spark):
    tr, te = frame(spark, blobs(400, 3, "abc", 0.4)), frame(spark, blobs(200, 4, "abc", 0.4))
    pred = M.fit_predict(SVM, tr, te, ["x", "y"], "c", "classification")
    rows = pred.collect()
    assert all(len(r["probability"]) == 3 and sum(r["probability"]) == pytest.approx(1) for r in rows)
    assert all(r["prediction"] == "abc"[max(range(3), key=lambda i: r["probability"][i])] for r in rows)
    assert sum(r["label"] == r["prediction"] for r in rows) >= 0.95 * len(rows)


def test_calibration_of_tiny_classes_and_one_class(spark):
    few = frame(spark, [(i, float(i % 5), float(i), "a" if i < 20 else "b") for i in range(24)])
    assert M.fit_predict(SVM, few, few, ["x", "y"], "c", "classification").where("prob_pos is null").count() == 0
    one = frame(spark, [(i, float(i), 1.0, "a") for i in range(20)])
    assert {r["prediction"] for r in M.fit_predict(SVM, one, one, ["x", "y"], "c", "classification").collect()} == {"a"}


def test_tuning_tries_the_grid_in_order_and_its_best_is_refitted(spark, monkeypatch):
    rows = blobs(240, 5, "ab", 1.0)
    tr = frame(spark, rows).withColumn("fold", F.col("id") % 3)
    seen = []
    real = M.fit_predict
    monkeypatch.setattr(M, "fit_predict", lambda cand, a, b, f, y, t, p=None, *r: seen.append((p, b.count())) or real(cand, a, b, f, y, t, p, *r))
    cand = M.REGISTRY[("classification", "logistic_regression")]
    got = M.tune_model(tr, ["x", "y"], "c", "classification", cand, max_trials=3)
    assert got["status"] == "success" and got["trials"] == 3 and got["metric"] == "f1"
    assert [p for p, _ in seen[::3]] == [{"C": 0.1}, {"C": 0.1, "class_weight": "balanced"}, {"C": 1.0}]
    assert [n for _, n in seen[:3]] == [80, 80, 80] and got["params"] in [p for p, _ in seen]
    seen.clear()
    table, params = M.tune_models(tr, ["x", "y"], "c", "classification", ["baseline", "k_nearest_neighbors"])
    status = {r["model"]: r for r in table.collect()}
    assert status["baseline"]["status"] == "skipped" and json.loads(status["k_nearest_neighbors"]["params"])["k"] in (3, 5, 7)
    assert set(params) == {"k_nearest_neighbors"} and len(seen) == 9
    with pytest.raises(ValueError):
        M.tune_model(tr, ["x", "y"], "c", "classification", cand, metric="rmse")


def test_tuning_of_regression_is_by_error_and_failures_are_rows(spark):
    tr = spark.createDataFrame([(float(i), float(i % 7), 3.0 * (i % 7), i % 3) for i in range(90)], "a double, b double, y double, fold int")
    got = M.tune_model(tr, ["b"], "y", "regression", M.REGISTRY[("regression", "decision_tree")], space={"maxDepth": [1, 5]})
    assert got["params"] == {"maxDepth": 5} and math.isclose(got["score"], 0, abs_tol=1e-9)
    bad = M.tune_model(tr, ["gone"], "y", "regression", M.REGISTRY[("regression", "decision_tree")], space={"maxDepth": [1]})
    assert bad["status"] == "failed" and "gone" in bad["error"]
