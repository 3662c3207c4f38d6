"""Fits from sums against MLlib's fits on the rows themselves."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import FMRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabflow.operators import models as M
from tabflow.operators import sums as S


def _rows(spark, n=300):
    rng = random.Random(3)
    rows = [(rng.uniform(0, 50), rng.choice([0.0, 0.1, 0.2]), 7.0, rng.gauss(0, 1)) for _ in range(n)]
    return spark.createDataFrame([(*r, 3 * r[0] + 100 * r[1] + r[0] * r[3]) for r in rows], "a double, b double, c double, e double, y double")


@pytest.mark.parametrize("more", [{}, {"fitLinear": False}, {"fitIntercept": False}, {"tol": 0.3, "stepSize": 0.1}])
def test_fm_from_sums_is_mllibs(spark, more):
    ready = M.prepare_train(_rows(spark), ["a", "b", "c", "e"], "y", "regression")
    est = FMRegressor(featuresCol="features_s", labelCol="y", seed=42, maxIter=12, **{"stepSize": 0.01, **more})
    apply = S.fit_fm(est, ready.rows, ["_f_a", "_f_b", "_f_c", "_f_e"], "y")
    scaled = StandardScaler(inputCol="features", outputCol="features_s", withMean=True, withStd=True).fit(ready.rows).transform(ready.rows)
    want = [r.prediction for r in est.fit(scaled).transform(scaled).collect()]
    assert [r.prediction for r in apply(ready.rows).collect()] == pytest.approx(want, rel=1e-7, abs=1e-7)


def test_fm_passes_do_not_grow_with_iterations(spark, monkeypatch):
    def on_rows(self, dataset, params=None):
        assert dataset.count() < 2, "an iteration over the train rows"
        return fit(self, dataset, params)

    fit = FMRegressor.fit
    monkeypatch.setattr(FMRegressor, "fit", on_rows)
    d = _rows(spark)
    got = M.run_candidates(spark, d, d, ["a", "b", "e"], "y", "regression", ["factorization_machine"]).collect()
    assert {r.status for r in got} == {"success"}, got


def test_fm_with_a_null_target_fails_as_before(spark):
    d = _rows(spark).unionByName(spark.createDataFrame([(1.0, 0.1, 7.0, 0.0, None)], "a double, b double, c double, e double, y double"))
    got = M.run_candidates(spark, d, d, ["a", "b", "e"], "y", "regression", ["factorization_machine"]).collect()
    assert [r.status for r in got] == ["failed"] and "Null" in got[0].error


def _boost(est, d, y):
    ready = M.prepare_train(d, ["a", "b", "c"], y, "regression")
    apply = S.fit_boosted(est, ready.rows, ["_f_a", "_f_b", "_f_c"], y, isinstance(est, GBTClassifier))
    want = est.fit(ready.rows).transform(ready.rows)
    return [r.prediction for r in apply(ready.rows).collect()], [r.prediction for r in want.collect()]


def _stepped(spark):
    """Few values per feature: MLlib's bounds and those of the cells are the same."""
    return _rows(spark).withColumn("a", F.floor("a")).where("a < 30").withColumn("z", (F.col("y") > 80).cast("double"))


def test_boosted_cells_are_boosted_rows(spark):
    d = _stepped(spark)
    got, want = _boost(GBTRegressor(featuresCol="features", labelCol="y", seed=42, maxIter=4), d, "y")
    assert got == pytest.approx(want, rel=1e-9)
    got, want = _boost(GBTClassifier(featuresCol="features", labelCol="z", seed=42, maxIter=3), d, "z")
    assert got == want and len(set(got)) == 2


def test_boosting_reads_cells_not_rows(spark, monkeypatch):
    def on_cells(self, dataset, params=None):
        assert dataset.count() <= 33 * 3, "trees are grown on rows"
        return fit(self, dataset, params)

    fit = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", on_cells)
    d = _rows(spark, 2000)
    got = M.run_candidates(spark, d, d, ["a", "b"], "y", "regression", ["gradient_boosting"]).collect()
    assert {r.status for r in got} == {"success"} and {r.metric: r.value for r in got}["r2"] > 0.5, got


def test_more_cells_than_allowed_are_fitted_on_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_CELLS", 5)
    est = GBTRegressor(featuresCol="features", labelCol="y", seed=42, maxIter=2)
    ready = M.prepare_train(_rows(spark), ["a", "b"], "y", "regression")
    assert S.fit_boosted(est, ready.rows, ["_f_a", "_f_b"], "y", False) is None


def test_bounds_are_nearest_to_equal_shares():
    assert S._between([1.0, 2.0, 3.0], None, 4) == [1.5, 2.5]
    assert S._between([float(x) for x in range(1, 6)], [10, 10, 10, 10, 10], 2) == [3.5]  # of two as near, the later
    assert S._between([float(x) for x in range(1, 51)], [100] * 50, 32)[:5] == [2.5, 3.5, 5.5, 6.5, 8.5]


def _grown(est, d, y, classes, weight=None):
    ready = M.prepare_train(d, ["a", "b", "c"], y, "regression", weight)
    out = S.fit_forest(est, ready.rows, ["_f_a", "_f_b", "_f_c"], y, classes)(ready.rows)
    want = est.fit(ready.rows).transform(ready.rows)
    if not classes:
        return [np.array([r.prediction for r in x.collect()]) for x in (out, want)]
    want = want.withColumn("probability", vector_to_array("probability"))
    return [(np.array([r.probability for r in x]), np.array([r.prediction for r in x])) for x in (out.collect(), want.collect())]


def test_forest_on_cells_is_mllibs_but_for_its_draws(spark):
    d = _stepped(spark)
    est = RandomForestRegressor(featuresCol="features", labelCol="y", seed=42, numTrees=400, maxDepth=4)
    got, want = _grown(est, d, "y", 0)
    assert np.abs(got - want).mean() < 0.2 * want.std() and np.corrcoef(got, want)[0, 1] > 0.99
    three = d.withColumn("z", F.when(F.col("y") > 100, 2.0).when(F.col("y") > 50, 1.0).otherwise(0.0)).withColumn("w", F.when(F.col("z") == 1, 3.0).otherwise(0.5))
    for weight in (None, "w"):
        est = RandomForestClassifier(featuresCol="features", labelCol="z", seed=42, numTrees=400, maxDepth=4, **({"weightCol": weight} if weight else {}))
        (p, said), (q, told) = _grown(est, three, "z", 3, weight)
        assert np.abs(p - q).mean() < 0.03 and np.abs(p.sum(1) - 1).max() < 1e-9 and (said == told).mean() > 0.95


@pytest.mark.parametrize("task,y", [("regression", "y"), ("classification", "z")])
def test_forest_reads_rows_once_for_all_trees(spark, monkeypatch, task, y):
    def on_rows(self, dataset, params=None):
        raise AssertionError("trees are grown on rows")

    monkeypatch.setattr(RandomForestRegressor, "fit", on_rows)
    monkeypatch.setattr(RandomForestClassifier, "fit", on_rows)
    d = _rows(spark, 2000).withColumn("z", (F.col("y") > 80).cast("int"))
    runs = []
    for sums in (S.TASK_SUMS, 5000):  # many passed on at once, or a few cells at a time
        monkeypatch.setattr(S, "TASK_SUMS", sums)
        got = M.run_candidates(spark, d, d, ["a", "b"], y, task, ["random_forest"]).collect()
        assert {r.status for r in got} == {"success"}, got
        runs.append({r.metric: r.value for r in got})
    assert runs[0] == pytest.approx(runs[1], rel=1e-6)
    assert runs[0].get("r2", 1) > 0.5 and runs[0].get("accuracy", 1) > 0.8


def test_forests_beyond_cells_are_fitted_on_rows(spark, monkeypatch):
    ready = M.prepare_train(_rows(spark), ["a", "b"], "y", "regression")
    for more in ({"numTrees": 1}, {"bootstrap": False}, {"maxDepth": 20}, {"subsamplingRate": 0.5}, {"featureSubsetStrategy": "all"}):
        assert S.fit_forest(RandomForestRegressor(featuresCol="features", labelCol="y", **more), ready.rows, ["_f_a", "_f_b"], "y", 0) is None
    monkeypatch.setattr(S, "MAX_CELLS", 5)
    assert S.fit_forest(RandomForestRegressor(featuresCol="features", labelCol="y"), ready.rows, ["_f_a", "_f_b"], "y", 0) is None


def test_forest_with_a_null_target_fails_as_before(spark):
    d = _rows(spark).unionByName(spark.createDataFrame([(1.0, 0.1, 7.0, 0.0, None)], "a double, b double, c double, e double, y double"))
    got = M.run_candidates(spark, d, d, ["a", "b"], "y", "regression", ["random_forest"]).collect()
    assert [r.status for r in got] == ["failed"] and "Null" in got[0].error


def test_neural_network_passes_have_few_tasks(spark, monkeypatch):
    fit, seen = M.MultilayerPerceptronClassifier.fit, []

    def on_few(self, dataset, params=None):
        seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
        return fit(self.copy({self.maxIter: 2}), dataset, params)

    monkeypatch.setattr(M.MultilayerPerceptronClassifier, "fit", on_few)
    d = _rows(spark).withColumn("z", (F.col("y") > 80).cast("int")).repartition(40)
    got = M.run_candidates(spark, d, d, ["a", "b"], "z", "classification", ["neural_network"]).collect()
    assert seen == [(max(5, spark.sparkContext.defaultParallelism), 300)] and {r.status for r in got} == {"success"}, (seen, got)
