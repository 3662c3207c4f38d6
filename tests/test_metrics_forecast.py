"""Metrics with hand-computed values, brute-force AUC/AP, forecasters and Holt."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.operators import forecast as R
from tabflow.operators import leaderboard as L
from tabflow.operators import metrics as V


def test_regression_metrics_known(spark):
    df = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "label double, prediction double")
    r = V.regression_metrics(df).first()
    assert r["mae"] == pytest.approx(0.5) and r["rmse"] == pytest.approx(0.6123724, rel=1e-6)


def test_mape_null_with_zero(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (2.0, 2.0)], "label double, prediction double")
    assert V.regression_metrics(df).first()["mape"] is None


def test_mase_perfect_and_constant(spark):
    base = dt.date(2024, 1, 1)
    tr = spark.createDataFrame([("a", base + dt.timedelta(days=i), float(i + 1)) for i in range(29)],
                               "e string, ds date, y double")
    te = spark.createDataFrame([("a", base + dt.timedelta(days=30), 31.0, 31.0)],
                               "e string, ds date, y double, prediction double")
    assert V.mase(tr, te, ["e"], "ds", period=1).first()["mase"] == 0.0
    flat = tr.withColumn("y", F.lit(5.0))
    assert V.mase(flat, te, ["e"], "ds", period=1).first()["mase"] is None


def _auc_brute(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(y, s):
    thr = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in thr:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auc_and_ap_match_brute_force(spark):
    rnd = random.Random(9)
    rows = [(int(rnd.random() < 0.4), round(rnd.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, score double")
    y, s = zip(*rows)
    assert V.roc_auc_binary(df, "label", "score").first()["roc_auc"] == pytest.approx(_auc_brute(y, s))
    assert V.average_precision(df, "label", "score").first()["pr_auc"] == pytest.approx(_ap_brute(y, s))


def test_confusion_includes_zero_cells(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "label string, prediction string")
    cm = {(r["actual"], r["predicted"]): r["count"] for r in V.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[("b", "a")] == 1 and cm[("b", "b")] == 0


def test_weighted_prf_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "label int, prediction int")
    r = V.weighted_prf(df).first()
    assert r["precision"] == pytest.approx((1 / 3) * (1 / 3))  # class 1 precision 0 (zero division)


def _holt_ref(y, a, b):
    l, t = y[0], y[1] - y[0]
    sse = 0.0
    for v in y[1:]:
        fc = l + t
        sse += (v - fc) ** 2
        nl = a * v + (1 - a) * (l + t)
        t = b * (nl - l) + (1 - b) * t
        l = nl
    return l, t, sse


@pytest.mark.parametrize("size", [None, 10, 7, 1])
def test_holt_matches_sequential_recursion(spark, size):
    base = dt.date(2024, 1, 1)
    rnd = random.Random(2)
    y = [100 + 2 * i + 10 * math.sin(i) + rnd.gauss(0, 3) for i in range(120)]
    tr = spark.createDataFrame([("s", base + dt.timedelta(days=i), v) for i, v in enumerate(y)],
                               "entity string, ds date, y double")
    te = spark.createDataFrame([("s", base + dt.timedelta(days=120 + h), 0.0) for h in range(3)],
                               "entity string, ds date, y double")
    got = sorted((r["h"], r["prediction"]) for r in R.holt(tr, te, "entity", "ds", slice_rows=size).collect())
    best = min(((a, b) for a in R.HOLT_ALPHAS for b in R.HOLT_BETAS), key=lambda p: (_holt_ref(y, *p)[2], p))
    l, t, _ = _holt_ref(y, *best)
    assert [p for _, p in got] == pytest.approx([l + h * t for h in (1, 2, 3)], rel=1e-9)


def test_holt_of_short_and_null_series_and_any_names(spark):
    base = dt.date(2024, 1, 1)
    data = {"one": [5.0], "two": [5.0, 7.0], None: [1.0, 2.0, 3.0, 4.0, 5.0], "gap": [3.0, None, 3.0]}
    tr = spark.createDataFrame([(e, base + dt.timedelta(days=i), v) for e, ys in data.items() for i, v in enumerate(ys)], "`e.x` string, `d s` date, `_l` double")
    te = spark.createDataFrame([(e, base + dt.timedelta(days=30), 0.0) for e in [*data, "unseen"]], "`e.x` string, `d s` date, `_l` double")
    got = {r["e.x"]: r["prediction"] for r in R.holt(tr, te, "e.x", "d s", "_l", slice_rows=2).collect()}
    assert got["one"] == 5.0 and got["unseen"] is None and got["gap"] == pytest.approx(3.0)
    assert got["two"] == pytest.approx(9.0) and got[None] == pytest.approx(6.0)


def test_holt_runs_no_python_on_executors(spark, monkeypatch):
    base = dt.date(2024, 1, 1)
    tr = spark.createDataFrame([("s", base + dt.timedelta(days=i), float(i % 5)) for i in range(40)], "entity string, ds date, y double")
    out = R.holt(tr, tr, "entity", "ds", slice_rows=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_seasonal_naive_tiles_last_week(spark):
    base = dt.date(2024, 1, 1)
    tr = spark.createDataFrame([("s", base + dt.timedelta(days=i), float(i)) for i in range(14)],
                               "entity string, ds date, y double")
    te = spark.createDataFrame([("s", base + dt.timedelta(days=14 + h), 0.0) for h in range(9)],
                               "entity string, ds date, y double")
    got = [r["prediction"] for r in R.seasonal_naive(tr, te, "entity", "ds").orderBy("ds").collect()]
    assert got == [7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 7.0, 8.0]


def test_leaderboard_keeps_failures_unranked(spark):
    rows = [("r", 1, "m1", "success", "rmse", 2.0, None, 0.0), ("r", 1, "m2", "success", "rmse", 1.0, None, 0.0),
            ("r", 1, "m3", "failed", None, None, "boom", 0.0)]
    res = spark.createDataFrame(rows, "run_id string, cycle int, model string, status string, metric string, "
                                      "value double, error string, train_seconds double")
    prim = L.primary_metric(res, "regression")
    lb = {r["model"]: (r["rank"], r["is_winner"]) for r in L.leaderboard(res, prim).collect()}
    assert lb == {"m2": (1, True), "m1": (2, False), "m3": (None, False)}


def test_decomposition_finds_trend_and_season(spark):
    base = dt.date(2024, 1, 1)
    rows = [(base + dt.timedelta(days=i), 100 + 50 * i / 69 + 15 * np.sin(2 * np.pi * i / 7)) for i in range(70)]
    df = spark.createDataFrame([(d, float(v)) for d, v in rows], "ds date, y double")
    from tabflow.operators.eda import decomposition_strength
    r = decomposition_strength(df, "ds", "y").first()
    assert r["trend_strength"] > 0.9 and r["seasonal_strength"] > 0.9


def test_entity_cap_keeps_largest_entities(spark):
    from tabflow.operators import forecast as FC
    rows = [(e, i) for e, n in [("a", 30), ("b", 12), ("c", 50), ("d", 3), ("e", 30)] for i in range(n)]
    df = spark.createDataFrame(rows, "e string, i int")
    got = {r["e"]: r["skip_reason"] for r in FC.entity_eligibility(df, "e", "i", max_entities=2).collect()}
    assert got == {"a": None, "b": "entity_cap", "c": None, "d": "too_few_rows", "e": "entity_cap"}
