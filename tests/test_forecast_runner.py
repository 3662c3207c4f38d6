"""The forecasting runner, lag regressions and the full snapshot."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabflow.operators import eda as E
from tabflow.operators import forecast as R


def series(spark, n=80):
    base = dt.date(2024, 1, 1)
    return spark.createDataFrame([(e, base + dt.timedelta(days=i), float(k + 3 * (i % 7) + 0.5 * i)) for k, e in enumerate(["a", "b"]) for i in range(n)],
                                 "store string, ds date, sales double")


def test_runner_scores_every_forecaster_and_keeps_failures(spark, monkeypatch):
    d = series(spark)
    cut = dt.date(2024, 3, 1)
    train, test = d.where(F.col("ds") < F.lit(cut)), d.where(F.col("ds") >= F.lit(cut))
    monkeypatch.setitem(R.PER_ENTITY_MODELS, "broken", lambda *a: 1 / 0)
    rows = R.run_forecasters(train, test, "store", "ds", "sales", ["naive", "seasonal_ar", "broken"]).collect()
    got = {(r["model"], r["metric"]): r["value"] for r in rows}
    assert {m for n, m in got if n == "naive"} == {"mae", "rmse", "smape", "mase"}
    assert got[("seasonal_ar", "mase")] < got[("naive", "mase")]
    naive = {e: 3 * (59 % 7) + 0.5 * 59 for e in "ab"}["a"]
    want = [abs(naive - (3 * (i % 7) + 0.5 * i)) for i in range(60, 80)]
    assert got[("naive", "mae")] == pytest.approx(sum(want) / 20) and got[("naive", "mase")] == pytest.approx(sum(want) / 20 / 3.5)
    bad = [r for r in rows if r["model"] == "broken"]
    assert len(bad) == 1 and bad[0]["status"] == "failed" and "ZeroDivisionError" in bad[0]["error"]


def test_lag_regressions_learn_a_weekly_series(spark):
    d = series(spark)
    split = d.withColumn("split", F.when(F.col("ds") < F.lit("2024-03-05").cast("date"), "train").otherwise("test"))
    pred = R.regression_forecast(split, "store", "ds", "sales")
    assert pred.count() == 2 * 16 and pred.agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 1.0
    pred, h = R.global_forecast(d.unionByName(spark.createDataFrame([(None, dt.date(2024, 1, 1), 1.0)], d.schema)), "store", "ds", "sales", "linear_regression")
    assert h == 16 and pred.count() == 32 and pred.agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 1.0


def test_full_snapshot_covers_every_kind(spark):
    df = spark.createDataFrame([(i, float(i % 4), i % 3 == 0, dt.date(2024, 1, 1 + i % 5), "abc"[i % 3], f"{i}", f"a long text about item number {i}", None)
                                for i in range(20)], "id long, `x.y` double, b boolean, d date, c string, n string, t string, none string")
    got = {(r["section"], r["column"], r["item"]): (r["value"], r["text"]) for r in E.full_snapshot(df).collect()}
    at = lambda *k: got[k][0]
    assert at("table", None, "row_count") == 20 and at("table", None, "missing_cell_pct") == 12.5
    assert [at("table", None, f"type:{k}") for k in E.KINDS] == [3, 2, 1, 1, 1]
    assert at("stats", "x.y", "zeros_pct") == 25 and at("stats", "n", "max") == 19 and at("stats", "b", "true_count") == 7
    assert at("stats", "d", "distinct_days") == 5 and at("stats", "t", "vocab_size") == 26 and got[("stats", "c", "top:1")] == (7.0, "a")
    assert sum(v for (s, c, _), (v, _) in got.items() if s == "histogram" and c == "id") == 20
    assert at("correlation", "id", "n") == 1.0 and got[("column", "t", "kind")][1] == "text"
    assert all(v is not None for (s, _, i), (v, _) in got.items() if s == "table")
