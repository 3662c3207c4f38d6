"""Per-entity models on several features, eligibility and the listing of skips."""

import datetime as dt
import random

import numpy as np
import pytest

from tabflow.operators import forecast as R


def test_grouped_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 80), (None, 30), ("b", 12)):
        x = rng.normal(size=(n, 4)) * [1, 100, 0.01, 1] + [0, 1e4, 5, 0]
        for v in x:
            rows.append((g, *map(float, v), float(3 + v @ [1, -2, 50, 0.5] + rng.normal())))
    rows += [("a", None, 1.0, 1.0, 1.0, 5.0), ("a", 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "`g.x` string, a double, b double, `c d` double, e double, y double")
    names = ["a", "b", "c d", "e"]
    for r in R.grouped_least_squares(df, ["g.x"], names, "y").collect():
        mine = np.array([t[1:] for t in rows if t[0] == r["g.x"] and None not in t[1:]], float)
        want = np.linalg.lstsq(np.c_[np.ones(len(mine)), mine[:, :4]], mine[:, 4], rcond=None)[0]
        assert r["n"] == len(mine)
        assert [r["intercept"], *r["beta"]] == pytest.approx(want, rel=1e-6)


def test_collinear_and_constant_features_get_zero(spark):
    rows = [(float(i), 2.0 * i, 7.0, float(i * i % 5), 1.0 + 3 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double")
    r = R.grouped_least_squares(df, [], ["a", "b", "c", "d"], "y").first()
    assert r["beta"] == pytest.approx([3, 0, 0, 0], abs=1e-9) and r["intercept"] == pytest.approx(1)


def test_pipeline_lists_every_entity_once_per_model_or_as_skipped(spark):
    rng = random.Random(1)
    base = dt.date(2024, 1, 1)
    rows = [(e, base + dt.timedelta(days=i), float(i % 7), 10.0 + 2 * (i % 7) + rng.random()) for e, n in (("big", 60), (None, 40), ("small", 6)) for i in range(n)]
    rows += [("small", base, 0.0, None)] * 20  # rows without y do not count
    df = spark.createDataFrame(rows, "store string, ds date, dow double, sales double")
    got = {(r["store"], r["model"]): r for r in R.per_entity_pipeline(df, "store", "ds", "sales", ["dow"]).collect()}
    assert got[("small", None)]["status"] == "skipped" and got[("small", None)]["skip_reason"] == "too_few_rows"
    assert got[("small", None)]["n_train"] == 4
    names = set(R.PER_ENTITY_MODELS) | {"linear_regression"}
    for e in ("big", None):
        assert {m for s, m in got if s == e} == names
        assert all(got[(e, m)]["status"] == "success" for m in names)
        assert got[(e, "linear_regression")]["rmse"] < 0.5 < got[(e, "naive")]["rmse"]
    assert len(got) == 2 * len(names) + 1
    only = R.per_entity_pipeline(df, "store", "ds", "sales", models=["naive"], max_entities=1).collect()
    assert sorted((r["store"] or "", r["status"], r["skip_reason"]) for r in only) == [
        ("", "skipped", "entity_cap"), ("big", "success", None), ("small", "skipped", "too_few_rows")]
    assert R.per_entity_pipeline(df.where("false"), "store", "ds", "sales", ["dow"]).count() == 0
