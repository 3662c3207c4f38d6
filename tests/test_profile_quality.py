"""Literal frames with known answers for profile and quality rules."""

import random

from pyspark.sql import functions as F

from tabflow.operators import profile as P
from tabflow.operators import quality as Q


def _issues(df, **kw):
    return {(r["column"], r["issue_type"]): r for r in Q.quality_issues(df, **kw).collect()}


def test_duplicates_counted(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "z")], "a int, b string")
    r = P.duplicate_rows(df).first()
    assert r["duplicate_row_count"] == 1 and r["duplicate_row_pct"] == 25.0


def test_one_extreme_value_is_one_outlier(spark):
    vals = [10.0 + 0.1 * i for i in range(40)] + [10000.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = Q.outlier_counts(df, ["x"]).first()
    assert out["outlier_count"] == 1


def test_numeric_text_is_invalid_dtype(spark):
    df = spark.createDataFrame([(str(i % 5 + 1),) for i in range(25)], "v string")
    assert ("v", "invalid_dtype") in _issues(df)


def test_id_like_column(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id int, g int")
    iss = _issues(df)
    assert ("id", "id_like_column") in iss and ("g", "id_like_column") not in iss


def test_name_leakage_exempts_target(spark):
    df = spark.createDataFrame([(i, i % 2, i % 3) for i in range(30)], "x int, target int, target_leak int")
    iss = _issues(df, likely_target="target")
    assert ("target_leak", "possible_leakage") in iss
    assert ("target", "possible_leakage") not in iss


def test_correlated_pair(spark):
    rnd = random.Random(1)
    rows = [(float(i), 2.0 * i + 1e-9, rnd.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    pairs = {(r["column"], r["other_column"]) for r in Q.correlated_pairs(df, ["a", "b", "c"]).collect()}
    assert pairs == {("a", "b")}


def test_sentinel_zero(spark):
    rnd = random.Random(3)
    vals = [rnd.gauss(120, 20) for _ in range(92)] + [0.0] * 8
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = Q.sentinel_candidates(df, ["x"]).first()
    assert s["value"] == 0.0 and s["count"] == 8
    assert P.missing_counts(df).first()["missing_count"] == 0


def test_clean_table_scores_100(spark):
    rows = [(a, b, c) for a in range(3) for b in range(2) for c in range(10)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    issues = Q.quality_issues(df)
    assert issues.count() == 0
    assert Q.quality_score(issues).first()["quality_score"] == 100.0


def test_empty_table_scores_0(spark):
    df = spark.createDataFrame([], "a int, b string")
    issues = Q.quality_issues(df)
    rows = issues.collect()
    assert len(rows) == 1 and rows[0]["issue_type"] == "empty_dataset"
    assert Q.quality_score(issues).first()["quality_score"] == 0.0


def test_kinds_order(spark):
    df = spark.createDataFrame([(True, "2023-01-0" + str(i % 9 + 1), 1.0, "a", "x" * 30) for i in range(10)],
                               "b boolean, d string, n double, c string, t string")
    kinds = {r["column"]: r["kind"] for r in P.column_kinds(df).collect()}
    assert kinds == {"b": "boolean", "d": "datetime", "n": "numerical", "c": "categorical", "t": "text"}


def test_near_constant(spark):
    df = spark.createDataFrame([(0 if i < 199 else 1,) for i in range(200)], "x int")
    p = P.column_profile(df).first()
    assert p["is_near_constant"] and not p["is_constant"]


def test_numeric_stats_single_row_std_zero(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    assert P.numeric_stats(df).first()["std"] == 0.0


def test_text_top_tokens_case_folded(spark):
    df = spark.createDataFrame([("Free offer FREE",), ("don't stop",)], "t string")
    stats, top = P.text_stats(df, ["t"])
    tokens = {r["token"]: r["count"] for r in top.collect()}
    assert tokens["free"] == 2 and tokens["don't"] == 1
    assert stats.first()["vocab_size"] == 4


def test_nan_is_missing(spark):
    from tabflow.sources.tables import nan_to_null
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"))
    assert P.missing_counts(df).first()["missing_count"] == 1
    assert df.agg(F.avg("x")).first()[0] == 1.0
