"""Failure summaries, run records and checked recommendations."""

import json

from tabflow.operators import leaderboard as L
from tabflow.operators.quality import ISSUE_SCHEMA
from tabflow.sources.runs import build_record

RESULTS = "run_id string, cycle int, model string, status string, metric string, value double, error string, train_seconds double"


def results(spark):
    return spark.createDataFrame([("r", 1, "a", "success", "f1", 0.8, None, 1.0), ("r", 1, "a", "success", "accuracy", 0.7, None, 1.0),
                                  ("r", 1, "b", "success", "f1", 0.6, None, 1.0), ("r", 1, "c", "failed", None, None, "ValueError: nan", 1.0)], RESULTS)


def board(spark):
    prim = L.primary_metric(results(spark), "classification", ["f1"])
    return L.leaderboard(results(spark), prim)


def issue(kind, col=None, other=None, severity="high"):
    return (col, other, kind, severity, None, None, None)


def test_suitability_follows_the_dataset_not_the_failures(spark):
    res = results(spark)
    frame = lambda rows: spark.createDataFrame(rows, ISSUE_SCHEMA)
    word = lambda issues, n=None: L.failure_summary(res, issues, n).first()
    assert word(None)["suitability"] == "suitable" and word(None)["n_failed"] == 1
    assert word(None, 0)["suitability"] == "not_suitable"
    some = frame([issue("missing_values", f"c{i}") for i in range(12)] + [issue("possible_leakage", "x", "y"), issue("possible_leakage", "y")])
    r = word(some, 3)
    assert r["suitability"] == "suitable_with_warnings" and r["dataset_issues"] == "low_quality_score,missing_values,possible_leakage"
    rows = {d["category"]: d for d in L.dataset_issues(some).collect()}
    assert rows["missing_values"]["n_columns"] == 12 and rows["missing_values"]["columns"].count(",") == 9
    assert rows["possible_leakage"]["columns"] == "x, y" and rows["low_quality_score"]["value"] == 0.0
    assert word(frame([issue("empty_dataset")]))["suitability"] == "not_suitable"
    assert word(frame([]))["dataset_issues"] == ""


def test_record_status_and_errors(spark):
    data = spark.createDataFrame([(1, None), (2, "x")], "k int, `a.b` string")
    one = lambda **kw: build_record(results(spark), board(spark), **kw).first()
    r = one(data=data, config={"target": "y"})
    assert r["status"] == "complete" and r["winner"] == "a" and r["n_candidates"] == 3 and r["errors"] == ["c: ValueError: nan"]
    assert (r["dataset_rows"], r["dataset_columns"], json.loads(r["config"])) == (2, 2, {"target": "y"}) and "pyspark" in r["library_versions"]
    again = one(data=data.orderBy("k", ascending=False))
    assert again["dataset_fingerprint"] == r["dataset_fingerprint"] and again["dataset_rows"] == 2
    assert one(error="boom")["status"] == "error" and one(error="boom")["errors"][-1] == "boom"
    assert one(needs_clarification=True)["status"] == "needs_clarification"
    assert one(error="stop", status="cancelled")["status"] == "cancelled"


def test_every_statement_is_checked_against_the_winner(spark):
    said = [("recommended_model", "b", None), ("metric", "f1", 0.8004), ("metric", "accuracy", 0.75), ("metric", "recall", 0.1),
            ("feature", "x", None), ("feature", "y", None), ("alternative", "b", None), ("alternative", "ghost", None), ("flag", " ", None), ("flag", "small", None)]
    claims = spark.createDataFrame([("r", *s) for s in said], "run_id string, kind string, name string, claimed double")
    imp = spark.createDataFrame([("a", "x"), ("b", "y")], "model string, feature string")
    got = {(r["kind"], r["name"]): (r["verdict"], r["kept"]) for r in L.check_recommendation(claims, results(spark), board(spark), imp).collect()}
    assert got == {("recommended_model", "a"): ("overridden", True), ("metric", "f1"): ("verified", True), ("metric", "accuracy"): ("mismatch", False),
                   ("metric", "recall"): ("unknown_metric", False), ("feature", "x"): ("verified", True), ("feature", "y"): ("not_important", False),
                   ("alternative", "b"): ("verified", True), ("alternative", "ghost"): ("unknown_model", False), ("flag", " "): ("no_reason", False),
                   ("flag", "small"): ("flagged", True)}
    none = L.check_recommendation(claims.where("kind = 'feature'"), results(spark), board(spark), imp.limit(0)).collect()
    assert {r["verdict"] for r in none} == {"unverifiable"}
