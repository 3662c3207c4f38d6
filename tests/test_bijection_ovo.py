"""Keyed bijections, permutation importance and one-vs-one AUC against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tabflow.operators import explain as X
from tabflow.operators import metrics as V


def places(spark, n, seed):
    return [r[0] for r in spark.range(n).orderBy("id").select(X.shuffled_position(F.col("id"), n, F.lit(seed)).alias("p")).collect()]


def test_positions_are_a_bijection_that_the_seed_decides(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(places(spark, n, 5)) == list(range(n))
    a, b = places(spark, 1000, 1), places(spark, 1000, 2)
    assert a != b and a == places(spark, 1000, 1)
    assert sum(x == i for i, x in enumerate(a)) < 10 and sum(abs(x - i) for i, x in enumerate(a)) / 1000 > 250


class Doubler:
    """A model that predicts 1 if x exceeds 0.5."""

    def transform(self, df):
        return df.withColumn("prediction", (F.col("x") > 0.5).cast("double"))


def test_importance_equals_the_drop_by_hand(spark):
    rng = random.Random(3)
    data = [(i, rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame([(i, x, z, float(x > 0.5)) for i, x, z in data], "id int, x double, z double, label_idx double")
    got = {r["feature"]: r for r in X.permutation_importance(Doubler(), df, ["x", "z"], "label_idx", ["id"], X.accuracy_score, repeats=3).collect()}
    drops = []
    for r in range(3):
        src = places(spark, 200, 42 + r)
        drops.append(1 - sum((data[src[i]][1] > 0.5) == (data[i][1] > 0.5) for i in range(200)) / 200)
    assert got["x"]["importance"] == pytest.approx(sum(drops) / 3) and got["z"]["importance"] == 0


def by_hand(rows, classes):
    """Mean over class pairs of the mean of both AUCs; rows are (label, {class: prob})."""
    out = []
    for i, a in enumerate(classes):
        for b in classes[i + 1:]:
            both = []
            for p, q in ((a, b), (b, a)):
                pos, neg = ([r[1][p] for r in rows if r[0] == c] for c in (p, q))
                if pos and neg:
                    both.append(sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / len(pos) / len(neg))
            if both:
                out.append(sum(both) / len(both))
    return sum(out) / len(out)


@pytest.mark.parametrize("k, n", [(2, 40), (4, 120)])
def test_one_vs_one_auc_equals_brute_force(spark, k, n):
    rng = random.Random(k)
    classes = [f"c{i}" for i in range(k)]
    rows = [(rng.choice(classes[:-1] if k > 2 else classes), {c: round(rng.random(), 1) for c in classes}) for _ in range(n)]
    long = spark.createDataFrame([(i, lab, c, p) for i, (lab, ps) in enumerate(rows) for c, p in ps.items()], "key int, label string, class string, prob double")
    assert V.roc_auc_ovo(long, "key").first()["roc_auc_ovo"] == pytest.approx(by_hand(rows, classes))


def test_a_thousand_classes_without_broadcast_or_pair_rows(spark):
    long = spark.range(3_000).select(F.col("id").alias("key"), (F.col("id") % 1000).cast("string").alias("label"),
                                     F.explode(F.sequence(F.lit(0), F.lit(999), F.lit(37))).alias("c"))
    long = long.select("key", "label", F.col("c").cast("string").alias("class"), (F.col("c") == F.col("label").cast("int")).cast("double").alias("prob"))
    out = V.roc_auc_ovo(long, "key")
    assert out.first()["roc_auc_ovo"] == 1.0
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
