"""Statistics that must stay cheap per row: small generated methods, native distinct values, correlations pair by pair."""

import math

from tabflow.functions import quantiles as Q
from tabflow.operators import profile as P
from tabflow.operators import quality as D


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_key_is_short(spark):
    key = Q.with_order_key(spark.createDataFrame([(1.5,)], "value double"))
    assert plan(key).count("POWER(") + plan(key).count("pow(") <= 1 and len(plan(key)) < 2500


def test_distinct_counts_do_not_write_numbers_out(spark):
    rows = [(1 << 60, 0.0, "a", None, True), ((1 << 60) + 1, -0.0, "a", None, False), (None, math.nan, "", None, True),
            (7, 1e300, "0.0", None, None), (7, 0.0, None, None, True)]
    df = spark.createDataFrame(rows, "`a.b` bigint, d double, s string, n int, t boolean")
    got = {r["column"]: (r["distinct_count"], r["top_count"]) for r in P.distinct_counts(df).collect()}
    text = {}
    for r in P.value_counts(df).collect():
        n, top = text.get(r["column"], (0, 0))
        text[r["column"]] = (n + 1, max(top, r["count"]))
    assert got == {"n": (0, None), **text} and got["d"] == (4, 2) and got["a.b"] == (3, 2)
    assert "as string" not in plan(P.native_counts(df.select("`a.b`")))


def test_correlations_are_aggregated_pair_by_pair(spark):
    rows = [(float(i), 2.0 * i + 1, 5.0, None if i % 3 else float(-i)) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, `d.e` double")
    got = {(r["column"], r["other_column"]): round(r["r"], 9) for r in D.correlated_pairs(df, df.columns).collect()}
    assert got == {("a", "b"): 1.0, ("a", "d.e"): -1.0, ("b", "d.e"): -1.0}
    assert plan(D.correlated_pairs(df, df.columns)).count("covar_pop(") == 1
    assert D.correlated_pairs(df, ["a"]).count() == 0
