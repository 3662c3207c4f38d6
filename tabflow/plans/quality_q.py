"""Registered queries for data quality (Q01–Q11)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabflow.operators import quality as Q
from tabflow.operators.profile import column_profile
from tabflow.plans.common import (LINEITEM_DERIVED, ORDERS_GAPS, PART_TEXT, SQL_NUMBER, lineitem_derived,
                                  orders_gaps, part_text, union_all)
from tabflow.plans.registry import query, table

COLS = "column, other_column, issue_type, severity, count, pct, value"


def _row(column, issue, severity, count="NULL", pct="NULL", value="NULL", other="NULL"):
    return (f"SELECT CAST({column} AS VARCHAR) AS \"column\", CAST({other} AS VARCHAR) AS other_column, "
            f"'{issue}' AS issue_type, {severity} AS severity, CAST({count} AS BIGINT) AS count, "
            f"CAST({pct} AS DOUBLE) AS pct, CAST({value} AS DOUBLE) AS value")


def sql_missing(src, cols):
    parts = []
    for c in cols:
        pct = f"round((count(*) - count({c})) * 100.0 / count(*), 2)"
        sev = f"CASE WHEN {pct} >= 30 THEN 'high' WHEN {pct} >= 5 THEN 'medium' ELSE 'low' END"
        parts.append(_row(f"'{c}'", "missing_values", sev, f"count(*) - count({c})", pct) +
                     f" FROM {src} HAVING count(*) - count({c}) > 0")
    return union_all(parts)


def sql_duplicates(src):
    d = f"(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})))"
    pct = f"round({d} * 100.0 / count(*), 2)"
    return (_row("NULL", "duplicate_rows", f"CASE WHEN {pct} >= 10 THEN 'high' ELSE 'medium' END", d, pct) +
            f" FROM {src} HAVING {d} > 0")


def _top_share(src, c):
    return f"(SELECT max(n) FROM (SELECT count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}))"


def sql_constant(src, cols):
    parts = []
    for c in cols:
        parts.append(_row(f"'{c}'", "constant_column", "'low'") + f" FROM {src} HAVING count(DISTINCT {c}) <= 1")
        parts.append(_row(f"'{c}'", "near_constant_column", "'low'") +
                     f" FROM {src} HAVING count(DISTINCT {c}) > 1 AND {_top_share(src, c)} / count({c}) >= 0.99")
    return union_all(parts)


def sql_outliers(src, cols):
    parts = []
    for c in cols:
        inner = f"""(SELECT count(x) AS n, count(*) FILTER (WHERE x < lo OR x > hi) AS cnt, q1, q3 FROM
  (SELECT CAST({c} AS DOUBLE) AS x FROM {src}),
  (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
     (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
      FROM {src})) GROUP BY q1, q3)"""
        pct = "round(cnt * 100.0 / n, 2)"
        parts.append(_row(f"'{c}'", "possible_outliers", f"CASE WHEN {pct} >= 5 THEN 'medium' ELSE 'low' END",
                          "cnt", pct) + f" FROM {inner} WHERE n >= 4 AND q3 <> q1 AND cnt > 0")
    return union_all(parts)


def sql_sentinel(src, cols):
    parts = []
    for c in cols:
        sides = []
        for side, agg in (("min", "min"), ("max", "max")):
            sides.append(f"""SELECT '{side}' AS side, v, count(*) AS n, count(*) FILTER (WHERE x = v) AS cnt,
  count(*) FILTER (WHERE x <> v) AS n_rest, avg(x) FILTER (WHERE x <> v) AS rest_mean,
  stddev_samp(x) FILTER (WHERE x <> v) AS rest_std
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL),
     (SELECT {agg}(CAST({c} AS DOUBLE)) AS v FROM {src}) GROUP BY v""")
        cand = f"""(SELECT side, v, cnt, round(cnt * 100.0 / n, 2) AS pct, abs(rest_mean - v) / rest_std AS z
  FROM ({union_all(sides)}) WHERE n >= 10 AND cnt >= 2 AND cnt * 1.0 / n < 0.5 AND n_rest >= 5
  AND rest_std IS NOT NULL AND rest_std <> 0 AND abs(rest_mean - v) / rest_std >= 3
  ORDER BY z DESC, side = 'min' DESC LIMIT 1)"""
        parts.append(f"SELECT * FROM ({_row(repr(c), 'possible_sentinel_missing', repr('medium'), 'cnt', 'pct', 'v')}"
                     f" FROM {cand})")
    return union_all(parts)


def sql_invalid_dtype(src, cols):
    return union_all([_row(f"'{c}'", "invalid_dtype", "'medium'") +
                      f" FROM {src} HAVING count({c}) > 0 AND count({SQL_NUMBER.format(x=c)}) = count({c})"
                      for c in cols])


def sql_id_like(src, cols_not_text):
    return union_all([_row(f"'{c}'", "id_like_column", "'low'") +
                      f" FROM {src} HAVING count(*) > 1 AND round(count(DISTINCT {c}) * 100.0 / count(*), 2) >= 98"
                      for c in cols_not_text])


def sql_leak_name(cols, target=None):
    hits = [c for c in cols if c != target and any(h in c.lower() for h in Q.LEAKAGE_NAME_HINTS)]
    if not hits:
        return None
    return union_all([_row(f"'{c}'", "possible_leakage", "'medium'") for c in hits])


def sql_leak_corr(src, cols):
    parts = []
    for a, b in combinations(cols, 2):
        r = (f"(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0))")
        parts.append(f"""SELECT * FROM ({_row(repr(a), 'possible_leakage', repr('medium'), value=f'round(abs({r}), 3)',
                                              other=repr(b))}
  FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)
  HAVING abs({r}) >= 0.995)""")
    return union_all(parts)


def sql_score(issues_sql):
    return f"""SELECT count(*) FILTER (WHERE severity = 'high') AS high_count,
  count(*) FILTER (WHERE severity = 'medium') AS medium_count,
  count(*) FILTER (WHERE severity = 'low') AS low_count,
  CAST(CASE WHEN count(*) FILTER (WHERE issue_type = 'empty_dataset') > 0 THEN 0.0 ELSE
  greatest(0.0, round(100.0 - coalesce(sum(CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 7
    WHEN 'low' THEN 2 ELSE 0 END), 0), 2)) END AS DOUBLE) AS quality_score
FROM ({issues_sql})"""


# ----------------------------------------------------------------------------- orders with gaps

ORD_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ORD_CAT = ["o_orderstatus", "o_orderpriority"]

ORDERS_ISSUES_SQL = union_all(p for p in [
    sql_missing(ORDERS_GAPS, ORD_ALL), sql_duplicates(ORDERS_GAPS), sql_constant(ORDERS_GAPS, ORD_ALL),
    sql_outliers(ORDERS_GAPS, ORD_NUM), sql_sentinel(ORDERS_GAPS, ORD_NUM), sql_invalid_dtype(ORDERS_GAPS, ORD_CAT),
    sql_id_like(ORDERS_GAPS, ORD_ALL), sql_leak_corr(ORDERS_GAPS, ORD_NUM)] if p)


def dq_issues_orders(spark, sf):
    """Flagship: the quality issues table of orders with injected gaps."""
    return Q.quality_issues(orders_gaps(spark, sf))


query("dq_issues_orders", ORDERS_ISSUES_SQL)(dq_issues_orders)


@query("dq_missing", sql_missing(ORDERS_GAPS, ORD_ALL))
def dq_missing(spark, sf):
    return Q.quality_issues(orders_gaps(spark, sf)).where(F.col("issue_type") == "missing_values")


@query("dq_score", sql_score(ORDERS_ISSUES_SQL))
def dq_score(spark, sf):
    return Q.quality_score(Q.quality_issues(orders_gaps(spark, sf)))


DUP_SRC = "(SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)"


@query("dq_duplicates", sql_duplicates(DUP_SRC))
def dq_duplicates(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return Q.quality_issues(li).where(F.col("issue_type") == "duplicate_rows")


LID_ALL = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
           "l_linestatus", "l_const", "l_rare", "l_price_copy"]
LID_NUM = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_rare",
           "l_price_copy"]


@query("dq_constant", sql_constant(LINEITEM_DERIVED, LID_ALL))
def dq_constant(spark, sf):
    return Q.quality_issues(lineitem_derived(spark, sf)).where(
        F.col("issue_type").isin("constant_column", "near_constant_column"))


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("dq_outliers", sql_outliers("lineitem", LI_NUM))
def dq_outliers(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_NUM)
    return Q.quality_issues(li).where(F.col("issue_type") == "possible_outliers")


CUST_SENT = """(SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 50 = 0 THEN 99999.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"""


def customer_sentinel(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey",
                    F.when(F.col("c_custkey") % 50 == 0, F.lit(99999.0)).otherwise(F.col("c_acctbal"))
                    .alias("c_acctbal"), "c_mktsegment")


@query("dq_sentinel", sql_sentinel(CUST_SENT, ["c_custkey", "c_nationkey", "c_acctbal"]))
def dq_sentinel(spark, sf):
    return Q.quality_issues(customer_sentinel(spark, sf)).where(F.col("issue_type") == "possible_sentinel_missing")


@query("dq_invalid_dtype", sql_invalid_dtype(PART_TEXT, ["p_name", "p_brand", "p_type", "p_size_text",
                                                          "size_range"]))
def dq_invalid_dtype(spark, sf):
    return Q.quality_issues(part_text(spark, sf)).where(F.col("issue_type") == "invalid_dtype")


CUST_ALL = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("dq_id_like", sql_id_like("customer", CUST_ALL))
def dq_id_like(spark, sf):
    return Q.quality_issues(table(spark, sf, "customer")).where(F.col("issue_type") == "id_like_column")


LABELS_RENAMED = ["doc_id", "quality", "toxic_label", "actual_result"]


@query("dq_leak_name", sql_leak_name(LABELS_RENAMED, target="quality"))
def dq_leak_name(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", F.col("toxic").alias("toxic_label"),
                                            (F.col("quality") * 10).alias("actual_result"))
    return Q.quality_issues(lab, likely_target="quality").where(
        (F.col("issue_type") == "possible_leakage") & F.col("other_column").isNull())


@query("dq_leak_corr", sql_leak_corr(LINEITEM_DERIVED, LID_NUM))
def dq_leak_corr(spark, sf):
    return Q.quality_issues(lineitem_derived(spark, sf)).where(
        (F.col("issue_type") == "possible_leakage") & F.col("other_column").isNotNull())


CUST_ISSUES_SQL = union_all(p for p in [
    sql_missing("customer", CUST_ALL), sql_duplicates("customer"), sql_constant("customer", CUST_ALL),
    sql_outliers("customer", ["c_custkey", "c_nationkey", "c_acctbal"]),
    sql_sentinel("customer", ["c_custkey", "c_nationkey", "c_acctbal"]),
    sql_invalid_dtype("customer", ["c_name", "c_mktsegment"]), sql_id_like("customer", CUST_ALL),
    sql_leak_corr("customer", ["c_custkey", "c_nationkey", "c_acctbal"])] if p)


@query("dq_issues", CUST_ISSUES_SQL)
def dq_issues(spark, sf):
    return Q.quality_issues(table(spark, sf, "customer"))


__all__ = ["dq_issues_orders", "column_profile"]
