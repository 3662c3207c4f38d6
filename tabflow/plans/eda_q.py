"""Registered queries for exploratory analysis."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from tabflow.operators import eda as E
from tabflow.operators.quality import outlier_counts
from tabflow.plans.common import (DAILY_ORDERS, ORDERS_GAPS, ORDERS_TEXT, PART_TEXT, SQL_DATETIME, SQL_NUM_OR_RANGE,
                                  daily_orders, orders_gaps, orders_text, part_text, union_all)
from tabflow.plans.quality_q import sql_outliers
from tabflow.plans.registry import query, table

ORD_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("eda_missing", union_all([f"""SELECT '{c}' AS "column",
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM {ORDERS_GAPS}""" for c in ORD_ALL]))
def eda_missing(spark, sf):
    return E.missing_pct(orders_gaps(spark, sf))


def _dist_sql(src, cols, digits=3, expr="{c}"):
    parts = []
    for c in cols:
        x = f"CAST({expr.format(c=c)} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", count(x) AS n,
  CASE WHEN count(x) >= 3 AND var_pop(x) > 0 THEN round(skewness(x), {digits}) END AS skew,
  CASE WHEN count(x) >= 4 AND var_pop(x) > 0 THEN round(kurtosis(x), {digits}) END AS kurtosis,
  min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3,
  max(x) AS max, round(avg(CASE WHEN x = 0 THEN 1 ELSE 0 END) * 100, 2) AS zeros_pct
FROM (SELECT {x} AS x FROM {src})""")
    return union_all(parts)


@query("eda_coerced_stats", _dist_sql(PART_TEXT, ["p_size_text", "size_range"], expr=SQL_NUM_OR_RANGE.replace(
    "{x}", "{c}")))
def eda_coerced_stats(spark, sf):
    coerced, converted = E.coerce_numeric_text(part_text(spark, sf))
    return E.distribution_stats(coerced, [c for c in ["p_size_text", "size_range"] if c in converted])


@query("eda_outliers", sql_outliers("events", ["value"]).replace(
    "'possible_outliers' AS issue_type", "'possible_outliers' AS issue_type"))
def eda_outliers(spark, sf):
    from tabflow.operators.quality import quality_issues
    ev = table(spark, sf, "events").select("value")
    return quality_issues(ev).where(F.col("issue_type") == "possible_outliers")


@query("eda_outlier_bounds", """SELECT 'value' AS "column", count(x) AS n, lo AS lower, hi AS upper,
  count(*) FILTER (WHERE x < lo OR x > hi) AS outlier_count,
  round(count(*) FILTER (WHERE x < lo OR x > hi) * 100.0 / count(x), 2) AS outlier_pct
FROM (SELECT value AS x FROM events),
  (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
    (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)) GROUP BY lo, hi""")
def eda_outlier_bounds(spark, sf):
    return outlier_counts(table(spark, sf, "events"), ["value"])


LI_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(src, cols):
    parts = []
    for a, b in combinations_with_replacement(cols, 2):
        r = ("round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 3)")
        sel = f"FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src} " \
              f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        parts.append(f"""SELECT '{a}' AS "column", '{b}' AS other_column, {r} AS r {sel}""")
        if a != b:
            parts.append(f"""SELECT '{b}' AS "column", '{a}' AS other_column, {r} AS r {sel}""")
    return union_all(parts)


@query("correlation_matrix", _corr_sql("lineitem", LI_CORR))
def correlation_matrix(spark, sf):
    return E.correlation_matrix(table(spark, sf, "lineitem"), LI_CORR)


@query("skew_kurtosis", """SELECT "column", skew, kurtosis FROM (""" + _dist_sql("events", ["value", "user_id"]) + ")")
def skew_kurtosis(spark, sf):
    return E.distribution_stats(table(spark, sf, "events"), ["value", "user_id"]).select("column", "skew", "kurtosis")


@query("five_number", """SELECT "column", min, q1, median, q3, max FROM (""" +
       _dist_sql("lineitem", LI_CORR) + ")")
def five_number(spark, sf):
    return E.distribution_stats(table(spark, sf, "lineitem"), LI_CORR).select("column", "min", "q1", "median", "q3",
                                                                              "max")


@query("zeros_pct", """SELECT "column", zeros_pct FROM (""" + _dist_sql("lineitem", LI_CORR) + ")")
def zeros_pct(spark, sf):
    return E.distribution_stats(table(spark, sf, "lineitem"), LI_CORR).select("column", "zeros_pct")


def _hist_sql(src, cols, right_closed):
    parts = []
    for c in cols:
        if right_closed:
            b = "least(greatest(ceil((x - mn) / w), 1), 12)"
        else:
            b = "least(floor((x - mn) / w) + 1, 12)"
        parts.append(f"""SELECT '{c}' AS "column", CAST(s.bin AS INTEGER) AS bin, mn + (s.bin - 1) * w AS lo,
  CASE WHEN s.bin = 12 THEN mx ELSE mn + s.bin * w END AS hi, coalesce(h.cnt, 0) AS count
FROM (SELECT min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx,
             (max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE))) / 12 AS w FROM {src}) m
CROSS JOIN (SELECT generate_series AS bin FROM generate_series(1, 12)) s
LEFT JOIN (SELECT CAST({b} AS INTEGER) AS bin, count(*) AS cnt FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src}
           WHERE {c} IS NOT NULL),
           (SELECT min(CAST({c} AS DOUBLE)) AS mn, (max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE))) / 12 AS w
            FROM {src}) GROUP BY 1) h ON h.bin = s.bin""")
    return union_all(parts)


@query("histogram_equal_width", _hist_sql("events", ["value"], False))
def histogram_equal_width(spark, sf):
    return E.histogram_equal_width(table(spark, sf, "events"), ["value"])


@query("histogram_right_closed", _hist_sql("lineitem", ["l_quantity", "l_extendedprice"], True))
def histogram_right_closed(spark, sf):
    return E.histogram_right_closed(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("datetime_months", """SELECT 'o_orderdate' AS "column", min(o_orderdate) AS min, max(o_orderdate) AS max,
  count(DISTINCT date_trunc('month', o_orderdate)) AS distinct_months FROM orders""")
def datetime_months(spark, sf):
    return E.datetime_months(table(spark, sf, "orders"), ["o_orderdate"])


@query("top_categories", union_all([f"""SELECT "column", rank, value, count, pct FROM (
  SELECT '{c}' AS "column", {c} AS value, count(*) AS count,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct,
    row_number() OVER (ORDER BY count(*) DESC, {c} ASC) AS rank
  FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10""" for c in ["p_brand", "p_type"]]))
def top_categories(spark, sf):
    return E.top_categories(table(spark, sf, "part"), ["p_brand", "p_type"])


@query("boolean_stats", union_all([f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE x) AS true_count,
  count(*) FILTER (WHERE NOT x) AS false_count, round(count(*) FILTER (WHERE x) * 100.0 / count(x), 2) AS true_pct,
  round(count(*) FILTER (WHERE NOT x) * 100.0 / count(x), 2) AS false_pct
FROM (SELECT CAST({c} AS BOOLEAN) AS x FROM labels)""" for c in ["quality", "toxic"]]))
def boolean_stats(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("quality").cast("boolean").alias("quality"),
                                            F.col("toxic").cast("boolean").alias("toxic"))
    return E.boolean_stats(lab, ["quality", "toxic"])


@query("missing_cells", f"""SELECT count(*) AS row_count, 6 AS column_count,
  ({' + '.join(f'(count(*) - count({c}))' for c in ORD_ALL)}) AS missing_cells,
  round(({' + '.join(f'(count(*) - count({c}))' for c in ORD_ALL)}) * 100.0 / (count(*) * 6), 2) AS missing_cell_pct
FROM {ORDERS_GAPS}""")
def missing_cells(spark, sf):
    return E.missing_cells(orders_gaps(spark, sf))


@query("text_vocab_ws", """SELECT 'text' AS "column",
  (SELECT count(DISTINCT t) FROM (SELECT unnest(regexp_split_to_array(lower(text), '[\\t\\n\\x0B\\f\\r ]+')) AS t
     FROM documents WHERE text IS NOT NULL) WHERE t <> '') AS vocab_size,
  round(avg(length(text)), 2) AS avg_length FROM documents""")
def text_vocab_ws(spark, sf):
    return E.whitespace_vocab(table(spark, sf, "documents"), ["text"])


@query("datetime_days_text", f"""SELECT 'o_orderdate' AS "column", min(ts) AS min, max(ts) AS max,
  count(DISTINCT CAST(ts AS DATE)) AS distinct_days
FROM (SELECT {SQL_DATETIME.format(x='o_orderdate')} AS ts FROM {ORDERS_TEXT})""")
def datetime_days_text(spark, sf):
    return E.datetime_days(orders_text(spark, sf), ["o_orderdate"])


CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUST_KIND = {"c_custkey": "numerical", "c_name": "categorical", "c_nationkey": "numerical",
             "c_acctbal": "numerical", "c_mktsegment": "categorical"}


@query("eda_snapshot", union_all([f"""SELECT '{c}' AS "column",
  CASE WHEN '{CUST_KIND[c]}' = 'numerical' THEN 'numerical'
       WHEN count({c}) > 0 AND avg(length(CAST({c} AS VARCHAR))) >= 25 THEN 'text' ELSE 'categorical' END AS kind,
  count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct,
  count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS cardinality_pct
FROM customer""" for c in CUST]))
def eda_snapshot(spark, sf):
    return E.eda_snapshot(table(spark, sf, "customer"))


def _snapshot_sql(t, numeric, categorical):
    """Rows of the full snapshot of a table of numbers and categories."""
    every = numeric + categorical
    cell = lambda section, col, item, value, text="NULL": (f"SELECT '{section}' AS section, {col} AS \"column\", {item} AS item, "  # noqa: E731
                                                           f"CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text")
    dup = f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(every)}))"
    missing = " + ".join(f"count(*) - count({c})" for c in every)
    parts = [cell("table", "NULL", "'row_count'", "count(*)") + f" FROM {t}", cell("table", "NULL", "'duplicate_row_count'", dup),
             cell("table", "NULL", "'duplicate_row_pct'", f"round({dup} * 100.0 / count(*), 2)") + f" FROM {t}",
             cell("table", "NULL", "'column_count'", str(len(every))), cell("table", "NULL", "'missing_cells'", missing) + f" FROM {t}",
             cell("table", "NULL", "'missing_cell_pct'", f"round(({missing}) * 100.0 / (count(*) * {len(every)}), 2)") + f" FROM {t}"]
    for kind in E.KINDS:
        parts.append(cell("table", "NULL", f"'type:{kind}'", str(len({"numerical": numeric, "categorical": categorical}.get(kind, [])))))
    for c in every:
        kind = "numerical" if c in numeric else "categorical"
        parts.append(cell("column", f"'{c}'", "'kind'", "NULL", f"'{kind}'"))
        for item, value in (("missing_count", f"count(*) - count({c})"), ("missing_pct", f"round((count(*) - count({c})) * 100.0 / count(*), 2)"),
                            ("distinct_count", f"count(DISTINCT {c})"), ("cardinality_pct", f"round(count(DISTINCT {c}) * 100.0 / count(*), 2)")):
            parts.append(cell("column", f"'{c}'", f"'{item}'", value) + f" FROM {t}")
    for c in numeric:
        x = f"CAST({c} AS DOUBLE)"
        for item, value in (("min", f"min({x})"), ("max", f"max({x})"), ("mean", f"round(avg({x}), 6)"), ("std", f"round(stddev_samp({x}), 6)"),
                            ("skew", f"round(skewness({x}), 3)"), ("kurtosis", f"round(kurtosis({x}), 3)"),
                            ("zeros_pct", f"round(avg(CAST({x} = 0 AS INTEGER)) * 100, 2)"), ("q1", f"quantile_cont({x}, 0.25)"),
                            ("median", f"quantile_cont({x}, 0.5)"), ("q3", f"quantile_cont({x}, 0.75)")):
            parts.append(cell("stats", f"'{c}'", f"'{item}'", value) + f" FROM {t}")
        parts.append(f"""SELECT 'histogram', '{c}', CAST(b AS VARCHAR), CAST((SELECT count(*) FROM {t}, (SELECT min({x}) AS mn, max({x}) AS mx FROM {t})
  WHERE {c} IS NOT NULL AND least(greatest(ceil(({x} - mn) / ((mx - mn) / 12)), 1), 12) = b) AS DOUBLE), NULL FROM (SELECT unnest(range(1, 13)) AS b)""")
        for d in numeric:
            y = f"CAST({d} AS DOUBLE)"
            parts.append(cell("correlation", f"'{c}'", f"'{d}'", f"round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 3)") + f" FROM {t}")
    for c in categorical:
        parts.append(f"""SELECT 'stats', '{c}', 'top:' || row_number() OVER (ORDER BY n DESC, v), CAST(n AS DOUBLE), v
  FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 10)""")
    return union_all(parts)


PART_NUM, PART_CAT = ["p_partkey", "p_size", "p_retailprice"], ["p_brand", "p_type"]


@query("eda_full_snapshot", _snapshot_sql("part", PART_NUM, PART_CAT))
def eda_full_snapshot(spark, sf):
    """The whole snapshot of the parts (bin edges are left out: engines print doubles differently)."""
    out = E.full_snapshot(table(spark, sf, "part").select(*PART_NUM, *PART_CAT))
    rounded = F.when(F.col("item").isin("mean", "std"), F.round("value", 6)).otherwise(F.col("value"))
    return out.withColumns({"value": rounded, "text": F.when(F.col("section") != "histogram", F.col("text"))})


DECOMP_SQL = f"""WITH d AS (SELECT ds, sales AS y, row_number() OVER (ORDER BY ds) - 1 AS idx FROM {DAILY_ORDERS}),
t AS (SELECT *, CASE WHEN count(y) OVER w = 7 THEN avg(y) OVER w END AS trend FROM d
      WINDOW w AS (ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT *, idx % 7 AS phase, y - trend AS detr FROM t WHERE trend IS NOT NULL),
pm AS (SELECT phase, avg(detr) AS pm FROM s GROUP BY phase),
c AS (SELECT phase, pm - avg(pm) OVER () AS seasonal FROM pm),
r AS (SELECT s.trend, c.seasonal, s.detr - c.seasonal AS resid FROM s JOIN c USING (phase))
SELECT count(*) AS n,
  CASE WHEN var_pop(trend + resid) <> 0 THEN round(greatest(0.0, 1 - var_pop(resid) / var_pop(trend + resid)), 4) END
    AS trend_strength,
  CASE WHEN var_pop(seasonal + resid) <> 0 THEN
    round(greatest(0.0, 1 - var_pop(resid) / var_pop(seasonal + resid)), 4) END AS seasonal_strength
FROM r"""


@query("decomposition_strength", DECOMP_SQL)
def decomposition_strength(spark, sf):
    return E.decomposition_strength(daily_orders(spark, sf), "ds", "sales")
