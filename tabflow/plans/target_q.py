"""Registered queries for target, problem type and time-series signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import target as TG
from tabflow.operators import timeseries as TS
from tabflow.operators.profile import column_profile
from tabflow.plans.common import DAILY_ORDERS, ORDERS_TEXT, SQL_DATETIME, daily_orders, orders_text, union_all
from tabflow.plans.registry import query, table


def profile_sql(src, cols):
    """Per-column profile rows in SQL; ``cols`` = [(name, kind, is_integer)] (kinds follow the schema)."""
    parts = []
    for pos, (c, kind, integer) in enumerate(cols):
        parts.append(f"""SELECT '{c}' AS "column", {pos} AS position, '{kind}' AS kind, {str(integer).lower()} AS is_int,
  count(DISTINCT {c}) AS u, count(*) AS n, round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct,
  round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS unique_pct FROM {src}""")
    return union_all(parts)


def candidates_sql(src, cols):
    has_dt = "true" if any(k == "datetime" for _, k, _ in cols) else "false"
    return f"""SELECT "column", position, kind, u AS cardinality, round(u / n, 4) AS cardinality_ratio, missing_pct,
  likely_problem_types FROM (
  SELECT *, concat_ws(',',
    CASE WHEN kind = 'categorical' AND u <= 20 THEN 'classification' END,
    CASE WHEN kind = 'boolean' THEN 'classification' END,
    CASE WHEN num AND u = 2 THEN 'classification' END,
    CASE WHEN num AND u <> 2 AND is_int AND u <= 20 THEN 'classification' END,
    CASE WHEN num AND u <> 2 THEN 'regression' END,
    CASE WHEN num AND u <> 2 AND NOT (is_int AND u <= 20) AND {has_dt} THEN 'forecasting' END)
    AS likely_problem_types
  FROM (SELECT *, kind = 'numerical' AND NOT (unique_pct >= 98 AND is_int) AS num FROM ({profile_sql(src, cols)})))
WHERE u > 1 AND NOT (unique_pct >= 98 AND kind <> 'numerical') AND kind <> 'datetime' AND likely_problem_types <> ''"""


def _cands(df):
    return TG.target_candidates(column_profile(df)).withColumn(
        "likely_problem_types", F.array_join("likely_problem_types", ","))


CUSTOMER_COLS = [("c_custkey", "numerical", True), ("c_name", "categorical", False),
                 ("c_nationkey", "numerical", True), ("c_acctbal", "numerical", False),
                 ("c_mktsegment", "categorical", False)]


@query("target_candidates", candidates_sql("customer", CUSTOMER_COLS))
def target_candidates(spark, sf):
    return _cands(table(spark, sf, "customer"))


LABELS_SRC = "(SELECT doc_id, quality FROM labels)"
LABELS_COLS = [("doc_id", "numerical", True), ("quality", "numerical", True)]


@query("recommended_target", f"""SELECT * FROM ({candidates_sql(LABELS_SRC, LABELS_COLS)})
WHERE (SELECT count(*) FROM ({candidates_sql(LABELS_SRC, LABELS_COLS)})) = 1""")
def recommended_target(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return TG.recommended_target(_cands(lab))


DAILY_COLS = [("ds", "datetime", False), ("sales", "numerical", False), ("n_orders", "numerical", True)]


@query("problem_type", f"""WITH c AS ({candidates_sql(DAILY_ORDERS, DAILY_COLS)})
SELECT CASE WHEN (SELECT count(*) FROM c WHERE likely_problem_types LIKE '%forecasting%') > 0 THEN 'forecasting'
            WHEN (SELECT count(*) FROM c) = 1 THEN
              CASE WHEN (SELECT any_value(likely_problem_types) FROM c) LIKE '%classification%' THEN 'classification'
                   WHEN (SELECT any_value(likely_problem_types) FROM c) LIKE '%regression%' THEN 'regression' END
       END AS problem_type,
  CASE WHEN (SELECT count(*) FROM c) = 1 THEN (SELECT any_value("column") FROM c)
       ELSE (SELECT "column" FROM c WHERE likely_problem_types LIKE '%forecasting%' ORDER BY position LIMIT 1)
  END AS target_column,
  CASE WHEN (SELECT count(*) FROM c) = 1 THEN 'high'
       WHEN (SELECT count(*) FROM c WHERE likely_problem_types LIKE '%forecasting%') = 1 THEN 'medium'
       ELSE 'low' END AS confidence""")
def problem_type(spark, sf):
    d = daily_orders(spark, sf)
    prof = column_profile(d)
    return TG.problem_type(TG.target_candidates(prof), prof)


ORDERS_ITEM = [("o_orderkey", "numerical", True), ("o_custkey", "numerical", True),
               ("o_orderstatus", "categorical", False), ("o_totalprice", "numerical", False),
               ("o_orderdate", "datetime", False), ("o_orderpriority", "categorical", False)]


@query("item_column", f"""SELECT "column" AS item_column, round(n / u, 4) AS avg_rows_per_value
FROM ({profile_sql('orders', ORDERS_ITEM)})
WHERE kind = 'categorical' AND unique_pct < 98 AND u > 1 AND n / u >= 2
ORDER BY n / u DESC, position DESC LIMIT 1""")
def item_column(spark, sf):
    return TG.item_column(column_profile(table(spark, sf, "orders")), exclude=("o_orderdate",))


FREQ_SQL = """WITH d AS (SELECT DISTINCT o_orderdate AS ts FROM orders),
g AS (SELECT floor(date_diff('microseconds', ts, lead(ts) OVER (ORDER BY ts)) / 86400000000.0) AS days FROM d),
m AS (SELECT days FROM g WHERE days IS NOT NULL GROUP BY days ORDER BY count(*) DESC, days ASC LIMIT 1)
SELECT (SELECT count(*) FROM d) AS n_distinct, CAST((SELECT days FROM m) AS BIGINT) AS modal_gap_days,
  CASE WHEN (SELECT days FROM m) = 1 THEN 'D' WHEN (SELECT days FROM m) = 7 THEN 'W'
       WHEN (SELECT days FROM m) BETWEEN 28 AND 31 THEN 'M' END AS frequency"""


@query("infer_frequency", FREQ_SQL)
def infer_frequency(spark, sf):
    return TS.infer_frequency(table(spark, sf, "orders"), "o_orderdate")


@query("missing_periods", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
e AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM d)
SELECT (SELECT count(*) FROM e) AS expected_periods,
  (SELECT count(*) FROM e WHERE d NOT IN (SELECT d FROM d)) AS missing_periods,
  round((SELECT count(*) FROM e WHERE d NOT IN (SELECT d FROM d)) * 100.0 / (SELECT count(*) FROM e), 2)
    AS missing_periods_pct""")
def missing_periods(spark, sf):
    return TS.missing_periods(table(spark, sf, "orders"), "o_orderdate", "D")


SEASON_SQL = f"""WITH p AS (SELECT ds AS ts, sales AS y FROM {DAILY_ORDERS}),
o AS (SELECT count(*) AS n, stddev_samp(y) AS sd FROM p),
m AS (SELECT stddev_samp(m) AS sd_dow, count(*) AS n_dow FROM (SELECT isodow(ts) AS dow, avg(y) AS m FROM p GROUP BY 1))
SELECT n, round(CASE WHEN n >= 14 AND sd <> 0 AND n_dow >= 2 THEN sd_dow / sd END, 6) AS cv,
  coalesce(CASE WHEN n >= 14 AND sd <> 0 AND n_dow >= 2 THEN sd_dow / sd END >= 0.1, false) AS seasonality_detected
FROM o, m"""


@query("seasonality_dow", SEASON_SQL)
def seasonality_dow(spark, sf):
    return TS.seasonality_dow(daily_orders(spark, sf), "ds", "sales")


TREND_SQL = f"""WITH p AS (SELECT ds AS ts, sales AS y, row_number() OVER (ORDER BY ds, sales) - 1 AS idx
  FROM {DAILY_ORDERS}),
a AS (SELECT count(*) AS n, stddev_samp(y) AS sd,
  covar_pop(idx, y) / nullif(stddev_pop(idx) * stddev_pop(y), 0) AS r FROM p)
SELECT n, round(CASE WHEN n >= 5 AND sd <> 0 THEN r END, 6) AS trend_r,
  coalesce(abs(CASE WHEN n >= 5 AND sd <> 0 THEN r END) >= 0.3, false) AS trend_detected,
  CASE WHEN n >= 5 AND sd <> 0 AND r > 0 THEN 'increasing' WHEN n >= 5 AND sd <> 0 AND r < 0 THEN 'decreasing' END
    AS direction FROM a"""


@query("trend_corr", TREND_SQL)
def trend_corr(spark, sf):
    return TS.trend_corr(daily_orders(spark, sf), "ds", "sales")


@query("aligned_pairs", f"""SELECT ts, y FROM (SELECT {SQL_DATETIME.format(x='o_orderdate')} AS ts,
  try_cast(o_totalprice AS DOUBLE) AS y FROM {ORDERS_TEXT}) WHERE ts IS NOT NULL AND y IS NOT NULL""")
def aligned_pairs(spark, sf):
    return TS.aligned_pairs(orders_text(spark, sf), "o_orderdate", "o_totalprice")


@query("timeseries_signals", f"""WITH p AS (SELECT ds, sales FROM {DAILY_ORDERS}),
d AS (SELECT DISTINCT CAST(ds AS TIMESTAMP) AS ts FROM p WHERE ds IS NOT NULL),
g AS (SELECT floor(date_diff('microseconds', ts, lead(ts) OVER (ORDER BY ts)) / 86400000000.0) AS days FROM d),
m AS (SELECT days FROM g WHERE days IS NOT NULL GROUP BY days ORDER BY count(*) DESC, days ASC LIMIT 1),
f AS (SELECT CASE WHEN (SELECT count(*) FROM d) < 3 THEN NULL WHEN (SELECT days FROM m) = 1 THEN 'D'
  WHEN (SELECT days FROM m) = 7 THEN 'W' WHEN (SELECT days FROM m) BETWEEN 28 AND 31 THEN 'M' END AS frequency),
r AS (SELECT min(CAST(ds AS TIMESTAMP)) AS min, max(CAST(ds AS TIMESTAMP)) AS max,
  count(DISTINCT CAST(ds AS DATE)) AS distinct_days FROM p),
e AS (SELECT CAST(unnest(CASE WHEN (SELECT frequency FROM f) = 'M'
    THEN generate_series(last_day(min(ds)), max(ds), INTERVAL 1 MONTH)
    ELSE generate_series(min(ds), max(ds), to_days(CASE WHEN (SELECT frequency FROM f) = 'W' THEN 7 ELSE 1 END))
  END) AS DATE) AS d FROM p),
mp AS (SELECT count(*) AS expected_periods, count(*) FILTER (WHERE d NOT IN (SELECT CAST(ds AS DATE) FROM p))
  AS missing_periods FROM e)
SELECT 'ds' AS datetime_column, CAST(NULL AS VARCHAR) AS item_column, f.frequency, r.min, r.max, r.distinct_days,
  mp.expected_periods, mp.missing_periods, round(mp.missing_periods * 100.0 / mp.expected_periods, 2)
    AS missing_periods_pct, s.cv, s.seasonality_detected, t.trend_r, t.trend_detected
FROM f, r, mp, ({SEASON_SQL}) s, ({TREND_SQL}) t""")
def timeseries_signals(spark, sf):
    return TS.timeseries_signals(daily_orders(spark, sf), "ds", "sales")
