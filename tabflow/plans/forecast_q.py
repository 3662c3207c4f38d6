"""Registered queries for forecasting and per-entity scope (R01–R10, E17 reuse).

Series: order value per day and priority (five entities), split chronologically per
entity (X03): the first floor(0.8·n) days train, the rest test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import forecast as R
from tabflow.operators import metrics as V
from tabflow.plans.metrics_q import FC_SPLIT, fc_split
from tabflow.plans.registry import query, table


def _split(spark, sf):
    s = fc_split(spark, sf)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


SQL_POS = f"""(SELECT entity, ds, y, split, row_number() OVER (PARTITION BY entity ORDER BY ds) - 1 AS pos
  FROM {FC_SPLIT})"""
SQL_TRAIN = f"(SELECT entity, ds, y, pos FROM {SQL_POS} WHERE split = 'train')"
SQL_TEST = f"""(SELECT entity, ds, y, row_number() OVER (PARTITION BY entity ORDER BY ds) AS h FROM {SQL_POS}
  WHERE split = 'test')"""


@query("ordered_series", f"SELECT entity, ds, y, pos FROM {SQL_POS}")
def ordered_series(spark, sf):
    s = fc_split(spark, sf)
    return R.ordered_series(s, "entity", "ds", "y").select("entity", "ds", "y", "pos")


@query("fc_naive", f"""SELECT t.entity, t.ds, round(l.naive, 2) AS prediction FROM {SQL_TEST} t
JOIN (SELECT entity, arg_max(y, ds) AS naive FROM {SQL_TRAIN} GROUP BY 1) l USING (entity)""")
def fc_naive(spark, sf):
    tr, te = _split(spark, sf)
    return R.naive(tr, te, "entity", "ds").select("entity", "ds", F.round("prediction", 2).alias("prediction"))


SEAS_SQL = f"""(SELECT t.entity, t.ds, t.h, s.y AS prediction FROM {SQL_TEST} t
JOIN (SELECT entity, count(*) AS n FROM {SQL_TRAIN} GROUP BY 1) c USING (entity)
JOIN {SQL_TRAIN} s ON s.entity = t.entity AND s.pos = c.n - least(7, c.n) + ((t.h - 1) % least(7, c.n)))"""


@query("fc_seasonal_naive", f"SELECT entity, ds, round(prediction, 2) AS prediction FROM {SEAS_SQL}")
def fc_seasonal_naive(spark, sf):
    tr, te = _split(spark, sf)
    return R.seasonal_naive(tr, te, "entity", "ds").select("entity", "ds",
                                                           F.round("prediction", 2).alias("prediction"))


def _ar_sql(lag):
    return f"""(SELECT entity, sum(d * d_prev) / nullif(sum(d_prev * d_prev), 0) AS phi,
    arg_max(d, pos) AS d_last, arg_max(y, pos) AS y_last FROM (
  SELECT entity, pos, y, d, lag(d) OVER (PARTITION BY entity ORDER BY pos) AS d_prev FROM (
    SELECT entity, pos, y, y - lag(y, {lag}) OVER (PARTITION BY entity ORDER BY pos) AS d FROM {SQL_TRAIN}))
  GROUP BY entity)"""


@query("fc_ar_diff", f"""SELECT t.entity, t.ds, round(a.y_last + coalesce(a.d_last, 0) *
  CASE WHEN abs(coalesce(a.phi, 0) - 1) < 1e-12 THEN t.h
       ELSE coalesce(a.phi, 0) * (1 - pow(coalesce(a.phi, 0), t.h)) / (1 - coalesce(a.phi, 0)) END, 2) AS prediction
FROM {SQL_TEST} t JOIN {_ar_sql(1)} a USING (entity)""")
def fc_ar_diff(spark, sf):
    tr, te = _split(spark, sf)
    return R.ar_on_differences(tr, te, "entity", "ds").select("entity", "ds",
                                                              F.round("prediction", 2).alias("prediction"))


@query("fc_seasonal_ar", f"""SELECT s.entity, s.ds, round(s.prediction + coalesce(pow(a.phi, s.h) * a.d_last, 0), 2)
  AS prediction FROM {SEAS_SQL} s JOIN {_ar_sql(7)} a USING (entity)""")
def fc_seasonal_ar(spark, sf):
    tr, te = _split(spark, sf)
    return R.seasonal_ar(tr, te, "entity", "ds").select("entity", "ds", F.round("prediction", 2).alias("prediction"))


GRID_SQL = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a in R.HOLT_ALPHAS for b in R.HOLT_BETAS) + ") g(a, b)"


@query("fc_holt", f"""WITH RECURSIVE tr AS MATERIALIZED {SQL_TRAIN},
rec AS (SELECT f.entity, a, b, CAST(1 AS BIGINT) AS pos, f.y AS l, coalesce(s.y - f.y, 0) AS t, CAST(0 AS DOUBLE) AS sse
    FROM tr f LEFT JOIN tr s ON s.entity = f.entity AND s.pos = 1, {GRID_SQL} WHERE f.pos = 0
  UNION ALL SELECT r.entity, a, b, r.pos + 1, a * y + (1 - a) * (l + t), b * (a * y + (1 - a) * (l + t) - l) + (1 - b) * t,
    sse + (y - (l + t)) * (y - (l + t)) FROM rec r JOIN tr ON tr.entity = r.entity AND tr.pos = r.pos),
ends AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY entity, a, b ORDER BY pos DESC) = 1),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY entity ORDER BY sse, a, b) = 1),
scale AS (SELECT entity, avg(abs(y - p)) AS scale FROM
  (SELECT entity, y, lag(y, 7) OVER (PARTITION BY entity ORDER BY pos) AS p FROM tr) GROUP BY entity)
SELECT e.entity, round(avg(abs(e.y - (l + e.h * t))), 2) AS mae, round(avg(abs(e.y - (l + e.h * t))) / any_value(scale), 6) AS mase
FROM (SELECT entity, ds, y, row_number() OVER (PARTITION BY entity ORDER BY ds) AS h FROM {SQL_POS} WHERE split = 'test') e
JOIN best USING (entity) JOIN scale USING (entity) GROUP BY e.entity""")
def fc_holt(spark, sf):
    tr, te = _split(spark, sf)
    p = R.holt(tr, te, "entity", "ds")
    return V.mase(tr, p, ["entity"], "ds", "y", "prediction").select("entity", F.round("mae", 2).alias("mae"), F.round("mase", 6).alias("mase"))


@query("fc_regression")
def fc_regression(spark, sf):
    """lag/rolling/calendar features → linear regression on train days, scored on test days."""
    return V.regression_metrics(R.regression_forecast(fc_split(spark, sf), "entity", "ds"))


@query("fc_global")
def fc_global(spark, sf):
    """One regressor over all entities (per-entity lags plus an entity index), horizon from X11."""
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    pred, h = R.global_forecast(d, "entity", "ds")
    return V.regression_metrics(pred).withColumn("horizon", F.lit(h))


def _metrics_sql(name, source):
    return f"""SELECT '{name}' AS model, avg(abs(f - y)) AS mae, sqrt(avg((f - y) * (f - y))) AS rmse,
  avg(CASE WHEN abs(f) + abs(y) = 0 THEN 0 ELSE 2 * abs(f - y) / (abs(f) + abs(y)) END) * 100 AS smape,
  (SELECT avg(m / scale) FROM (SELECT entity, avg(abs(f - y)) AS m FROM {source} GROUP BY entity) JOIN sc USING (entity)) AS mase FROM {source}"""


@query("run_forecasters", f"""WITH tr AS MATERIALIZED {SQL_TRAIN}, te AS MATERIALIZED (SELECT entity, ds, y, pos, row_number() OVER (PARTITION BY entity ORDER BY ds) AS h
    FROM {SQL_POS} WHERE split = 'test'),
sc AS (SELECT entity, avg(abs(y - p)) AS scale FROM (SELECT entity, y, lag(y, 7) OVER (PARTITION BY entity ORDER BY pos) AS p FROM tr) GROUP BY entity),
p1 AS (SELECT te.*, f FROM te JOIN (SELECT entity, arg_max(y, ds) AS f FROM tr GROUP BY 1) USING (entity)),
p2 AS (SELECT te.*, s.prediction AS f FROM te JOIN {SEAS_SQL} s USING (entity, ds)),
p3 AS (SELECT te.*, a + k * pos AS f FROM te JOIN (SELECT entity, regr_intercept(y, pos) AS a, regr_slope(y, pos) AS k FROM tr GROUP BY 1) USING (entity)),
r AS ({_metrics_sql('naive', 'p1')} UNION ALL {_metrics_sql('seasonal_naive', 'p2')} UNION ALL {_metrics_sql('linear_trend', 'p3')})
SELECT model, 'success' AS status, metric, round(value, 4) AS value FROM r UNPIVOT (value FOR metric IN (mae, rmse, smape, mase))""")
def run_forecasters(spark, sf):
    tr, te = _split(spark, sf)
    out = R.run_forecasters(tr, te, "entity", "ds", models=["naive", "seasonal_naive", "linear_trend"])
    return out.select("model", "status", "metric", F.round("value", 4).alias("value"))


BRAND = """(SELECT p.p_brand AS entity, l.l_quantity AS x, l.l_extendedprice AS y,
  CASE WHEN row_number() OVER (PARTITION BY p.p_brand ORDER BY l.l_shipdate, l.l_orderkey, l.l_linenumber) - 1
    < floor(count(*) OVER (PARTITION BY p.p_brand) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def brand_split(spark, sf):
    from tabflow.operators.split import split_chronological_entity
    li = table(spark, sf, "lineitem")
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    d = li.join(p, li.l_partkey == p.p_partkey).select("entity", "l_shipdate", "l_orderkey", "l_linenumber",
                                                        F.col("l_quantity").alias("x"),
                                                        F.col("l_extendedprice").alias("y"))
    return split_chronological_entity(d, "entity", "l_shipdate", ["l_orderkey", "l_linenumber"])


@query("per_entity_fit", f"""SELECT entity, round(slope, 4) AS slope, round(intercept, 4) AS intercept,
  round(sqrt(avg((y - (intercept + slope * x)) ^ 2)), 4) AS rmse, count(*) AS n_test FROM {BRAND}
JOIN (SELECT entity, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM {BRAND}
      WHERE split = 'train' GROUP BY 1) c USING (entity) WHERE split = 'test' GROUP BY entity, slope, intercept""")
def per_entity_fit(spark, sf):
    out = R.per_entity_linear_fit(brand_split(spark, sf), "entity", "x", "y")
    return out.select("entity", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("rmse", 4).alias("rmse"), "n_test")


@query("per_entity_eligibility", """SELECT p.p_brand AS entity, count(*) AS n_rows,
  CAST(floor(count(*) * 0.8) AS BIGINT) AS n_train, count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) AS n_test,
  CASE WHEN count(*) < 10 THEN 'too_few_rows' WHEN floor(count(*) * 0.8) < 5 THEN 'too_few_train_rows'
       WHEN count(*) - floor(count(*) * 0.8) < 1 THEN 'too_few_test_rows' END AS skip_reason,
  count(*) >= 10 AND floor(count(*) * 0.8) >= 5 AND count(*) - floor(count(*) * 0.8) >= 1 AS eligible
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1""")
def per_entity_eligibility(spark, sf):
    li = table(spark, sf, "lineitem")
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    d = li.join(p, li.l_partkey == p.p_partkey).select("entity", "l_shipdate")
    return R.entity_eligibility(d, "entity", "l_shipdate").select(
        "entity", "n_rows", F.col("n_train").cast("bigint").alias("n_train"),
        F.col("n_test").cast("bigint").alias("n_test"), "skip_reason", "eligible")


# Every priority's first week of 1992 is an entity of its own, too small to model.
SCOPED = f"""(SELECT CASE WHEN ds < DATE '1992-01-08' THEN 'early ' || entity ELSE entity END AS entity, ds, y,
  CAST(isodow(ds) - 1 AS DOUBLE) AS dow, CAST(date_diff('day', DATE '1992-01-01', ds) AS DOUBLE) AS day
  FROM (SELECT entity, CAST(ds AS DATE) AS ds, y FROM {FC_SPLIT}))"""


@query("per_entity_pipeline", f"""WITH s AS MATERIALIZED (SELECT *, row_number() OVER e - 1 AS pos, count(*) OVER (PARTITION BY entity) AS n,
    CAST(floor(count(*) OVER (PARTITION BY entity) * 0.8) AS BIGINT) AS cut FROM {SCOPED} WINDOW e AS (PARTITION BY entity ORDER BY ds)),
tr AS MATERIALIZED (SELECT * FROM s WHERE n >= 10 AND pos < cut), te AS (SELECT *, pos - cut + 1 AS h FROM s WHERE n >= 10 AND pos >= cut),
m AS (SELECT entity, covar_pop(dow, dow) AS s11, covar_pop(dow, day) AS s12, covar_pop(day, day) AS s22, covar_pop(dow, y) AS c1,
    covar_pop(day, y) AS c2, avg(dow) AS m1, avg(day) AS m2, avg(y) AS my FROM tr GROUP BY entity),
b AS (SELECT entity, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM m),
p AS (SELECT te.entity, 'linear_regression' AS model, y, my + b1 * (dow - m1) + b2 * (day - m2) AS f FROM te JOIN b USING (entity)
  UNION ALL SELECT te.entity, 'naive', te.y, l.f FROM te JOIN (SELECT entity, arg_max(y, ds) AS f FROM tr GROUP BY 1) l USING (entity)
  UNION ALL SELECT te.entity, 'seasonal_naive', te.y, tr.y FROM te JOIN tr ON tr.entity = te.entity AND tr.pos = te.cut - least(7, te.cut) + (te.h - 1) % least(7, te.cut)
  UNION ALL SELECT te.entity, 'linear_trend', te.y, a + k * te.pos FROM te
    JOIN (SELECT entity, regr_intercept(y, pos) AS a, regr_slope(y, pos) AS k FROM tr GROUP BY 1) USING (entity))
SELECT entity, model, 'success' AS status, NULL::VARCHAR AS skip_reason, any_value(cut) AS n_train, any_value(n - cut) AS n_test,
  round(avg(abs(f - y)), 2) AS mae, round(sqrt(avg((f - y) * (f - y))), 2) AS rmse
FROM p JOIN (SELECT DISTINCT entity, n, cut FROM s) USING (entity) GROUP BY entity, model
UNION ALL SELECT DISTINCT entity, NULL, 'skipped', 'too_few_rows', cut, n - cut, NULL::DOUBLE, NULL::DOUBLE FROM s WHERE n < 10""")
def per_entity_pipeline(spark, sf):
    ds = F.col("ds").cast("date")
    d = fc_split(spark, sf).select(
        F.when(ds < F.lit("1992-01-08").cast("date"), F.concat(F.lit("early "), F.col("entity"))).otherwise(F.col("entity")).alias("entity"),
        ds.alias("ds"), "y", F.weekday(ds).cast("double").alias("dow"), F.datediff(ds, F.lit("1992-01-01").cast("date")).cast("double").alias("day"))
    out = R.per_entity_pipeline(d, "entity", "ds", "y", ["dow", "day"], ["naive", "seasonal_naive", "linear_trend"])
    return out.withColumns({"mae": F.round("mae", 2), "rmse": F.round("rmse", 2)})


@query("per_entity_aggregate", f"""WITH t AS {SQL_TEST},
nv AS (SELECT entity, arg_max(y, ds) AS p FROM {SQL_TRAIN} GROUP BY 1),
r AS (SELECT 'naive' AS model, t.entity, avg(abs(t.y - nv.p)) AS value FROM t JOIN nv USING (entity) GROUP BY 2
      UNION ALL SELECT 'seasonal_naive', entity, avg(abs(y - prediction)) FROM (SELECT s.*, t.y FROM {SEAS_SQL} s
      JOIN t USING (entity, ds)) GROUP BY 2)
SELECT model, round(avg(value), 4) AS mean_score, 0.0::DOUBLE AS mean_seconds, count(value) AS n_entities_scored,
  count(*) AS n_entities FROM r GROUP BY model""")
def per_entity_aggregate(spark, sf):
    tr, te = _split(spark, sf)
    parts = []
    for name, fn in (("naive", R.naive), ("seasonal_naive", R.seasonal_naive)):
        p = fn(tr, te, "entity", "ds")
        parts.append(p.groupBy("entity").agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("value"))
                     .select(F.lit(name).alias("model"), "entity", "value", F.lit(0.0).alias("train_seconds")))
    agg = R.per_entity_aggregate(parts[0].unionByName(parts[1]))
    return agg.select("model", F.round("mean_score", 4).alias("mean_score"), "mean_seconds", "n_entities_scored",
                      "n_entities")
