"""Registered queries for feature selection/engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.functions.exprs import hash_unit
from tabflow.operators import features as FE
from tabflow.operators.profile import column_profile
from tabflow.operators.quality import quality_issues
from tabflow.operators.text import Tfidf
from tabflow.plans.common import DAILY_BY_PRIORITY, daily_orders_by_priority, sql_hash_unit, union_all
from tabflow.plans.quality_q import sql_constant, sql_id_like, sql_leak_corr
from tabflow.plans.registry import query, table

CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUST_ISSUES = union_all([sql_constant("customer", CUST), sql_id_like("customer", CUST),
                         sql_leak_corr("customer", ["c_custkey", "c_nationkey", "c_acctbal"])])
REQUESTED = ["c_nationkey", "c_acctbal"]


@query("feature_selection_log", f"""WITH i AS ({CUST_ISSUES}),
r AS (SELECT "column", arg_min(issue_type, CASE issue_type WHEN 'constant_column' THEN 0
        WHEN 'near_constant_column' THEN 1 WHEN 'id_like_column' THEN 2 ELSE 3 END) AS first_reason
      FROM i WHERE "column" IS NOT NULL GROUP BY 1),
c AS ({union_all([f"SELECT '{c}' AS " + '"column"' for c in CUST])})
SELECT c."column", c."column" IN ('c_nationkey', 'c_acctbal', 'c_mktsegment') AS kept,
  CASE WHEN c."column" IN ('c_nationkey', 'c_acctbal', 'c_mktsegment') THEN NULL
       ELSE coalesce(r.first_reason, 'not selected') END AS reason
FROM c LEFT JOIN r USING ("column")""")
def feature_selection_log(spark, sf):
    c = table(spark, sf, "customer")
    prof = column_profile(c)
    return FE.selection_log(prof, quality_issues(c, profile=prof), REQUESTED, keep_always=["c_mktsegment"])


@query("default_features", f"""WITH i AS ({CUST_ISSUES}),
c AS ({union_all([f"SELECT '{c}' AS " + '"column"' for c in CUST])})
SELECT "column" FROM c WHERE "column" <> 'c_mktsegment' AND "column" NOT IN
  (SELECT "column" FROM i WHERE "column" IS NOT NULL UNION SELECT other_column FROM i WHERE other_column IS NOT NULL)""")
def default_features(spark, sf):
    c = table(spark, sf, "customer")
    prof = column_profile(c)
    return FE.default_features(prof, quality_issues(c, profile=prof), target="c_mktsegment")


@query("entity_filter", "SELECT event_id, ts, event_type, value, props FROM events WHERE CAST(user_id AS VARCHAR) = '7'")
def entity_filter(spark, sf):
    return FE.entity_filter(table(spark, sf, "events"), "user_id", "7")


@query("date_parts", """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek,
  CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day
FROM orders""")
def date_parts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return FE.date_parts(o, "o_orderdate").drop("o_orderdate")


LAGS_SQL = f"""SELECT entity, ds, y,
  lag(y, 1) OVER (PARTITION BY entity ORDER BY ds) AS y_lag_1,
  lag(y, 7) OVER (PARTITION BY entity ORDER BY ds) AS y_lag_7,
  CASE WHEN count(y) OVER (PARTITION BY entity ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7
       THEN round(avg(y) OVER (PARTITION BY entity ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 2)
  END AS y_rolling_mean_7
FROM {DAILY_BY_PRIORITY}"""


def _lags(spark, sf):
    d = daily_orders_by_priority(spark, sf)
    out = FE.lag_rolling_features(d, "y", "ds", "entity", lags=(1, 7), windows=(7,))
    return out.withColumn("y_rolling_mean_7", F.round("y_rolling_mean_7", 2))


@query("lag_features", f"SELECT entity, ds, y_lag_1, y_lag_7 FROM ({LAGS_SQL})")
def lag_features(spark, sf):
    return _lags(spark, sf).select("entity", "ds", "y_lag_1", "y_lag_7")


@query("rolling_mean", f"SELECT entity, ds, y_rolling_mean_7 FROM ({LAGS_SQL})")
def rolling_mean(spark, sf):
    return _lags(spark, sf).select("entity", "ds", "y_rolling_mean_7")


@query("lag_features_nulls", "SELECT entity, ds, y_lag_1, y_lag_7, y_rolling_mean_7 FROM ("
       + LAGS_SQL.replace(f"FROM {DAILY_BY_PRIORITY}", f"FROM (SELECT nullif(entity, '5-LOW') AS entity, ds, y FROM {DAILY_BY_PRIORITY})") + ")")
def lag_features_nulls(spark, sf):
    """Rows without an entity are a series of their own."""
    d = daily_orders_by_priority(spark, sf).withColumn("entity", F.nullif("entity", F.lit("5-LOW")))
    out = FE.lag_rolling_features(d, "y", "ds", "entity", lags=(1, 7), windows=(7,))
    return out.select("entity", "ds", "y_lag_1", "y_lag_7", F.round("y_rolling_mean_7", 2).alias("y_rolling_mean_7"))


@query("dropna_rows", f"""SELECT entity, count(*) AS n_rows FROM ({LAGS_SQL})
WHERE y_lag_1 IS NOT NULL AND y_lag_7 IS NOT NULL AND y_rolling_mean_7 IS NOT NULL GROUP BY entity""")
def dropna_rows(spark, sf):
    return FE.dropna_rows(_lags(spark, sf)).groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"))


LI_TRAIN = f"{sql_hash_unit('l_orderkey', 'l_linenumber')} < 0.8"


@query("standard_scale", f"""SELECT l_orderkey, l_linenumber,
  round((l_quantity - mq) / CASE WHEN sq = 0 OR sq IS NULL THEN 1 ELSE sq END, 6) AS l_quantity,
  round((l_discount - md) / CASE WHEN sd = 0 OR sd IS NULL THEN 1 ELSE sd END, 6) AS l_discount
FROM lineitem, (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md,
  stddev_pop(l_discount) AS sd FROM lineitem WHERE {LI_TRAIN})""")
def standard_scale(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    train = li.where(hash_unit("l_orderkey", "l_linenumber") < 0.8)
    sc = FE.PopulationScaler(["l_quantity", "l_discount"]).fit(train)
    out = sc.transform(li)
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"),
                      F.round("l_discount", 6).alias("l_discount"))


DOC_TRAIN = f"{sql_hash_unit('doc_id')} < 0.8"
TOKENS = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))"
VOCAB_SQL = f"""WITH t AS (SELECT doc_id, {TOKENS} AS term FROM documents WHERE {DOC_TRAIN} AND text IS NOT NULL),
n AS (SELECT count(*) AS n FROM documents WHERE {DOC_TRAIN} AND text IS NOT NULL)
SELECT term, count(*) AS corpus_count, count(DISTINCT doc_id) AS df,
  ln((1.0 + (SELECT n FROM n)) / (1.0 + count(DISTINCT doc_id))) + 1.0 AS idf
FROM t GROUP BY term ORDER BY corpus_count DESC, term ASC LIMIT 100"""


def _tfidf(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs, Tfidf("doc_id", "text").fit(docs.where(hash_unit("doc_id") < 0.8))


@query("tfidf_vocabulary", f"SELECT term, corpus_count, df, round(idf, 6) AS idf FROM ({VOCAB_SQL})")
def tfidf_vocabulary(spark, sf):
    _, model = _tfidf(spark, sf)
    return model.vocabulary.select("term", "corpus_count", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_weights", f"""WITH v AS ({VOCAB_SQL}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {TOKENS} AS term FROM documents WHERE text IS NOT NULL)
       JOIN v USING (term) GROUP BY doc_id, term),
w AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN v USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights(spark, sf):
    docs, model = _tfidf(spark, sf)
    return model.transform(docs).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("feature_matrix", """SELECT coalesce(CAST(l_orderkey AS DOUBLE), 0.0) AS l_orderkey,
  coalesce(CAST(l_partkey AS DOUBLE), 0.0) AS l_partkey, coalesce(CAST(l_suppkey AS DOUBLE), 0.0) AS l_suppkey,
  coalesce(CAST(l_linenumber AS DOUBLE), 0.0) AS l_linenumber, coalesce(l_quantity, 0.0) AS l_quantity,
  coalesce(l_discount, 0.0) AS l_discount, coalesce(l_tax, 0.0) AS l_tax FROM lineitem""")
def feature_matrix(spark, sf):
    out, _ = FE.feature_frame(table(spark, sf, "lineitem"), target="l_extendedprice", time_col="l_shipdate")
    return out
