"""Registered queries for splits, folds and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import split as S
from tabflow.plans.common import (DAILY_BY_PRIORITY, DAILY_ORDERS, daily_orders, daily_orders_by_priority,
                                  sql_hash_unit)
from tabflow.plans.registry import query, table

H_LI = sql_hash_unit("l_orderkey", "l_linenumber")


@query("split_random", f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN row_number() OVER (ORDER BY {H_LI}, l_orderkey, l_linenumber) - 1 < ceil(count(*) OVER () * 0.2)
       THEN 'test' ELSE 'train' END AS split FROM lineitem""")
def split_random(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return S.split_random(li, ["l_orderkey", "l_linenumber"])


@query("split_random_hash", f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN {H_LI} < 0.2 THEN 'test' ELSE 'train' END AS split FROM lineitem""")
def split_random_hash(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return S.split_random(li, ["l_orderkey", "l_linenumber"], exact=False)


@query("split_chrono", f"""SELECT ds, CASE WHEN row_number() OVER (ORDER BY ds) - 1 < floor(count(*) OVER () * 0.8)
  THEN 'train' ELSE 'test' END AS split FROM {DAILY_ORDERS}""")
def split_chrono(spark, sf):
    return S.split_chronological(daily_orders(spark, sf).select("ds"), "ds", [])


@query("split_chrono_entity", f"""SELECT entity, ds, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY ds) - 1
  < floor(count(*) OVER (PARTITION BY entity) * 0.8) THEN 'train' ELSE 'test' END AS split FROM {DAILY_BY_PRIORITY}""")
def split_chrono_entity(spark, sf):
    return S.split_chronological_entity(daily_orders_by_priority(spark, sf).select("entity", "ds"), "entity", "ds")


NULL_ENTITY_SQL = f"(SELECT nullif(entity, '5-LOW') AS entity, ds, y FROM {DAILY_BY_PRIORITY})"


@query("split_chrono_entity_nulls", f"""SELECT entity, ds, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY ds) - 1
  < floor(count(*) OVER (PARTITION BY entity) * 0.8) THEN 'train' ELSE 'test' END AS split FROM {NULL_ENTITY_SQL}""")
def split_chrono_entity_nulls(spark, sf):
    """Rows without an entity are split as an entity of their own."""
    d = daily_orders_by_priority(spark, sf).select(F.nullif("entity", F.lit("5-LOW")).alias("entity"), "ds")
    return S.split_chronological_entity(d, "entity", "ds")


H_DOC = sql_hash_unit("doc_id")
STRAT_SQL = f"""SELECT doc_id, quality, CASE
  WHEN row_number() OVER (PARTITION BY quality ORDER BY {H_DOC}, doc_id) - 1 < round(count(*) OVER (PARTITION BY quality) * 0.2)
    THEN 'test'
  WHEN row_number() OVER (PARTITION BY quality ORDER BY {H_DOC}, doc_id) - 1 < round(count(*) OVER (PARTITION BY quality) * 0.2)
       + round(count(*) OVER (PARTITION BY quality) * 0.2) THEN 'validation'
  ELSE 'train' END AS split FROM labels"""


def _strat(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return S.split_stratified(lab, "quality", ["doc_id"])


@query("split_stratified3", STRAT_SQL)
def split_stratified3(spark, sf):
    return _strat(spark, sf)


@query("split_stratified3_nulls", STRAT_SQL.replace("FROM labels", "FROM (SELECT doc_id, nullif(quality, 0) AS quality FROM labels)"))
def split_stratified3_nulls(spark, sf):
    """Rows without a label are a class of their own."""
    lab = table(spark, sf, "labels").select("doc_id", F.nullif("quality", F.lit(0)).alias("quality"))
    return S.split_stratified(lab, "quality", ["doc_id"])


@query("split_class_counts", f"SELECT split, quality, count(*) AS n FROM ({STRAT_SQL}) GROUP BY 1, 2")
def split_class_counts(spark, sf):
    return S.class_distribution(_strat(spark, sf), "quality")


@query("stratify_feasible", """SELECT count(*) AS n_classes, min(n) AS smallest_class,
  bool_and(n >= 2 AND round(n * 0.2) >= 1 AND n - round(n * 0.2) >= 1) AS stratified,
  CASE WHEN bool_and(n >= 2 AND round(n * 0.2) >= 1 AND n - round(n * 0.2) >= 1) THEN 'stratified' ELSE 'random' END
    AS method
FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)""")
def stratify_feasible(spark, sf):
    return S.stratify_feasible(table(spark, sf, "labels"), "toxic")


H_ORD = sql_hash_unit("o_orderkey")


@query("kfold", f"""WITH d AS (SELECT o_orderkey, row_number() OVER (ORDER BY {H_ORD}, o_orderkey) - 1 AS idx,
  count(*) OVER () AS n FROM orders),
p AS (SELECT *, n // 3 AS q, n % 3 AS r FROM d)
SELECT o_orderkey, CAST(CASE WHEN idx < r * (q + 1) THEN floor(idx / (q + 1))
  ELSE r + floor((idx - r * (q + 1)) / q) END AS INTEGER) AS fold FROM p""")
def kfold(spark, sf):
    return S.kfold(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], k=3)


@query("kfold_stratified", f"""SELECT doc_id, quality,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY {H_DOC}, doc_id) - 1) % 3 AS INTEGER) AS fold FROM labels""")
def kfold_stratified(spark, sf):
    out, _ = S.kfold_stratified(table(spark, sf, "labels").select("doc_id", "quality"), "quality", ["doc_id"], k=3)
    return out


@query("oversample", f"""WITH pos AS (SELECT doc_id, quality,
    row_number() OVER (PARTITION BY quality ORDER BY {H_DOC}, doc_id) - 1 AS p FROM labels),
c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
m AS (SELECT max(n) AS mx FROM c),
draws AS (SELECT quality, n, unnest(generate_series(0, mx - n - 1)) AS draw FROM c, m WHERE mx > n),
picks AS (SELECT quality, draw, ('0x' || substr(md5(concat_ws('|', '42', CAST(quality AS VARCHAR), CAST(draw AS VARCHAR))), 1, 15))::BIGINT % n AS p FROM draws)
SELECT doc_id, quality, CAST(NULL AS BIGINT) AS draw FROM labels
UNION ALL
SELECT pos.doc_id, pos.quality, CAST(picks.draw AS BIGINT) AS draw FROM picks JOIN pos USING (quality, p)""")
def oversample(spark, sf):
    return S.oversample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", ["doc_id"])


@query("class_balance", """SELECT quality, n, round(n / sum(n) OVER (), 6) AS share,
  min(n) OVER () / sum(n) OVER () < 0.15 AS imbalanced FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)""")
def class_balance(spark, sf):
    return S.class_balance(table(spark, sf, "labels"), "quality")


@query("holdout_last_h", f"""WITH d AS (SELECT entity, ds, row_number() OVER (PARTITION BY entity ORDER BY ds) - 1 AS pos,
  count(*) OVER (PARTITION BY entity) AS n FROM {DAILY_BY_PRIORITY}),
h AS (SELECT greatest(1, least(28, min(n) // 5)) AS h FROM d)
SELECT entity, ds, CASE WHEN pos >= n - h THEN 'test' ELSE 'train' END AS split FROM d, h""")
def holdout_last_h(spark, sf):
    out, _ = S.holdout_last_h(daily_orders_by_priority(spark, sf).select("entity", "ds"), "entity", "ds")
    return out.select("entity", "ds", "split")


__all__ = ["F"]
