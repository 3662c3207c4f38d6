"""Registered queries for cleaning (C01–C17) and cleaner persistence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabflow.functions.exprs import hash_unit, parse_numeric_or_range
from tabflow.operators import clean as C
from tabflow.plans.common import (ORDERS_GAPS, PART_TEXT, SQL_NUM_OR_RANGE, orders_gaps, part_text, sql_hash_unit,
                                  union_all)
from tabflow.plans.registry import query, table
from tabflow.session import scratch_path


@query("drop_duplicates", """SELECT count(*) AS rows_before,
  (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS rows_after,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS removed
FROM lineitem""")
def drop_duplicates(spark, sf):
    _, report = C.drop_duplicates(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))
    return report


@query("parse_numeric_text", f"""SELECT p_partkey, size_range, {SQL_NUM_OR_RANGE.format(x='size_range')} AS parsed
FROM {PART_TEXT}""")
def parse_numeric_text(spark, sf):
    return part_text(spark, sf).select("p_partkey", "size_range", parse_numeric_or_range("size_range").alias("parsed"))


@query("numeric_text_gate", union_all([f"""SELECT '{c}' AS "column", count({c}) AS n_nonnull,
  count({SQL_NUM_OR_RANGE.format(x=c)}) AS n_parsed,
  round(count({SQL_NUM_OR_RANGE.format(x=c)}) / count({c}), 4) AS parse_ratio,
  coalesce(count({SQL_NUM_OR_RANGE.format(x=c)}) / count({c}) >= 0.8, false) AS converted
FROM {PART_TEXT}""" for c in ["p_name", "p_brand", "p_size_text", "size_range"]]))
def numeric_text_gate(spark, sf):
    return C.numeric_text_gate(part_text(spark, sf), ["p_name", "p_brand", "p_size_text", "size_range"])


EVENTS_GAPS = """(SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events)"""


def events_gaps(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))


@query("ffill_bfill", f"""SELECT event_id, user_id, coalesce(value,
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM {EVENTS_GAPS}""")
def ffill_bfill(spark, sf):
    e = events_gaps(spark, sf)
    out = C.fill_forward_backward(e, ["value"], ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "user_id", "value")


LI_GAPS = f"""(SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount,
  {sql_hash_unit('l_orderkey', 'l_linenumber')} < 0.8 AS is_train FROM lineitem)"""


def lineitem_gaps(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
                     F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"),
                     (hash_unit("l_orderkey", "l_linenumber") < 0.8).alias("is_train"))


@query("impute_median", f"""SELECT l_orderkey, l_linenumber,
  coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {LI_GAPS} WHERE is_train)) AS l_quantity,
  coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {LI_GAPS} WHERE is_train)) AS l_discount,
  CAST(l_quantity IS NULL AS INTEGER) AS l_quantity_was_missing,
  CAST(l_discount IS NULL AS INTEGER) AS l_discount_was_missing
FROM {LI_GAPS}""")
def impute_median(spark, sf):
    li = lineitem_gaps(spark, sf)
    model = C.TableCleaner().fit(li.where("is_train").drop("is_train"))
    return model.transform(li.drop("is_train"))


ORD_MODE = """(SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)"""


def orders_mode(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey",
                    F.when(k % 29 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
                    F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


@query("impute_mode", f"""SELECT o_orderkey, coalesce(o_orderstatus,
  (SELECT o_orderstatus FROM {ORD_MODE} WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC,
   o_orderstatus LIMIT 1)) AS o_orderstatus FROM {ORD_MODE}""")
def impute_mode(spark, sf):
    model = C.TableCleaner(encode=False).fit(orders_mode(spark, sf))
    return model.transform(orders_mode(spark, sf)).select("o_orderkey", "o_orderstatus")


@query("impute_unknown", f"""SELECT o_orderkey, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority
FROM {ORD_MODE}""")
def impute_unknown(spark, sf):
    model = C.TableCleaner(encode=False).fit(orders_mode(spark, sf))
    return model.transform(orders_mode(spark, sf)).select("o_orderkey", "o_orderpriority")


@query("fill_text", """SELECT doc_id, length(coalesce(CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END, ''))
  AS text_length FROM documents""")
def fill_text(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"))
    model = C.TableCleaner(text_cols=["text"], encode=False).fit(d)
    return model.transform(d).select("doc_id", F.length("text").cast("bigint").alias("text_length"))


@query("drop_missing_target", """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NOT NULL""")
def drop_missing_target(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"),
                                                            "doc_id", "left")
    model = C.TableCleaner(target="quality", encode=False).fit(d)
    return model.transform(d).select("doc_id", "quality")


ORD_SPARSE = """(SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN NULL ELSE o_custkey END AS o_custkey,
  o_totalprice, o_orderstatus FROM orders)"""


@query("drop_sparse_columns", f"""SELECT "column", missing_frac FROM (
  SELECT 'o_custkey' AS "column", round((count(*) - count(o_custkey)) / count(*), 4) AS missing_frac FROM {ORD_SPARSE}
  UNION ALL SELECT 'o_totalprice', round((count(*) - count(o_totalprice)) / count(*), 4) FROM {ORD_SPARSE}
  UNION ALL SELECT 'o_orderstatus', round((count(*) - count(o_orderstatus)) / count(*), 4) FROM {ORD_SPARSE}
  UNION ALL SELECT 'o_orderkey', round((count(*) - count(o_orderkey)) / count(*), 4) FROM {ORD_SPARSE})
WHERE missing_frac > 0.7""")
def drop_sparse_columns(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.lit(None)).otherwise(F.col("o_custkey"))
                 .alias("o_custkey"), "o_totalprice", "o_orderstatus")
    model = C.TableCleaner(encode=False).fit(d)
    kept = set(model.transform(d).columns)
    rows = [(c, frac) for c, frac in model.state.dropped.items() if c not in kept]
    return spark.createDataFrame(rows, "column string, missing_frac double")


@query("missing_flags", f"""SELECT o_orderkey, CAST(o_custkey IS NULL AS INTEGER) AS o_custkey_was_missing,
  CAST(o_totalprice IS NULL AS INTEGER) AS o_totalprice_was_missing,
  CAST(o_orderpriority IS NULL AS INTEGER) AS o_orderpriority_was_missing FROM {ORDERS_GAPS}""")
def missing_flags(spark, sf):
    d = orders_gaps(spark, sf).drop("o_orderdate")
    model = C.TableCleaner(encode=False).fit(d)
    return model.transform(d).select("o_orderkey", "o_custkey_was_missing", "o_totalprice_was_missing",
                                     "o_orderpriority_was_missing")


def _cap_sql(src, key_cols, c, method):
    if method == "iqr":
        b = (f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
             f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {src})")
    else:
        b = f"(SELECT avg({c}) - 3 * stddev_samp({c}) AS lo, avg({c}) + 3 * stddev_samp({c}) AS hi FROM {src})"
    return f"SELECT {', '.join(key_cols)}, round(least(greatest({c}, lo), hi), 6) AS {c} FROM {src}, {b}"


def _iqr_b(c):
    return (f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
            f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c} "
            f"FROM lineitem)")


@query("cap_iqr", f"""SELECT l_orderkey, l_linenumber,
  round(least(greatest(l_extendedprice, lo_l_extendedprice), hi_l_extendedprice), 6) AS l_extendedprice,
  round(least(greatest(l_quantity, lo_l_quantity), hi_l_quantity), 6) AS l_quantity
FROM lineitem, {_iqr_b('l_extendedprice')}, {_iqr_b('l_quantity')}""")
def cap_iqr(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    model = C.TableCleaner(cap_outliers=True).fit(li.drop("l_orderkey", "l_linenumber"))
    out = model.transform(li)
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 6).alias("l_extendedprice"),
                      F.round("l_quantity", 6).alias("l_quantity"))


@query("cap_zscore", _cap_sql("events", ["event_id"], "value", "zscore"))
def cap_zscore(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    model = C.TableCleaner(cap_outliers=True, outlier_method="zscore").fit(e.drop("event_id"))
    return model.transform(e).select("event_id", F.round("value", 6).alias("value"))


PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", "SELECT o_orderkey, " + ", ".join(
    f"""CAST(o_orderpriority = '{p}' AS INTEGER) AS "o_orderpriority_{p}" """ for p in PRIOS[1:]) +
    " FROM orders WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders) <= 15")
def one_hot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    model = C.TableCleaner().fit(o)
    return model.transform(o)


@query("label_encode", """SELECT p_partkey, coalesce(code, -1) AS p_brand FROM part LEFT JOIN
  (SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand
   FROM part)) USING (p_brand)""")
def label_encode(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    model = C.TableCleaner().fit(p)
    return model.transform(p)


LI_CLEAN = f"""(SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus,
  {sql_hash_unit('l_orderkey', 'l_linenumber')} < 0.8 AS is_train FROM lineitem)"""


def lineitem_clean_input(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
                     "l_extendedprice",
                     F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
                     "l_linestatus", (hash_unit("l_orderkey", "l_linenumber") < 0.8).alias("is_train"))


def _flags_sql():
    tr = f"(SELECT * FROM {LI_CLEAN} WHERE is_train)"
    miss_rf = f"(SELECT (count(*) - count(l_returnflag)) * 1.0 / count(*) FROM {tr})"
    mode_rf = (f"(SELECT l_returnflag FROM {tr} WHERE l_returnflag IS NOT NULL GROUP BY 1 "
               f"ORDER BY count(*) DESC, l_returnflag LIMIT 1)")
    fill_rf = f"CASE WHEN {miss_rf} > 0.05 THEN 'Unknown' ELSE {mode_rf} END"
    rf = f"coalesce(l_returnflag, {fill_rf})"
    levels_rf = sorted(["A", "N", "R", "Unknown"])
    levels_ls = ["F", "O"]
    return f"""SELECT l_orderkey, l_linenumber,
  coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {tr})) AS l_quantity, l_extendedprice,
  CAST(l_quantity IS NULL AS INTEGER) AS l_quantity_was_missing,
  CAST(l_returnflag IS NULL AS INTEGER) AS l_returnflag_was_missing,
  {', '.join(f'CAST({rf} = {chr(39)}{lv}{chr(39)} AS INTEGER) AS l_returnflag_{lv}' for lv in levels_rf[1:])},
  {', '.join(f'CAST(l_linestatus = {chr(39)}{lv}{chr(39)} AS INTEGER) AS l_linestatus_{lv}' for lv in levels_ls[1:])}
FROM {LI_CLEAN} WHERE NOT is_train"""


CLEANER_SQL = _flags_sql()


def _fit_cleaner(spark, sf):
    li = lineitem_clean_input(spark, sf)
    return li, C.TableCleaner().fit(li.where("is_train").drop("is_train"))


@query("cleaner_fit_transform", CLEANER_SQL)
def cleaner_fit_transform(spark, sf):
    li, model = _fit_cleaner(spark, sf)
    return model.transform(li.where(~F.col("is_train")).drop("is_train"))


@query("cleaner_reload", CLEANER_SQL)
def cleaner_reload(spark, sf):
    li, model = _fit_cleaner(spark, sf)
    path = scratch_path(spark, f"cleaner_reload_{uuid.uuid4().hex}")
    model.save(spark, path)
    reloaded = C.TableCleanerModel.load(spark, path)
    return reloaded.transform(li.where(~F.col("is_train")).drop("is_train"))


@query("time_order_violations", """SELECT count(*) FILTER (WHERE prev > ts) AS violations, count(*) AS n_rows FROM
  (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)""")
def time_order_violations(spark, sf):
    return C.time_order_violations(table(spark, sf, "events"), "ts", "event_id", ["user_id"])
