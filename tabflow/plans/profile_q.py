"""Registered queries for column kinds and the profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.operators import profile as P
from tabflow.plans.common import (LINEITEM_DERIVED, ORDERS_GAPS, ORDERS_TEXT, PART_TEXT, SQL_DATETIME, SQL_NUMBER,
                                  lineitem_derived, orders_gaps, orders_text, part_text, union_all)
from tabflow.plans.registry import query, table

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
          "l_tax"]


def _sniff_sql(src: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS n_nonnull, count({SQL_DATETIME.format(x=c)}) AS n_datetime,
  count({SQL_NUMBER.format(x=c)}) AS n_numeric, round(avg(length({c})), 4) AS avg_length,
  count({c}) > 0 AND count({SQL_DATETIME.format(x=c)}) = count({c}) AS looks_datetime,
  count({c}) > 0 AND count({SQL_NUMBER.format(x=c)}) = count({c}) AS looks_numeric,
  coalesce(avg(length({c})) >= 25, false) AS looks_text
FROM {src}""")
    return union_all(parts)


def _sniff(df, cols):
    s = P.sniff_strings(df, cols)
    return s.select("column", "n_nonnull", "n_datetime", "n_numeric", F.round("avg_length", 4).alias("avg_length"),
                    ((F.col("n_nonnull") > 0) & (F.col("n_datetime") == F.col("n_nonnull"))).alias("looks_datetime"),
                    ((F.col("n_nonnull") > 0) & (F.col("n_numeric") == F.col("n_nonnull"))).alias("looks_numeric"),
                    F.coalesce(F.col("avg_length") >= P.TEXT_AVG_LENGTH_THRESHOLD, F.lit(False)).alias("looks_text"))


@query("sniff_datetime", _sniff_sql(ORDERS_TEXT, ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"]))
def sniff_datetime(spark, sf):
    return _sniff(orders_text(spark, sf), ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"])


@query("sniff_numeric_text", _sniff_sql(PART_TEXT, ["p_size_text", "size_range", "p_brand"]))
def sniff_numeric_text(spark, sf):
    return _sniff(part_text(spark, sf), ["p_size_text", "size_range", "p_brand"])


@query("sniff_text", union_all([_sniff_sql("documents", ["text", "lang", "source"]),
                                _sniff_sql("nation", ["n_name"])]))
def sniff_text(spark, sf):
    return _sniff(table(spark, sf, "documents"), ["text", "lang", "source"]).unionByName(
        _sniff(table(spark, sf, "nation"), ["n_name"]))


def _kind_sql(src, string_cols, fixed: dict, target=None, snapshot=False):
    parts = [f"""SELECT '{c}' AS "column", '{k}' AS kind""" for c, k in fixed.items()]
    for c in string_cols:
        dt = SQL_DATETIME.format(x=c)
        num = SQL_NUMBER.format(x=c)
        rules = [f"WHEN count({c}) > 0 AND count({dt}) = count({c}) THEN 'datetime'"]
        if snapshot:
            rules.append(f"WHEN count({c}) > 0 AND count({num}) = count({c}) THEN 'numerical'")
        elif target == c:
            rules.append("WHEN true THEN 'categorical'")
        rules.append(f"WHEN count({c}) > 0 AND avg(length({c})) >= 25 THEN 'text'")
        parts.append(f"""SELECT '{c}' AS "column", CASE {' '.join(rules)} ELSE 'categorical' END AS kind FROM {src}""")
    return union_all(parts)


@query("column_kinds", _kind_sql("documents", ["text", "lang", "source"], {"doc_id": "numerical",
                                                                            "n_chars": "numerical"}))
def column_kinds(spark, sf):
    return P.column_kinds(table(spark, sf, "documents")).select("column", "kind")


@query("column_kinds_snapshot", _kind_sql(PART_TEXT, ["p_name", "p_brand", "p_type", "p_size_text", "size_range"],
                                          {"p_partkey": "numerical", "p_retailprice": "numerical"}, snapshot=True))
def column_kinds_snapshot(spark, sf):
    return P.column_kinds(part_text(spark, sf), snapshot=True).select("column", "kind")


def _missing_sql(src, cols):
    return union_all([f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing_count,
  CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) * 100.0 / count(*), 2) ELSE 0.0 END AS missing_pct
FROM {src}""" for c in cols])


ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("missing_counts", _missing_sql(ORDERS_GAPS, ORDERS_COLS))
def missing_counts(spark, sf):
    return P.missing_counts(orders_gaps(spark, sf))


def _distinct_sql(src, cols):
    return union_all([f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_count,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count
FROM {src}""" for c in cols])


LI_ALL = LI_NUM + ["l_returnflag", "l_linestatus", "l_shipdate"]


@query("distinct_counts", _distinct_sql("lineitem", LI_ALL))
def distinct_counts(spark, sf):
    return P.distinct_counts(table(spark, sf, "lineitem"))


LID_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            "l_linestatus", "l_const", "l_rare", "l_price_copy"]


@query("constant_flags", union_all([f"""SELECT '{c}' AS "column", count(DISTINCT {c}) <= 1 AS is_constant,
  count(DISTINCT {c}) > 1 AND count({c}) > 0 AND
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {LINEITEM_DERIVED} WHERE {c} IS NOT NULL GROUP BY {c})) / count({c})
    >= 0.99 AS is_near_constant
FROM {LINEITEM_DERIVED}""" for c in LID_COLS]))
def constant_flags(spark, sf):
    return P.column_profile(lineitem_derived(spark, sf)).select("column", "is_constant", "is_near_constant")


@query("numeric_stats", union_all([f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  round(avg({c}::DOUBLE), 4) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
  CASE WHEN count({c}) = 1 THEN 0.0 ELSE round(stddev_samp({c}::DOUBLE), 4) END AS std
FROM lineitem""" for c in LI_NUM]))
def numeric_stats(spark, sf):
    return P.numeric_stats(table(spark, sf, "lineitem"), LI_NUM)


@query("datetime_range", """SELECT 'ts' AS "column", min(ts) AS min, max(ts) AS max,
  count(DISTINCT CAST(ts AS DATE)) AS distinct_days FROM events""")
def datetime_range(spark, sf):
    return P.datetime_range(table(spark, sf, "events"), ["ts"])


TOKENS_SQL = """(SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9'']+'))) AS token FROM documents
                 WHERE text IS NOT NULL)"""


@query("text_stats", f"""SELECT 'text' AS "column",
  (SELECT count(DISTINCT token) FROM {TOKENS_SQL}) AS vocab_size,
  round(avg(length(text)), 2) AS avg_length FROM documents""")
def text_stats(spark, sf):
    stats, _ = P.text_stats(table(spark, sf, "documents"), ["text"])
    return stats


@query("text_top_tokens", f"""SELECT 'text' AS "column", rank, token, count FROM (
  SELECT token, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, token ASC) AS rank
  FROM {TOKENS_SQL} GROUP BY token) WHERE rank <= 10""")
def text_top_tokens(spark, sf):
    _, top = P.text_stats(table(spark, sf, "documents"), ["text"])
    return top


DUP_SRC = "(SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)"


@query("duplicate_rows", f"""SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM
  {DUP_SRC})) AS duplicate_row_count,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DUP_SRC}))) * 100.0 / count(*), 2)
    AS duplicate_row_pct FROM {DUP_SRC}""")
def duplicate_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return P.duplicate_rows(li)


@query("avg_rows_per_value", union_all([f"""SELECT '{c}' AS "column",
  round(count({c}) / count(DISTINCT {c}), 4) AS avg_rows_per_value, count(DISTINCT {c}) AS distinct_count
FROM {ORDERS_GAPS}""" for c in ["o_orderstatus", "o_orderpriority", "o_custkey"]]))
def avg_rows_per_value(spark, sf):
    return P.avg_rows_per_value(orders_gaps(spark, sf), ["o_orderstatus", "o_orderpriority", "o_custkey"])


CUST_KIND = {"c_custkey": "numerical", "c_name": "categorical", "c_nationkey": "numerical",
             "c_acctbal": "numerical", "c_mktsegment": "categorical"}


@query("dataset_profile", """SELECT count(*) AS row_count,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicate_row_count,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer))) * 100.0 / count(*), 2)
    AS duplicate_row_pct,
  CAST(5 AS BIGINT) AS column_count,
  'c_acctbal,c_custkey,c_nationkey' AS numerical_columns,
  CASE WHEN avg(length(c_name)) >= 25 THEN '' ELSE 'c_mktsegment,c_name' END AS categorical_columns,
  '' AS text_columns, '' AS datetime_columns, '' AS boolean_columns,
  concat_ws(',', CASE WHEN count(DISTINCT c_acctbal) <= 1 THEN 'c_acctbal' END,
                 CASE WHEN count(DISTINCT c_custkey) <= 1 THEN 'c_custkey' END,
                 CASE WHEN count(DISTINCT c_mktsegment) <= 1 THEN 'c_mktsegment' END,
                 CASE WHEN count(DISTINCT c_name) <= 1 THEN 'c_name' END,
                 CASE WHEN count(DISTINCT c_nationkey) <= 1 THEN 'c_nationkey' END) AS constant_columns,
  '' AS near_constant_columns
FROM customer""")
def dataset_profile(spark, sf):
    return P.dataset_profile(table(spark, sf, "customer"))
