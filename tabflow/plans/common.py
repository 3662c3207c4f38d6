"""Shared inputs for registered queries: the same derived views in Spark and in DuckDB SQL.

Test tables hold no nulls, numeric text or sentinels, so those are injected by a fixed
rule that both engines evaluate identically (SURVEY §7.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.plans.registry import table

# DuckDB spellings of tabflow.functions.exprs helpers.
SQL_DATETIME = ("coalesce(try_strptime({x}, '%Y-%m-%d %H:%M:%S'), try_strptime({x}, '%Y-%m-%dT%H:%M:%S'), "
                "try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%Y/%m/%d'), try_strptime({x}, '%m/%d/%Y'))")
SQL_NUMBER = ("CASE WHEN regexp_matches(trim({x}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') "
              "THEN try_cast(trim({x}) AS DOUBLE) END")
SQL_RANGE_RE = "'^\\s*(-?\\d+(?:\\.\\d+)?)\\s*-\\s*(-?\\d+(?:\\.\\d+)?)\\s*$'"
SQL_NUM_OR_RANGE = ("coalesce(" + SQL_NUMBER + ", (try_cast(nullif(regexp_extract(trim({x}), " + SQL_RANGE_RE +
                    ", 1), '') AS DOUBLE) + try_cast(nullif(regexp_extract(trim({x}), " + SQL_RANGE_RE +
                    ", 2), '') AS DOUBLE)) / 2.0)")


def sql_hash_unit(*exprs: str, seed: int = 42) -> str:
    key = "concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


def sql_hash_int(*exprs: str, seed: int = 42) -> str:
    key = "concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::UBIGINT::BIGINT)"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# ----------------------------------------------------------------------------- orders with gaps

def orders_gaps(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


ORDERS_GAPS = """(SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  o_orderstatus,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders)"""


def orders_text(spark: SparkSession, sf: str) -> DataFrame:
    """orders with date, price and key as text (CSV-like input)."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                    F.col("o_orderdate").cast("string").alias("o_orderdate"),
                    F.col("o_totalprice").cast("string").alias("o_totalprice"),
                    "o_orderpriority", "o_orderstatus")


ORDERS_TEXT = """(SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
  CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderpriority, o_orderstatus FROM orders)"""


def part_text(spark: SparkSession, sf: str) -> DataFrame:
    """part with ``p_size`` as text and a range column ``size_range`` (every 4th row ``a - b``)."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    rng = F.when(k % 4 == 0, F.concat_ws(" - ", F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string"))) \
        .otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size_text"),
                    rng.alias("size_range"), "p_retailprice")


PART_TEXT = """(SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size_text,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) || ' - ' || CAST(p_size + 10 AS VARCHAR)
       ELSE CAST(p_size AS VARCHAR) END AS size_range, p_retailprice FROM part)"""


def lineitem_derived(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem numeric columns plus a constant, a near-constant and a leaking copy."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     "l_returnflag", "l_linestatus",
                     F.lit("x").alias("l_const"),
                     F.when(F.col("l_orderkey") % 200 == 0, 1).otherwise(0).alias("l_rare"),
                     (F.col("l_extendedprice") * 2 + 1).alias("l_price_copy"))


LINEITEM_DERIVED = """(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, 'x' AS l_const,
  CASE WHEN l_orderkey % 200 = 0 THEN 1 ELSE 0 END AS l_rare,
  l_extendedprice * 2 + 1 AS l_price_copy FROM lineitem)"""


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order date: ``(ds date, sales double, n_orders bigint)``."""
    o = table(spark, sf, "orders")
    return (o.groupBy(F.to_date("o_orderdate").alias("ds"))
            .agg(F.sum("o_totalprice").alias("sales"), F.count(F.lit(1)).alias("n_orders")))


DAILY_ORDERS = """(SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS sales, count(*) AS n_orders
FROM orders GROUP BY 1)"""


def daily_orders_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    """``(entity, ds, y)``: order value per priority and day — five series."""
    o = table(spark, sf, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("ds"))
            .agg(F.sum("o_totalprice").alias("y")))


DAILY_BY_PRIORITY = """(SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS y
FROM orders GROUP BY 1, 2)"""
