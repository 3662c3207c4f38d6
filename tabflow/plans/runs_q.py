"""Registered queries for sources, sinks and run records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabflow.sources import runs as S
from tabflow.sources.tables import load_dataset, write_csv
from tabflow.plans.registry import query, table
from tabflow.session import scratch_path


@query("src_csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv_roundtrip(spark, sf):
    path = scratch_path(spark, f"nation_{uuid.uuid4().hex}.csv")
    write_csv(table(spark, sf, "nation").coalesce(1), path)
    return load_dataset(spark, path)


CUST = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True),
        ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]


def _summary_sql():
    parts = []
    for c, dt, num in CUST:
        if num:
            stats = (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, "
                     f"round(stddev_samp({c}), 4) AS std, NULL::BIGINT AS distinct_count, "
                     f"NULL::DOUBLE AS avg_rows_per_value")
        else:
            stats = (f"NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, "
                     f"count(DISTINCT {c}) AS distinct_count, round(count({c}) / count(DISTINCT {c}), 4) "
                     f"AS avg_rows_per_value")
        parts.append(f"""SELECT '{c}' AS "column", '{dt}' AS dtype,
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, {stats} FROM customer""")
    return "\nUNION ALL\n".join(parts)


@query("schema_summary", _summary_sql())
def schema_summary(spark, sf):
    return S.schema_summary(table(spark, sf, "customer"))


@query("preview_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_rows(spark, sf):
    return S.preview_rows(table(spark, sf, "orders"), ["o_orderkey"], 5)


@query("table_fingerprint", """SELECT count(*) AS row_count, CAST(coalesce(sum(
  ('0x' || substr(md5(concat_ws('|', coalesce(CAST(n_nationkey AS VARCHAR), '\\N'), coalesce(n_name, '\\N'),
    coalesce(CAST(n_regionkey AS VARCHAR), '\\N'))), 1, 8))::UBIGINT::BIGINT), 0) AS BIGINT) AS content_hash
FROM nation""")
def table_fingerprint(spark, sf):
    return S.table_fingerprint(table(spark, sf, "nation"))


@query("run_log_append", """SELECT o_orderkey AS run_id, o_orderstatus AS status, o_totalprice AS value,
  CAST(2 AS BIGINT) AS seq FROM orders""")
def run_log_append(spark, sf):
    """S05 + S06 + S07: write records twice (seq 1 then 2) plus one corrupt line, read back,
    skip the corrupt line, keep the latest record per run id."""
    path = scratch_path(spark, f"run_log_{uuid.uuid4().hex}")
    recs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"),
                                             F.col("o_orderstatus").alias("status"),
                                             F.col("o_totalprice").alias("value"))
    S.append_records(recs.withColumn("seq", F.lit(1).cast("bigint")), path)
    S.append_records(recs.withColumn("seq", F.lit(2).cast("bigint")), path)
    spark.createDataFrame([("{\"run_id\": 1, \"status\": ",)], "value string").write.mode("append").text(path)
    back = S.read_records(spark, path, "run_id bigint, status string, value double, seq bigint")
    return S.latest_per_key(back, ["run_id"], "seq")


@query("latest_per_key", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id,
  arg_max(ts, (ts, event_id)) AS ts, arg_max(event_type, (ts, event_id)) AS event_type,
  arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def latest_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    e = e.withColumn("_seq", F.struct("ts", "event_id"))
    return S.latest_per_key(e, ["user_id"], "_seq").drop("_seq")


@query("skip_corrupt_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM (
  SELECT event_id, CASE WHEN event_id % 13 = 0 THEN left(props, 4) ELSE props END AS props FROM events)
WHERE json_valid(props)""")
def skip_corrupt_json(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 13 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
        .alias("props"))
    return S.parse_json_column(e, "props", "k bigint").select("event_id", "k")


@query("run_history", """SELECT o_orderkey, o_orderdate, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def run_history(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return S.run_history(o, "o_orderdate", "o_orderstatus", "F", 20, tiebreak=["o_orderkey"])
