"""Registered queries for scoring streams with fitted cleaners and models (Z01): they equal the batch results."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabflow.functions.exprs import hash_unit
from tabflow.operators.clean import TableCleaner
from tabflow.plans.common import sql_hash_unit
from tabflow.plans.registry import query, table
from tabflow.session import scratch_path
from tabflow.streaming.score import fill_forward_stream, read_parquet_stream, run_available_now, score_stream


def _prep(df):
    return df.select("event_id", "user_id", "event_type",
                     F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))


EV = """(SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value
  FROM events)"""
TRAIN = f"{sql_hash_unit('event_id')} < 0.8"
LEVELS = ["click", "error", "purchase", "signup", "view"]


@query("stream_score", f"""SELECT event_id, user_id,
  coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EV} WHERE {TRAIN})) AS value,
  CAST(value IS NULL AS INTEGER) AS value_was_missing,
  {', '.join(f"CAST(event_type = '{lv}' AS INTEGER) AS event_type_{lv}" for lv in LEVELS[1:])}
FROM {EV}""")
def stream_score(spark, sf):
    ev = table(spark, sf, "events")
    model = TableCleaner().fit(_prep(ev).where(hash_unit("event_id") < 0.8))
    stream = _prep(read_parquet_stream(spark, sf, ev.schema, file_glob="events.parquet"))
    out = scratch_path(spark, f"stream_score_{uuid.uuid4().hex}")
    run_available_now(score_stream(model, stream), out + "/data", out + "/_checkpoint")
    return spark.read.parquet(out + "/data")


FILLED = f"""(SELECT event_id, user_id, ts, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value
  FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN NULL ELSE value END AS value FROM events))"""


@query("stream_fill_predict", f"""WITH f AS {FILLED}, tr AS (SELECT * FROM f WHERE {TRAIN}),
c AS (SELECT event_id, user_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM tr)) AS value FROM f),
m AS (SELECT regr_slope(event_id % 97, value) AS k, regr_intercept(event_id % 97, value) AS a FROM c WHERE {TRAIN})
SELECT event_id, user_id, round(value, 4) AS value, round(a + k * value, 4) AS prediction FROM c, m""")
def stream_fill_predict(spark, sf):
    """Events arrive in four files by time; each user's gaps are filled forward from state, gaps without a past by the fitted
    median, and a fitted regression predicts on the stream."""
    from tabflow.operators.clean import fill_forward_backward  # the batch fill gives the training rows
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    both = fill_forward_backward(ev, ["value"], ["ts", "event_id"], ["user_id"])
    first = ev.where("value IS NOT NULL").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    past = both.join(first, "user_id", "left").withColumn("value", F.when(F.struct("ts", "event_id") >= F.col("first"), F.col("value"))).drop("first")
    train = past.where(hash_unit("event_id") < 0.8)
    cleaner = TableCleaner(target="label", text_cols=[], encode=False).fit(train.select("value", (F.col("event_id") % 97).cast("double").alias("label")))
    # Keys pass the cleaner untouched: it was fitted on the value alone.
    fit_rows = cleaner.transform(train.select("event_id", "user_id", "value", (F.col("event_id") % 97).cast("double").alias("label")))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["value"], outputCol="features"),
                              LinearRegression(featuresCol="features", labelCol="label", solver="normal")]).fit(fit_rows)
    base = scratch_path(spark, f"stream_fill_{uuid.uuid4().hex}")
    # Four files in time order, as an upstream job would deliver them, one after the other.
    cuts = [r[0] for r in ev.select(F.percentile_approx("ts", [0.25, 0.5, 0.75], 1000).alias("q")).select(F.explode("q")).collect()]
    part = sum(((F.col("ts") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for i in range(len(cuts) + 1):
        ev.where(part == i).coalesce(1).write.mode("append").parquet(base + "/in")
    stream = read_parquet_stream(spark, base + "/in", ev.schema, max_files_per_trigger=1)
    filled = fill_forward_stream(stream, ["value"], ["user_id"], ["ts", "event_id"])
    scored = score_stream(cleaner, filled, fitted, ["event_id", "user_id", "value", "prediction"])
    run_available_now(scored, base + "/data", base + "/_checkpoint")
    out = spark.read.parquet(base + "/data")
    return out.select("event_id", "user_id", F.round("value", 4).alias("value"), F.round("prediction", 4).alias("prediction"))
