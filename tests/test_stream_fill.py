"""Forward fill of a stream from keyed state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabflow.operators.clean import TableCleaner
from tabflow.streaming.score import fill_forward_stream, read_parquet_stream, run_available_now, score_stream

SCHEMA = "id int, `e.x` string, ts timestamp_ntz, v double, c string"


def test_state_carries_values_over_micro_batches(spark, tmp_path):
    rng = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]), base + dt.timedelta(minutes=i // 2), None if rng.random() < 0.6 else float(i),
             None if rng.random() < 0.6 else f"t{i}") for i in range(200)]
    for k in range(4):
        part = rows[50 * k:50 * (k + 1)]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = read_parquet_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)
    out = fill_forward_stream(stream, ["v", "c"], ["e.x"], ["ts", "id"])
    run_available_now(out, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r["id"]: (r["v"], r["c"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want, last = {}, {}
    for i, e, _, v, c in sorted(rows):
        old = last.get(e, (None, None))
        last[e] = want[i] = (v if v is not None else old[0], c if c is not None else old[1])
    assert got == want


def test_a_cleaner_that_fills_along_time_is_refused(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), None if i % 3 else float(i)) for i in range(30)], "id int, ts timestamp_ntz, v double")
    model = TableCleaner(time_col="ts").fit(df)
    with pytest.raises(ValueError, match="fill_forward_stream"):
        score_stream(model, df)
    plain = TableCleaner().fit(df.select("v"))
    assert score_stream(plain, df.select("v"), keep=["v"]).where(F.col("v").isNull()).count() == 0
