"""Dataset summaries, fingerprints and run-record storage.

Run records are plain JSON-lines datasets: appends are ``write.mode("append").json``;
reads skip corrupt lines; "latest record per key" is a grouped ``max_by`` (map-side
combined, so a key with millions of records never lands whole in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.functions.exprs import col_, is_numeric_type
from tabflow.operators.profile import _inline, value_counts


def schema_summary(df: DataFrame) -> DataFrame:
    """Aggregates only, one row per column: dtype, missing %, numeric min/max/mean/std,
    distinct count and average rows per value for the rest."""
    n = F.count(F.lit(1))
    structs = []
    for f in df.schema.fields:
        c = f.name
        num = is_numeric_type(f.dataType)
        x = col_(c).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.when(n > 0, F.round((n - F.count(col_(c))) * 100.0 / n, 2)).otherwise(0.0).alias("missing_pct"),
            (F.min(x) if num else F.lit(None).cast("double")).alias("min"),
            (F.max(x) if num else F.lit(None).cast("double")).alias("max"),
            (F.round(F.avg(x), 4) if num else F.lit(None).cast("double")).alias("mean"),
            (F.round(F.stddev_samp(x), 4) if num else F.lit(None).cast("double")).alias("std")))
    wide = _inline(df, structs)
    others = [f.name for f in df.schema.fields if not is_numeric_type(f.dataType)]
    if not others:
        return wide.select("*", F.lit(None).cast("bigint").alias("distinct_count"),
                           F.lit(None).cast("double").alias("avg_rows_per_value"))
    per = value_counts(df, others).groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.round(F.sum("count") / F.count(F.lit(1)), 4)
        .alias("avg_rows_per_value"))
    return wide.join(per, "column", "left")


def preview_rows(df: DataFrame, order_cols, n: int = 5) -> DataFrame:
    """The first n rows in an explicit order (planned as a distributed top-k)."""
    return df.orderBy(*order_cols).limit(n)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint: row count and the sum of the first 32 bits of
    each row's md5 modulo 2**62, summed as decimals so that no table is too large for it
    (NULL spelled ``\\N`` so it differs from the empty string)."""
    row = F.concat_ws("|", *[F.coalesce(col_(c).cast("string"), F.lit("\\N")) for c in df.columns])
    h = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("row_count"), (F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)) % F.lit(1 << 62)).cast("bigint")
                  .alias("content_hash"))


def append_records(df: DataFrame, path: str) -> None:
    """Append run records as JSON lines."""
    df.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read a JSON-lines log, dropping lines that do not parse."""
    full = schema + ", _corrupt_record string"
    d = (spark.read.schema(full).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return d.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def parse_json_column(df: DataFrame, col: str, schema: str) -> DataFrame:
    """S07 on a text column: parse with ``from_json`` and drop rows whose text is not valid."""
    parsed = F.from_json(col_(col), schema + ", _corrupt_record string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return (df.withColumn("_j", parsed).where(F.col("_j").isNotNull() & F.col("_j._corrupt_record").isNull())
            .select("*", "_j.*").drop("_j", "_corrupt_record"))


def latest_per_key(df: DataFrame, key_cols, seq_col: str) -> DataFrame:
    """The record with the greatest ``seq_col`` per key (last line wins / upsert)."""
    others = [c for c in df.columns if c not in key_cols]
    return (df.groupBy(*key_cols).agg(F.max_by(F.struct(*others), F.col(seq_col)).alias("_r"))
            .select(*key_cols, "_r.*"))


def run_history(df: DataFrame, time_col: str, status_col: str | None = None, status=None, limit: int = 20,
                tiebreak=()) -> DataFrame:
    """Filter by status, newest first, limited (a top-k report)."""
    out = df
    if status_col and status is not None:
        out = out.where(F.col(status_col) == status)
    return out.orderBy(F.col(time_col).desc(), *[col_(c).desc() for c in tiebreak]).limit(limit)


def build_record(results: DataFrame, board: DataFrame, data: DataFrame | None = None, config: dict | None = None, error: str | None = None,
                 needs_clarification: bool = False, status: str | None = None, started: float | None = None) -> DataFrame:
    """One record per run of ``results``: configuration (JSON), the dataset's size and fingerprint, candidates and
    winner, all errors, runtime and library versions. Status: the given one, else ``error`` with an error of the run itself,
    ``needs_clarification``, or ``complete``; failed candidates are errors listed, not the run's status."""
    import json
    import platform
    import time

    import pyspark
    failed = F.concat(F.col("model"), F.lit(": "), F.col("error"))
    recs = results.groupBy("run_id").agg(
        F.countDistinct("model").alias("n_candidates"),
        F.sort_array(F.collect_set(F.struct("model", "metric", "value", "status"))).alias("candidates"),
        F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), failed))).alias("errors"))
    if error is not None:
        recs = recs.withColumn("errors", F.concat("errors", F.array(F.lit(error))))
    best = board.where("is_winner").select("run_id", F.col("model").alias("winner"), "primary_metric", F.col("value").alias("winner_value"))
    recs = recs.join(best, "run_id", "left")
    size = (None, None, None) if data is None else (*table_fingerprint(data).first(), len(data.columns))
    state = status or ("error" if error is not None else "needs_clarification" if needs_clarification else "complete")
    return recs.withColumns({
        "status": F.lit(state), "config": F.lit(json.dumps(config or {}, sort_keys=True)),
        "dataset_rows": F.lit(size[0]).cast("bigint"), "dataset_fingerprint": F.lit(size[1]).cast("bigint"), "dataset_columns": F.lit(size[2]).cast("int"),
        "runtime_seconds": F.lit(None if started is None else round(time.time() - started, 3)).cast("double"),
        "library_versions": F.lit(json.dumps({"python": platform.python_version(), "pyspark": pyspark.__version__}, sort_keys=True))})
