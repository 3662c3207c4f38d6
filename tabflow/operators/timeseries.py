"""Time-series signals.

Calendar work happens on *distinct dates* (bounded by the calendar span, not the row
count); row-level order statistics use ``global_row_index`` instead of a global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import col_, is_time_type, parse_datetime_text
from tabflow.functions.ordering import global_row_index

# Fixed values.
MIN_ROWS_FOR_SEASONALITY = 14
SEASONALITY_CV_THRESHOLD = 0.1
MIN_ROWS_FOR_TREND = 5
TREND_CORRELATION_THRESHOLD = 0.3
FREQ_STEP_DAYS = {"D": 1, "W": 7}


def _ts(df: DataFrame, c: str):
    return col_(c).cast("timestamp_ntz") if is_time_type(df.schema[c].dataType) else parse_datetime_text(c)


def aligned_pairs(df: DataFrame, time_col: str, target_col: str) -> DataFrame:
    """``(ts, y)`` where both the time and the numeric target parse."""
    y = F.col(target_col).cast("string").try_cast("double") if not _numeric(df, target_col) \
        else F.col(target_col).cast("double")
    return df.select(_ts(df, time_col).alias("ts"), y.alias("y")).where(
        F.col("ts").isNotNull() & F.col("y").isNotNull())


def _numeric(df, c):
    from tabflow.functions.exprs import is_numeric_type
    return is_numeric_type(df.schema[c].dataType)


def infer_frequency(df: DataFrame, time_col: str) -> DataFrame:
    """Modal gap in days between consecutive distinct timestamps → ``D``/``W``/``M``.

    Needs ≥3 distinct values; ties in the mode take the smallest gap. Consecutive pairs
    come from an equi-join on global positions, so no single task sees every value."""
    d = df.select(_ts(df, time_col).alias("ts")).where(F.col("ts").isNotNull()).distinct()
    d = global_row_index(d, ["ts"])
    nxt = d.select((F.col("idx") - 1).alias("idx"), F.col("ts").alias("ts_next"))
    gaps = d.join(nxt, "idx").select(
        F.floor((F.unix_micros(F.col("ts_next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
                / F.lit(86400 * 1000000)).alias("days"))
    modal = gaps.groupBy("days").agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by("days", F.struct(-F.col("n"), F.col("days"))).alias("modal_gap_days"))
    n_distinct = d.agg(F.count(F.lit(1)).alias("n_distinct"))
    g = F.col("modal_gap_days")
    freq = F.when(F.col("n_distinct") < 3, F.lit(None)).when(g == 1, "D").when(g == 7, "W") \
        .when((g >= 28) & (g <= 31), "M")
    return (n_distinct.withColumn("_k", F.lit(1)).join(modal.withColumn("_k", F.lit(1)), "_k")
            .select("n_distinct", F.when(F.col("n_distinct") >= 3, g).alias("modal_gap_days"),
                    freq.cast("string").alias("frequency")))


def missing_periods(df: DataFrame, time_col: str, frequency: str | None = "D") -> DataFrame:
    """Expected calendar dates between min and max minus those present (anti join)."""
    dates = df.select(F.to_date(_ts(df, time_col)).alias("d")).where(F.col("d").isNotNull()).distinct()
    bounds = dates.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    freq = frequency or "D"
    if freq == "M":
        seq = F.sequence(F.last_day("lo"), F.col("hi"), F.expr("INTERVAL 1 MONTH"))
    else:
        seq = F.sequence(F.col("lo"), F.col("hi"), F.expr(f"INTERVAL {FREQ_STEP_DAYS.get(freq, 1)} DAY"))
    expected = bounds.where(F.col("lo").isNotNull()).select(F.explode(seq).alias("d"))
    missing = expected.join(dates, "d", "left_anti")
    n_exp = expected.agg(F.count(F.lit(1)).alias("expected_periods"))
    n_miss = missing.agg(F.count(F.lit(1)).alias("missing_periods"))
    return (n_exp.withColumn("_k", F.lit(1)).join(n_miss.withColumn("_k", F.lit(1)), "_k")
            .select("expected_periods", "missing_periods",
                    F.when(F.col("expected_periods") > 0,
                           F.round(F.col("missing_periods") * 100.0 / F.col("expected_periods"), 2))
                    .otherwise(0.0).alias("missing_periods_pct")))


def seasonality_dow(df: DataFrame, time_col: str, target_col: str) -> DataFrame:
    """Std of weekday means / overall std (both sample std); flag at ≥0.1, needs ≥14 rows."""
    p = aligned_pairs(df, time_col, target_col).withColumn("dow", F.weekday("ts"))
    overall = p.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("sd"))
    means = p.groupBy("dow").agg(F.avg("y").alias("m")).agg(F.stddev_samp("m").alias("sd_dow"),
                                                          F.count(F.lit(1)).alias("n_dow"))
    j = overall.withColumn("_k", F.lit(1)).join(means.withColumn("_k", F.lit(1)), "_k")
    ok = (F.col("n") >= MIN_ROWS_FOR_SEASONALITY) & (F.col("sd") != 0) & (F.col("n_dow") >= 2)
    cv = F.when(ok, F.col("sd_dow") / F.col("sd"))
    return j.select("n", F.round(cv, 6).alias("cv"),
                    F.coalesce(cv >= SEASONALITY_CV_THRESHOLD, F.lit(False)).alias("seasonality_detected"))


def trend_corr(df: DataFrame, time_col: str, target_col: str) -> DataFrame:
    """Pearson r between time rank (ties broken by value) and value; flag at |r| ≥ 0.3."""
    p = global_row_index(aligned_pairs(df, time_col, target_col), ["ts", "y"])
    agg = p.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("sd"),
                F.try_divide(F.covar_pop("idx", "y"), F.stddev_pop("idx") * F.stddev_pop("y")).alias("r"))
    ok = (F.col("n") >= MIN_ROWS_FOR_TREND) & (F.col("sd") != 0)
    r = F.when(ok, F.col("r"))
    return agg.select("n", F.round(r, 6).alias("trend_r"),
                      F.coalesce(F.abs(r) >= TREND_CORRELATION_THRESHOLD, F.lit(False)).alias("trend_detected"),
                      F.when(r > 0, "increasing").when(r < 0, "decreasing").alias("direction"))


def time_range(df: DataFrame, time_col: str) -> DataFrame:
    t = _ts(df, time_col)
    return df.select(t.alias("ts")).agg(F.min("ts").alias("min"), F.max("ts").alias("max"),
                                        F.countDistinct(F.to_date("ts")).alias("distinct_days"))


def timeseries_signals(df: DataFrame, time_col: str, target_col: str | None, item_col: str | None = None) -> DataFrame:
    """One row joining frequency, range, missing periods, seasonality and trend."""
    freq_df = infer_frequency(df, time_col)
    freq = freq_df.first()["frequency"]  # one row
    parts = [freq_df.select("frequency"), time_range(df, time_col), missing_periods(df, time_col, freq)]
    if target_col:
        parts.append(seasonality_dow(df, time_col, target_col).select("cv", "seasonality_detected"))
        parts.append(trend_corr(df, time_col, target_col).select("trend_r", "trend_detected"))
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k").select(F.lit(time_col).alias("datetime_column"),
                                 F.lit(item_col).cast("string").alias("item_column"), "*")
