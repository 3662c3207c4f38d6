"""Column kinds and the dataset profile.

Two aggregate shapes cover every statistic, whatever the table width:

* **wide**: one ``agg`` with a handful of expressions per column (null counts, min/max,
  moments, quantiles, sniff counters). One pass, partial aggregation on the map side,
  a single-row result that is turned into one row per column with ``inline``.
* **long**: ``unpivot`` to ``(column, value)`` and one ``groupBy(column, value).count()``
  (distinct counts, top value, modes, top-k). Map-side combine collapses hot values
  before the shuffle, so a value holding a third of all rows costs one row per task.

Only the per-column result tables (bounded by the schema width) ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import (col_, is_integral_type, is_numeric_type, is_time_type, parse_datetime_text,
                                     parse_number_text)

# Fixed values (profile rules).
NEAR_CONSTANT_THRESHOLD = 0.99
ID_LIKE_UNIQUE_RATIO = 0.98
MAX_CATEGORICAL_TARGET_CARDINALITY = 20
TEXT_AVG_LENGTH_THRESHOLD = 25
TOKEN_PATTERN = r"[A-Za-z0-9']+"


def _cols(df: DataFrame, cols=None) -> list[str]:
    return list(cols) if cols is not None else list(df.columns)


def _inline(df: DataFrame, structs) -> DataFrame:
    """Aggregate ``structs`` (one per column) in one pass and return one row per struct."""
    return df.agg(F.array(*structs).alias("_rows")).select(F.inline("_rows"))


def long_values(df: DataFrame, cols=None) -> DataFrame:
    """``(column, value)`` pairs with the value as text; NULLs dropped."""
    cols = _cols(df, cols)
    casted = df.select(*[col_(c).cast("string").alias(c) for c in cols])
    return (casted.unpivot([], [col_(c) for c in cols], "column", "value")
            .where(F.col("value").isNotNull()))


def value_counts(df: DataFrame, cols=None) -> DataFrame:
    """``(column, value, count)`` for every non-null value of every column (one shuffle)."""
    return long_values(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def _native(c: str, dt):
    """A value as ``(whole, real, text)``, so that equal values are equal as text is: numbers are not written out, only zeros
    are, since ``-0.0`` and ``0.0`` differ as text."""
    x, whole, real, text = col_(c), F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if is_integral_type(dt):
        whole = x.cast("bigint")
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        real, text = x.cast("double"), F.when(x == 0, x.cast("string"))
    else:
        text = x.cast("string")
    return F.struct(whole.alias("whole"), real.alias("real"), text.alias("text")).alias(c)


def native_counts(df: DataFrame, cols=None) -> DataFrame:
    """``(column, whole, real, text, count)``: ``value_counts`` where the value as text is not needed."""
    cols = _cols(df, cols)
    long = df.select(*[_native(c, df.schema[c].dataType) for c in cols]).unpivot([], [col_(c) for c in cols], "column", "value")
    long = long.select("column", "value.whole", "value.real", "value.text").where(
        F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull())
    return long.groupBy("column", "whole", "real", "text").agg(F.count(F.lit(1)).alias("count"))


def dtype_table(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


# ----------------------------------------------------------------------------- P03–P05 sniffing

def _sniff_struct(c: str, text: bool):
    """Counters of one column: rows, non-nulls and, for text, how many parse as datetime / number and the mean length."""
    none = F.lit(None)
    return F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count(col_(c)).alias("n_nonnull"),
                    (F.count(parse_datetime_text(c)) if text else none.cast("bigint")).alias("n_datetime"),
                    (F.count(parse_number_text(c)) if text else none.cast("bigint")).alias("n_numeric"),
                    (F.avg(F.length(col_(c))) if text else none.cast("double")).alias("avg_length"))


def sniff_strings(df: DataFrame, cols=None) -> DataFrame:
    """Per string column: non-null count, how many parse as datetime / number, mean length.

    Reference sniffers look at the first 20 non-nulls; here all non-nulls are used so the
    answer does not depend on partition order."""
    cols = [c for c in _cols(df, cols) if isinstance(df.schema[c].dataType, T.StringType)]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, n_nonnull bigint, n_datetime bigint, n_numeric bigint, avg_length double")
    return _inline(df, [_sniff_struct(c, True) for c in cols]).drop("n_rows")


def column_kinds(df: DataFrame, target: str | None = None, snapshot: bool = False, sniffed=None) -> DataFrame:
    """``(column, dtype, kind)``; order bool → datetime → numeric → target → text → categorical.

    ``snapshot=True`` is the EDA-snapshot variant: numeric text counts as numeric and the
    target rule is not applied."""
    spark = df.sparkSession
    sniffed = sniff_strings(df).collect() if sniffed is None else sniffed  # one row per column
    sniff = {r["column"]: r for r in sniffed if isinstance(df.schema[r["column"]].dataType, T.StringType)}
    rows = []
    for pos, f in enumerate(df.schema.fields):
        dt = f.dataType
        s = sniff.get(f.name)
        nonnull = s["n_nonnull"] if s else 0
        if isinstance(dt, T.BooleanType):
            kind = "boolean"
        elif is_time_type(dt) or (s and nonnull > 0 and s["n_datetime"] == nonnull):
            kind = "datetime"
        elif is_numeric_type(dt) or (snapshot and s and nonnull > 0 and s["n_numeric"] == nonnull):
            kind = "numerical"
        elif not snapshot and target is not None and f.name == target:
            kind = "categorical"
        elif s and nonnull > 0 and s["avg_length"] >= TEXT_AVG_LENGTH_THRESHOLD:
            kind = "text"
        else:
            kind = "categorical"
        looks_numeric = bool(s and nonnull > 0 and s["n_numeric"] == nonnull)
        rows.append((f.name, pos, dt.simpleString(), kind, looks_numeric))
    return spark.createDataFrame(rows, "column string, position int, dtype string, kind string, "
                                       "looks_numeric boolean")


# ----------------------------------------------------------------------------- P06–P13 statistics

def missing_counts(df: DataFrame, cols=None) -> DataFrame:
    """``(column, n_rows, missing_count, missing_pct)``."""
    cols = _cols(df, cols)
    n = F.count(F.lit(1))
    structs = [F.struct(F.lit(c).alias("column"), n.alias("n_rows"),
                        (n - F.count(col_(c))).alias("missing_count"),
                        F.when(n > 0, F.round((n - F.count(col_(c))) * 100.0 / n, 2)).otherwise(0.0)
                        .alias("missing_pct")) for c in cols]
    return _inline(df, structs)


def distinct_counts(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """``(column, distinct_count, top_count)`` over non-nulls.

    Exact mode goes through the long ``(column, value)`` form (one shuffle, map-side
    combined). ``approx=True`` uses HyperLogLog++ in a single wide pass and reports no
    top count."""
    cols = _cols(df, cols)
    if approx:
        structs = [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(col_(c)).alias("distinct_count"),
                            F.lit(None).cast("bigint").alias("top_count")) for c in cols]
        return _inline(df, structs)
    per_col = (native_counts(df, cols).groupBy("column")
               .agg(F.count(F.lit(1)).alias("distinct_count"), F.max("count").alias("top_count")))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(per_col, "column", "left")
            .select("column", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), "top_count"))


def numeric_stats(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """min/max/mean/median/std(ddof=1) per numeric column, rounded to 4; std 0 for one row.

    The exact median comes by rank refinement (``quantile_table``); ``approx=True`` uses
    ``percentile_approx`` inside the single wide pass instead."""
    from tabflow.functions.quantiles import quantile_columns
    cols = [c for c in _cols(df, cols) if is_numeric_type(df.schema[c].dataType)]
    structs = []
    for c in cols:
        x = col_(c).cast("double")
        med = F.percentile_approx(x, 0.5, 10000).cast("double") if approx else F.lit(None).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("column"),
            F.min(x).alias("min"), F.max(x).alias("max"),
            F.round(F.avg(x), 4).alias("mean"), med.alias("median"),
            F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.round(F.stddev_samp(x), 4)).alias("std")))
    wide = _inline(df, structs)
    if not approx:
        med = quantile_columns(df, cols, [0.5], ["_m"])
        wide = wide.join(med, "column", "left").withColumn("median", F.col("_m")).drop("_m")
    return wide.select("column", "min", "max", "mean", F.round("median", 4).alias("median"), "std")


def datetime_range(df: DataFrame, cols=None) -> DataFrame:
    """P10: min, max and distinct days per datetime (or date-like text) column."""
    out = None
    for c in _cols(df, cols):
        dt = df.schema[c].dataType
        ts = col_(c).cast("timestamp_ntz") if is_time_type(dt) else parse_datetime_text(c).cast("timestamp_ntz")
        one = df.select(ts.alias("ts")).agg(
            F.lit(c).alias("column"), F.min("ts").alias("min"), F.max("ts").alias("max"),
            F.countDistinct(F.to_date("ts")).alias("distinct_days"))
        out = one if out is None else out.unionByName(one)
    return out


def text_tokens(df: DataFrame, cols=None) -> DataFrame:
    """``(column, token)`` rows: lower-cased ``[A-Za-z0-9']+`` tokens of every text value."""
    cols = _cols(df, cols)
    return (long_values(df, cols)
            .select("column", F.explode(F.regexp_extract_all("value", F.lit(TOKEN_PATTERN), 0)).alias("token"))
            .select("column", F.lower("token").alias("token")))


def text_stats(df: DataFrame, cols=None, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(column, vocab_size, avg_length)`` and ``(column, rank, token, count)`` top-k.

    Ties in the top-k break on the token text (the reference keeps first-seen order)."""
    cols = _cols(df, cols)
    lengths = _inline(df, [F.struct(F.lit(c).alias("column"),
                                    F.round(F.avg(F.length(col_(c))), 2).alias("avg_length")) for c in cols])
    counts = text_tokens(df, cols).groupBy("column", "token").agg(F.count(F.lit(1)).alias("count"))
    vocab = counts.groupBy("column").agg(F.count(F.lit(1)).alias("vocab_size"))
    stats = lengths.join(vocab, "column", "left").select(
        "column", F.coalesce("vocab_size", F.lit(0)).alias("vocab_size"), "avg_length")
    w = W.partitionBy("column").orderBy(F.desc("count"), F.asc("token"))
    top = (counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top_k)
           .select("column", "rank", "token", "count"))
    return stats, top


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (NULLs equal), and its percentage."""
    groups = df.groupBy(*[col_(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_row_count"),
    ).select("row_count", "duplicate_row_count",
             F.when(F.col("row_count") > 0,
                    F.round(F.col("duplicate_row_count") * 100.0 / F.col("row_count"), 2))
             .otherwise(F.lit(0.0)).alias("duplicate_row_pct"))


def avg_rows_per_value(df: DataFrame, cols=None) -> DataFrame:
    """Non-null rows per distinct value of each column."""
    cols = _cols(df, cols)
    return (native_counts(df, cols).groupBy("column")
            .agg(F.round(F.sum("count") / F.count(F.lit(1)), 4).alias("avg_rows_per_value"),
                 F.count(F.lit(1)).alias("distinct_count")))


# ----------------------------------------------------------------------------- P14 composed profile

def column_profile(df: DataFrame, target: str | None = None, approx: bool = False) -> DataFrame:
    """Row per column: dtype, kind, missing and distinct counts, constant flags.

    Two scans whatever the width: one wide (nulls and sniffing), one long (distincts)."""
    wide = _inline(df, [_sniff_struct(f.name, isinstance(f.dataType, T.StringType)) for f in df.schema.fields]).collect()
    kinds = column_kinds(df, target, sniffed=wide)
    n, missing = F.col("n_rows"), F.col("missing_count")
    miss = (df.sparkSession.createDataFrame([(r["column"], r["n_rows"], r["n_rows"] - r["n_nonnull"]) for r in wide],
                                            "column string, n_rows bigint, missing_count bigint")
            .withColumn("missing_pct", F.when(n > 0, F.round(missing * 100.0 / n, 2)).otherwise(0.0)))
    dist = distinct_counts(df, approx=approx)
    prof = kinds.join(miss, "column").join(dist, "column")
    nonmissing = F.col("n_rows") - F.col("missing_count")
    return prof.select(
        "column", "position", "dtype", "kind", "looks_numeric", "missing_count", "missing_pct",
        F.col("distinct_count").alias("unique_count"),
        F.when(F.col("n_rows") > 0, F.round(F.col("distinct_count") * 100.0 / F.col("n_rows"), 2))
        .otherwise(0.0).alias("unique_pct"),
        (F.col("distinct_count") <= 1).alias("is_constant"),
        ((F.col("distinct_count") > 1) & (nonmissing > 0) &
         (F.col("top_count") / nonmissing >= NEAR_CONSTANT_THRESHOLD)).alias("is_near_constant"),
        "n_rows")


def dataset_profile(df: DataFrame, target: str | None = None, profile: DataFrame | None = None) -> DataFrame:
    """One-row summary: sizes, duplicates, column lists per kind, constant lists."""
    prof = profile if profile is not None else column_profile(df, target)
    dup = duplicate_rows(df)

    def names(cond):
        return F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("column")))), ",")

    summary = prof.agg(
        F.count(F.lit(1)).alias("column_count"),
        names(F.col("kind") == "numerical").alias("numerical_columns"),
        names(F.col("kind") == "categorical").alias("categorical_columns"),
        names(F.col("kind") == "text").alias("text_columns"),
        names(F.col("kind") == "datetime").alias("datetime_columns"),
        names(F.col("kind") == "boolean").alias("boolean_columns"),
        names(F.col("is_constant")).alias("constant_columns"),
        names(F.col("is_near_constant")).alias("near_constant_columns"))
    # both sides are single-row aggregates; joined on a constant key
    return dup.withColumn("_k", F.lit(1)).join(summary.withColumn("_k", F.lit(1)), "_k").drop("_k")


def is_integer_dtype(dtype: str) -> bool:
    return dtype in ("tinyint", "smallint", "int", "bigint")


__all__ = ["column_kinds", "sniff_strings", "missing_counts", "distinct_counts", "numeric_stats", "datetime_range",
           "text_stats", "text_tokens", "duplicate_rows", "avg_rows_per_value", "column_profile", "dataset_profile",
           "long_values", "value_counts", "is_integral_type"]
