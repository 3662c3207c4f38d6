"""Exploratory statistics.

All per-column statistics are wide single-pass aggregates or long ``(column, value)``
group-bys; histograms need min/max first, so they take two passes. No statistic ever
pulls rows to the driver: only per-column (schema-bounded) rows are collected, to
bind bin edges and gates as literals.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import (col_, is_numeric_type, is_time_type, kurtosis_unbiased, parse_datetime_text,
                                     parse_numeric_or_range, safe_corr, skewness_unbiased)
from tabflow.functions.ordering import SLICE_ROWS, entity_positions, with_halo
from tabflow.operators.profile import _inline, long_values, value_counts

# Fixed values.
HISTOGRAM_BINS = 12
TOP_CATEGORIES = 10
KINDS = ("numerical", "categorical", "datetime", "boolean", "text")
NUMERIC_TEXT_MIN_PARSE_RATIO = 0.8


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def missing_pct(df: DataFrame, cols=None) -> DataFrame:
    """``(column, missing_pct)``."""
    cols = list(cols) if cols is not None else df.columns
    n = F.count(F.lit(1))
    return _inline(df, [F.struct(F.lit(c).alias("column"),
                                 F.when(n > 0, F.round((n - F.count(col_(c))) * 100.0 / n, 2)).alias("missing_pct"))
                        for c in cols])


def coerce_numeric_text(df: DataFrame, min_ratio: float = NUMERIC_TEXT_MIN_PARSE_RATIO) -> tuple[DataFrame, list[str]]:
    """Replace string columns where ≥ ``min_ratio`` of non-nulls parse as a number
    or a ``low - high`` range by the parsed doubles. Returns the frame and the columns changed."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df, []
    gate = _inline(df, [F.struct(F.lit(c).alias("column"), F.count(col_(c)).alias("n"),
                                 F.count(parse_numeric_or_range(c)).alias("parsed")) for c in strings]).collect()
    convert = [g["column"] for g in gate if g["n"] and g["parsed"] / g["n"] >= min_ratio]
    out = df.select(*[parse_numeric_or_range(c).alias(c) if c in convert else col_(c) for c in df.columns])
    return out, convert


def distribution_stats(df: DataFrame, cols=None, digits: int = 3) -> DataFrame:
    """Skew, kurtosis (bias-corrected), five numbers, zeros % per numeric column."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    from tabflow.functions.quantiles import quantile_columns
    structs = []
    for c in cols:
        x = col_(c).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n"),
            F.round(skewness_unbiased(x), digits).alias("skew"),
            F.round(kurtosis_unbiased(x), digits).alias("kurtosis"),
            F.min(x).alias("min"), F.max(x).alias("max"),
            F.round(F.avg((x == 0).cast("int")) * 100, 2).alias("zeros_pct")))
    q = quantile_columns(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return _inline(df, structs).join(q, "column", "left").select(
        "column", "n", "skew", "kurtosis", "min", "q1", "median", "q3", "max", "zeros_pct")


def correlation_matrix(df: DataFrame, cols=None, digits: int = 3) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered pair, rounded; undefined → NULL.

    One pass computes the d·(d+1)/2 distinct pairs; the mirror image is an ``explode``."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    structs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(safe_corr(a, b), digits).alias("r"))
               for a, b in combinations_with_replacement(cols, 2)]
    pairs = _inline(df, structs)
    both = F.array(F.struct(F.col("a").alias("column"), F.col("b").alias("other_column")),
                   F.struct(F.col("b").alias("column"), F.col("a").alias("other_column")))
    return (pairs.select(F.explode(F.array_distinct(both)).alias("p"), "r")
            .select("p.column", "p.other_column", "r"))


def _min_max(df, cols):
    return _inline(df, [F.struct(F.lit(c).alias("column"), F.min(col_(c).cast("double")).alias("mn"),
                                 F.max(col_(c).cast("double")).alias("mx"),
                                 F.count(col_(c)).alias("n")) for c in cols]).collect()


def histogram_equal_width(df: DataFrame, cols=None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between min and max, last bin closed; a single distinct value
    gives one bin holding every non-null. ``(column, bin, lo, hi, count)`` with empty bins."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    return _histogram(df, cols, bins, right_closed=False)


def histogram_right_closed(df: DataFrame, cols=None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``pd.cut``-style right-closed bins, lowest edge widened (the minimum falls in bin 1)."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    return _histogram(df, cols, bins, right_closed=True)


def _histogram(df, cols, bins, right_closed):
    spark = df.sparkSession
    rows = []
    exprs = []
    for m in _min_max(df, cols):
        c, mn, mx = m["column"], m["mn"], m["mx"]
        if mn is None:
            continue
        x = col_(c).cast("double")
        if mn == mx:
            if right_closed:
                continue  # the snapshot histogram is empty for a single value
            rows.append((c, 1, mn, mx))
            exprs.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("column"), F.lit(1).alias("bin"))))
            continue
        width = (mx - mn) / bins
        for b in range(1, bins + 1):
            rows.append((c, b, mn + (b - 1) * width, mx if b == bins else mn + b * width))
        if right_closed:
            b = F.greatest(F.ceil((x - F.lit(mn)) / F.lit(width)), F.lit(1))
        else:
            b = F.floor((x - F.lit(mn)) / F.lit(width)) + 1
        b = F.least(b, F.lit(bins)).cast("int")
        exprs.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("column"), b.alias("bin"))))
    if not exprs:
        return spark.createDataFrame([], "column string, bin int, lo double, hi double, count bigint")
    counts = (df.select(F.explode(F.filter(F.array(*exprs), lambda s: s.isNotNull())).alias("h"))
              .groupBy("h.column", "h.bin").agg(F.count(F.lit(1)).alias("count")))
    spine = spark.createDataFrame(rows, "column string, bin int, lo double, hi double")
    return (spine.join(counts, ["column", "bin"], "left")
            .select("column", "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def datetime_months(df: DataFrame, cols) -> DataFrame:
    """``(column, min, max, distinct_months)`` per datetime column."""
    out = None
    for c in cols:
        ts = col_(c).cast("timestamp_ntz") if is_time_type(df.schema[c].dataType) else parse_datetime_text(c)
        one = df.select(ts.alias("ts")).agg(F.lit(c).alias("column"), F.min("ts").alias("min"),
                                            F.max("ts").alias("max"),
                                            F.countDistinct(F.date_trunc("month", "ts")).alias("distinct_months"))
        out = one if out is None else out.unionByName(one)
    return out


def datetime_days(df: DataFrame, cols) -> DataFrame:
    """Span and distinct days of datetime or date-like text columns."""
    out = None
    for c in cols:
        ts = col_(c).cast("timestamp_ntz") if is_time_type(df.schema[c].dataType) else parse_datetime_text(c)
        one = df.select(ts.alias("ts")).agg(F.lit(c).alias("column"), F.min("ts").alias("min"),
                                            F.max("ts").alias("max"),
                                            F.countDistinct(F.to_date("ts")).alias("distinct_days"))
        out = one if out is None else out.unionByName(one)
    return out


def top_categories(df: DataFrame, cols, k: int = TOP_CATEGORIES) -> DataFrame:
    """Top-k values per column with count and % of non-nulls (ties: value ascending)."""
    vc = value_counts(df, cols)
    w = W.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    # The rank alone in its window: every task keeps its k best values before the exchange.
    best = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    total = _inline(df, [F.struct(F.lit(c).alias("column"), F.count(col_(c)).alias("total")) for c in cols])
    return best.join(total, "column").select("column", F.col("rank").cast("bigint").alias("rank"), "value", "count",
                                             F.round(F.col("count") * 100.0 / F.col("total"), 2).alias("pct"))


def boolean_stats(df: DataFrame, cols) -> DataFrame:
    """true/false counts and % of non-nulls."""
    structs = []
    for c in cols:
        x = col_(c).cast("boolean")
        n = F.count(x)
        structs.append(F.struct(F.lit(c).alias("column"), F.count_if(x).alias("true_count"),
                                F.count_if(~x).alias("false_count"),
                                F.round(F.count_if(x) * 100.0 / n, 2).alias("true_pct"),
                                F.round(F.count_if(~x) * 100.0 / n, 2).alias("false_pct")))
    return _inline(df, structs)


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells over all cells, in %."""
    cols = df.columns
    n = F.count(F.lit(1))
    missing = sum((n - F.count(col_(c)) for c in cols[1:]), n - F.count(col_(cols[0])))
    return df.agg(n.alias("row_count"), F.lit(len(cols)).alias("column_count"),
                  missing.alias("missing_cells"),
                  F.when(n > 0, F.round(missing * 100.0 / (n * len(cols)), 2)).otherwise(0.0).alias("missing_cell_pct"))


WS_SPLIT = r"[\t\n\x0B\f\r ]+"


def whitespace_vocab(df: DataFrame, cols) -> DataFrame:
    """Vocabulary of lower-cased whitespace tokens and mean length per text column."""
    lv = long_values(df, cols)
    toks = (lv.select("column", F.explode(F.split(F.lower("value"), WS_SPLIT)).alias("token"))
            .where(F.col("token") != ""))
    vocab = toks.groupBy("column", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(
        F.count(F.lit(1)).alias("vocab_size"))
    lens = _inline(df, [F.struct(F.lit(c).alias("column"), F.round(F.avg(F.length(col_(c))), 2).alias("avg_length"))
                        for c in cols])
    return lens.join(vocab, "column", "left").select("column", F.coalesce("vocab_size", F.lit(0)).alias("vocab_size"),
                                                     "avg_length")


def eda_snapshot(df: DataFrame) -> DataFrame:
    """Per-column snapshot kind plus missing and cardinality %."""
    from tabflow.operators.profile import column_kinds, distinct_counts, missing_counts
    kinds = column_kinds(df, snapshot=True)
    miss = missing_counts(df)
    dist = distinct_counts(df)
    return (kinds.join(miss, "column").join(dist, "column")
            .select("column", "kind", "missing_count", "missing_pct", "distinct_count",
                    F.when(F.col("n_rows") > 0, F.round(F.col("distinct_count") * 100.0 / F.col("n_rows"), 2))
                    .otherwise(0.0).alias("cardinality_pct")))


def full_snapshot(df: DataFrame, bins: int = HISTOGRAM_BINS, top: int = TOP_CATEGORIES) -> DataFrame:
    """The whole snapshot in one call, as rows ``(section, column, item, value, text)``.

    Sections: ``table`` (rows, columns, duplicate rows, missing cells and a ``type:<kind>`` count per kind), ``column`` (kind as
    text, missing, distinct and their percentages), ``stats`` (by kind: moments, quartiles, skewness, kurtosis and zeros of
    numbers; span and distinct days of dates; counts and shares of booleans; vocabulary and length of texts; ``top:<rank>``
    values of categories), ``histogram`` (``<bin>`` of numbers: count, edges as text) and ``correlation`` (pairs of numbers).
    Numeric text counts as numbers, as in ``column_kinds(snapshot=True)``."""
    from tabflow.operators.profile import column_kinds, duplicate_rows
    kinds = column_kinds(df, snapshot=True)
    by = {}
    for r in kinds.select("column", "kind").collect():  # one row per column
        by.setdefault(r["kind"], []).append(r["column"])
    numeric = by.get("numerical", [])
    numbers = df.select(*[(col_(c) if is_numeric_type(df.schema[c].dataType) else parse_numeric_or_range(c)).cast("double").alias(c) for c in numeric])
    none, parts = F.lit(None).cast("string"), []

    def wide(section, t, items, texts=()):
        """Rows of the value columns ``items`` of a table with a ``column`` column."""
        cells = [F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("value"), none.alias("text")) for i in items]
        cells += [F.struct(F.lit(i).alias("item"), F.lit(None).cast("double").alias("value"), F.col(i).cast("string").alias("text")) for i in texts]
        parts.append(t.select(F.lit(section).alias("section"), "column", F.inline(F.array(*cells))))

    whole = lambda t: t.withColumn("column", none)
    wide("table", whole(duplicate_rows(df)), ["row_count", "duplicate_row_count", "duplicate_row_pct"])
    wide("table", whole(missing_cells(df)), ["column_count", "missing_cells", "missing_cell_pct"])
    counts = whole(df.sparkSession.createDataFrame([tuple(len(by.get(k, [])) for k in KINDS)], ", ".join(f"`type:{k}` int" for k in KINDS)))
    wide("table", counts, [f"type:{k}" for k in KINDS])
    wide("column", eda_snapshot(df), ["missing_count", "missing_pct", "distinct_count", "cardinality_pct"], ["kind"])
    if numeric:
        one = _inline(numbers, [F.struct(F.lit(c).alias("column"), F.min(col_(c)).alias("min"), F.max(col_(c)).alias("max"), F.avg(col_(c)).alias("mean"),
                                         F.stddev_samp(col_(c)).alias("std")) for c in numeric])
        wide("stats", one, ["min", "max", "mean", "std"])
        wide("stats", distribution_stats(numbers, numeric), ["skew", "kurtosis", "zeros_pct", "q1", "median", "q3"])
        h = histogram_right_closed(numbers, numeric, bins)
        parts.append(h.select(F.lit("histogram").alias("section"), "column", F.col("bin").cast("string").alias("item"), F.col("count").cast("double").alias("value"),
                              F.concat(F.lit("("), F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string"), F.lit("]")).alias("text")))
    if len(numeric) > 1:
        m = correlation_matrix(numbers, numeric)
        parts.append(m.select(F.lit("correlation").alias("section"), F.col("column"), F.col("other_column").alias("item"), F.col("r").alias("value"), none.alias("text")))
    if by.get("datetime"):
        wide("stats", datetime_days(df, by["datetime"]), ["distinct_days"], ["min", "max"])
    if by.get("boolean"):
        wide("stats", boolean_stats(df, by["boolean"]), ["true_count", "false_count", "true_pct", "false_pct"])
    if by.get("text"):
        wide("stats", whitespace_vocab(df, by["text"]), ["vocab_size", "avg_length"])
    if by.get("categorical"):
        t = top_categories(df, by["categorical"], top)
        parts.append(t.select(F.lit("stats").alias("section"), "column", F.concat(F.lit("top:"), F.col("rank").cast("string")).alias("item"),
                              F.col("count").cast("double").alias("value"), F.col("value").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decomposition_strength(df: DataFrame, time_col: str, value_col: str, entity_col: str | None = None,
                           period: int = 7, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Additive decomposition with a centred moving-average trend (odd period) and
    phase means; strength = max(0, 1 − var(resid)/var(part + resid)) with population variance.

    Rows without a full centred window are dropped (no extrapolation). An entity is cut into slices that know the rows
    before them: the window that ends at a row is the centred one of the row ``half`` before it. With no entity the input
    must already be one row per time step."""
    half = period // 2
    part = [entity_col] if entity_col else []
    pos = entity_positions(df.select(*part, time_col, F.col(value_col).cast("double").alias("y")), part, [time_col], pos_col="idx", slice_rows=slice_rows)
    w = W.partitionBy(*part, "_slice").orderBy("idx")
    win = w.rowsBetween(1 - period, 0)
    s = (with_halo(pos, part, period - 1, "idx", slice_rows)
         .withColumn("trend", F.when(F.count("y").over(win) == period, F.avg("y").over(win)))
         .withColumn("y", F.lag("y", half).over(w))
         .where(F.col("trend").isNotNull() & ~F.col("_halo"))
         .withColumn("phase", (F.col("idx") - half) % period)
         .withColumn("detr", F.col("y") - F.col("trend")))
    phase_mean = s.groupBy(*part, "phase").agg(F.avg("detr").alias("pm"))
    centred = phase_mean.withColumn("seasonal", F.col("pm") - F.avg("pm").over(W.partitionBy(*part)))
    s = s.join(centred.select(*part, "phase", "seasonal"), part + ["phase"])
    s = s.withColumn("resid", F.col("detr") - F.col("seasonal"))
    agg = s.groupBy(*part).agg(F.var_pop("resid").alias("v_r"),
                               F.var_pop(F.col("trend") + F.col("resid")).alias("v_t"),
                               F.var_pop(F.col("seasonal") + F.col("resid")).alias("v_s"),
                               F.count(F.lit(1)).alias("n"))
    return agg.select(*part, "n",
                      F.when(F.col("v_t") != 0, F.round(F.greatest(F.lit(0.0), 1 - F.col("v_r") / F.col("v_t")), 4))
                      .alias("trend_strength"),
                      F.when(F.col("v_s") != 0, F.round(F.greatest(F.lit(0.0), 1 - F.col("v_r") / F.col("v_s")), 4))
                      .alias("seasonal_strength"))
