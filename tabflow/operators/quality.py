"""Data-quality issues and score (Q01–Q11).

The issues table is long and typed: ``(column, other_column, issue_type, severity,
count, pct, value)``. Every rule is a Column expression over per-column statistic
rows; the statistics themselves come from few passes over the data (the
profile, the quantile scans, one wide conditional-count pass).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.exprs import col_, is_numeric_type, safe_corr
from tabflow.functions.quantiles import quantile_table
from tabflow.operators.profile import ID_LIKE_UNIQUE_RATIO, _inline, column_profile, duplicate_rows, sniff_strings

# Fixed values (quality rules).
MIN_ROWS_FOR_OUTLIER_CHECK = 4
LEAKAGE_NAME_HINTS = ("target", "label", "outcome", "result", "leak", "actual", "y_true")
MIN_SENTINEL_OCCURRENCES = 2
MIN_ROWS_FOR_SENTINEL_CHECK = 10
SENTINEL_MAX_SHARE = 0.5
SENTINEL_Z_SCORE_THRESHOLD = 3.0
LEAK_CORRELATION = 0.995
HIGH_MISSING_PCT, MEDIUM_MISSING_PCT = 30, 5
HIGH_DUPLICATE_PCT = 10
OUTLIER_MEDIUM_PCT = 5
PENALTY = {"high": 15, "medium": 7, "low": 2}

ISSUE_SCHEMA = ("column string, other_column string, issue_type string, severity string, "
                "count bigint, pct double, value double")


def _issue(df: DataFrame, column, issue_type: str, severity, count=None, pct=None, value=None,
           other=None) -> DataFrame:
    lit_none = F.lit(None)
    return df.select(
        (column if column is not None else lit_none).cast("string").alias("column"),
        (other if other is not None else lit_none).cast("string").alias("other_column"),
        F.lit(issue_type).alias("issue_type"),
        (severity if not isinstance(severity, str) else F.lit(severity)).alias("severity"),
        (count if count is not None else lit_none).cast("bigint").alias("count"),
        (pct if pct is not None else lit_none).cast("double").alias("pct"),
        (value if value is not None else lit_none).cast("double").alias("value"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def pair_correlations(df: DataFrame, pairs) -> DataFrame:
    """``(column, other_column, r)`` of every pair, each row taken once per pair: one aggregate over all pairs is a method that
    the JVM does not compile (some 40 microseconds a row for 28 pairs)."""
    pairs = list(pairs)
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, other_column string, r double")
    both = [F.struct(col_(a).cast("double").alias("x"), col_(b).cast("double").alias("y")).alias(str(i)) for i, (a, b) in enumerate(pairs)]
    ids = [str(i) for i in range(len(pairs))]
    long = df.select(*both).unpivot([], ids, "pair", "value").select("pair", "value.x", "value.y")
    at = F.col("pair").cast("int") + 1
    return long.groupBy("pair").agg(safe_corr("x", "y").alias("r")).select(
        F.element_at(F.array(*[F.lit(a) for a, _ in pairs]), at).alias("column"),
        F.element_at(F.array(*[F.lit(b) for _, b in pairs]), at).alias("other_column"), "r")


def numeric_checks(df: DataFrame, cols, approx: bool = False, pairs=()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q04, Q05 and, for the column ``pairs``, Q09 from shared scans.

    First count, quartiles, min and max per column (rank refinement, or one wide approximate pass); they are bound as
    literals. Then one wide pass: outlier counts, for the min and the max how often they recur and the mean/std of the
    remaining values; and one pass for the pair correlations. Returns ``(outliers, sentinels, correlations)``."""
    spark = df.sparkSession
    empty_out = spark.createDataFrame(
        [], "column string, n bigint, lower double, upper double, outlier_count bigint, outlier_pct double")
    empty_sent = spark.createDataFrame([], "column string, value double, count bigint, pct double, z_score double")
    empty_pairs = spark.createDataFrame([], "column string, other_column string, r double")
    cols = list(cols)
    if not cols:
        return empty_out, empty_sent, empty_pairs
    if approx:
        first = []
        for c in cols:
            x = col_(c).cast("double")
            first.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"),
                                  F.percentile_approx(x, [0.25, 0.75], 10000).cast("array<double>").alias("q"),
                                  F.min(x).alias("mn"), F.max(x).alias("mx")))
        stats = _inline(df, first).collect()  # one row per column
    else:
        counts = {}
        qt = quantile_table(df, cols, [0.0, 0.25, 0.75, 1.0], counts)  # columns × 4 values
        stats = [{"column": c, "n": counts.get(c, 0), "q": [qt.get((c, 0.25)), qt.get((c, 0.75))],
                  "mn": qt.get((c, 0.0)), "mx": qt.get((c, 1.0))} for c in cols]
    second = []
    for st in stats:
        if st["n"] == 0:
            continue
        c, x = st["column"], col_(st["column"]).cast("double")
        q1, q3 = st["q"]
        ok = st["n"] >= MIN_ROWS_FOR_OUTLIER_CHECK and q3 != q1
        lo, hi = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if ok else (None, None)
        sides = []
        for side, v in (("min", st["mn"]), ("max", st["mx"])):
            rest = F.when(x != v, x)
            sides.append(F.struct(F.lit(side).alias("side"), F.lit(v).alias("value"),
                                  F.count(F.when(x == v, 1)).alias("count"), F.count(rest).alias("n_rest"),
                                  F.avg(rest).alias("rest_mean"), F.stddev_samp(rest).alias("rest_std")))
        second.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n"), F.lit(ok).alias("ok"),
            F.lit(lo).cast("double").alias("lower"), F.lit(hi).cast("double").alias("upper"),
            (F.count(F.when((x < lo) | (x > hi), 1)) if ok else F.lit(None).cast("bigint")).alias("outlier_count"),
            F.array(*sides).alias("sides")))
    if not second:
        return empty_out, empty_sent, empty_pairs
    row = df.agg(F.array(*second).alias("checks")).cache()
    both = row.select(F.inline("checks"))
    found = pair_correlations(df, pairs).where(F.abs("r") >= LEAK_CORRELATION)
    outliers = both.where("ok").select("column", "n", "lower", "upper", "outlier_count",
                                        F.round(F.col("outlier_count") * 100.0 / F.col("n"), 2).alias("outlier_pct"))
    s = both.select("column", "n", F.inline("sides"))
    share = F.col("count") / F.col("n")
    z = F.abs(F.col("rest_mean") - F.col("value")) / F.col("rest_std")
    valid = ((F.col("n") >= MIN_ROWS_FOR_SENTINEL_CHECK) & (F.col("count") >= MIN_SENTINEL_OCCURRENCES)
             & (share < SENTINEL_MAX_SHARE) & (F.col("n_rest") >= 5) & F.col("rest_std").isNotNull()
             & (F.col("rest_std") != 0))
    cand = s.where(valid).select("column", "side", "value", "count", F.round(share * 100, 2).alias("pct"),
                                 z.alias("z")).where(F.col("z") >= SENTINEL_Z_SCORE_THRESHOLD)
    best = cand.groupBy("column").agg(F.max_by(F.struct("value", "count", "pct", "z"),
                                               F.struct(F.col("z"), F.when(F.col("side") == "min", 1).otherwise(0)))
                                      .alias("b"))
    sentinels = best.select("column", "b.value", "b.count", "b.pct", F.round("b.z", 2).alias("z_score"))
    return outliers, sentinels, found


def outlier_counts(df: DataFrame, cols, approx: bool = False) -> DataFrame:
    """``(column, n, lower, upper, outlier_count, outlier_pct)`` for columns with
    ≥4 values and a non-zero IQR."""
    return numeric_checks(df, cols, approx)[0]


def sentinel_candidates(df: DataFrame, cols) -> DataFrame:
    """Q05: the min or max of a numeric column that recurs and sits ≥3 std from the rest.

    ``(column, value, count, pct, z_score)``, at most one row per column (larger z)."""
    return numeric_checks(df, cols)[1]


def numeric_text_columns(df: DataFrame, cols) -> DataFrame:
    """Q06: string columns whose every non-null value parses as a number."""
    s = sniff_strings(df, cols)
    return s.where((F.col("n_nonnull") > 0) & (F.col("n_numeric") == F.col("n_nonnull"))).select("column")


def correlated_pairs(df: DataFrame, cols, threshold: float = LEAK_CORRELATION) -> DataFrame:
    """Q09: pairs of numeric columns with |r| ≥ threshold: ``(column, other_column, r)``."""
    return pair_correlations(df, combinations(list(cols), 2)).where(F.abs("r") >= threshold)


def quality_issues(df: DataFrame, likely_target: str | None = None, profile: DataFrame | None = None,
                   approx: bool = False) -> DataFrame:
    """Q11: every issue as one row; an empty table gives one ``empty_dataset`` issue."""
    spark = df.sparkSession
    prof = (profile if profile is not None else column_profile(df, approx=approx)).cache()
    prof_rows = prof.collect()  # one row per column
    n_rows = prof_rows[0]["n_rows"] if prof_rows else df.count()
    if n_rows == 0:
        return spark.createDataFrame([(None, None, "empty_dataset", "high", None, None, None)], ISSUE_SCHEMA)
    numerical = [r["column"] for r in prof_rows if r["kind"] == "numerical"]
    categorical = [r["column"] for r in prof_rows if r["kind"] == "categorical"]

    pct = F.col("missing_pct")
    parts = [
        _issue(prof.where(F.col("missing_count") > 0), F.col("column"), "missing_values",
               F.when(pct >= HIGH_MISSING_PCT, "high").when(pct >= MEDIUM_MISSING_PCT, "medium").otherwise("low"),
               count=F.col("missing_count"), pct=pct),
        _issue(duplicate_rows(df).where(F.col("duplicate_row_count") > 0), None, "duplicate_rows",
               F.when(F.col("duplicate_row_pct") >= HIGH_DUPLICATE_PCT, "high").otherwise("medium"),
               count=F.col("duplicate_row_count"), pct=F.col("duplicate_row_pct")),
        _issue(prof.where("is_constant"), F.col("column"), "constant_column", "low"),
        _issue(prof.where("is_near_constant"), F.col("column"), "near_constant_column", "low"),
    ]
    out, sent, corr = numeric_checks(df, numerical, approx, combinations(numerical, 2))
    out = out.where(F.col("outlier_count") > 0)
    parts.append(_issue(out, F.col("column"), "possible_outliers",
                        F.when(F.col("outlier_pct") >= OUTLIER_MEDIUM_PCT, "medium").otherwise("low"),
                        count=F.col("outlier_count"), pct=F.col("outlier_pct")))
    parts.append(_issue(sent, F.col("column"), "possible_sentinel_missing", "medium", count=F.col("count"),
                        pct=F.col("pct"), value=F.col("value")))
    if categorical:
        parts.append(_issue(prof.where((F.col("kind") == "categorical") & F.col("looks_numeric")), F.col("column"),
                            "invalid_dtype", "medium"))
    parts.append(_issue(prof.where((F.col("kind") != "text") & (F.col("unique_pct") >= ID_LIKE_UNIQUE_RATIO * 100)
                                   & (F.col("n_rows") > 1)), F.col("column"), "id_like_column", "low"))
    hint = None
    for h in LEAKAGE_NAME_HINTS:
        cond = F.lower(F.col("column")).contains(h)
        hint = cond if hint is None else hint | cond
    leak = prof.where(hint)
    if likely_target is not None:
        leak = leak.where(F.col("column") != likely_target)
    parts.append(_issue(leak, F.col("column"), "possible_leakage", "medium"))
    parts.append(_issue(corr, F.col("column"), "possible_leakage", "medium", value=F.round(F.abs("r"), 3),
                        other=F.col("other_column")))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def quality_score(issues: DataFrame) -> DataFrame:
    """Q10: max(0, 100 − 15·high − 7·medium − 2·low)."""
    penalty = F.coalesce(F.sum(F.when(F.col("severity") == "high", PENALTY["high"])
                               .when(F.col("severity") == "medium", PENALTY["medium"])
                               .when(F.col("severity") == "low", PENALTY["low"]).otherwise(0)), F.lit(0))
    n_empty = F.count(F.when(F.col("issue_type") == "empty_dataset", 1))
    return issues.agg(
        F.count(F.when(F.col("severity") == "high", 1)).alias("high_count"),
        F.count(F.when(F.col("severity") == "medium", 1)).alias("medium_count"),
        F.count(F.when(F.col("severity") == "low", 1)).alias("low_count"),
        F.when(n_empty > 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.round(100.0 - penalty, 2)))
        .alias("quality_score"))
