"""Target candidates and problem-type detection.

Rules are Column expressions over the per-column profile table; nothing here scans
the data beyond the profile itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.operators.profile import ID_LIKE_UNIQUE_RATIO, MAX_CATEGORICAL_TARGET_CARDINALITY, column_profile

# Fixed values.
MIN_ITEM_AVG_ROWS_PER_VALUE = 2


def _types_array(*pairs):
    """``array_compact(array(when(c1,'t1'), ...))``."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(t)) for cond, t in pairs]))


def target_candidates(profile: DataFrame) -> DataFrame:
    """``(column, kind, cardinality, cardinality_ratio, missing_pct, likely_problem_types)``.

    Constants, non-numeric ID-like columns and datetimes are never candidates; a
    near-unique integer is read as an identifier; ≤20 levels make a class label."""
    has_dt = F.max((F.col("kind") == "datetime").cast("int")).over(W.partitionBy()) > 0
    kind, u = F.col("kind"), F.col("unique_count")
    id_like = F.col("unique_pct") >= ID_LIKE_UNIQUE_RATIO * 100
    integer = F.col("dtype").isin("tinyint", "smallint", "int", "bigint")
    cat = kind == "categorical"
    num = (kind == "numerical") & ~(id_like & integer)
    types = _types_array(
        (cat & (u <= MAX_CATEGORICAL_TARGET_CARDINALITY), "classification"),
        (kind == "boolean", "classification"),
        (num & (u == 2), "classification"),
        (num & (u != 2) & integer & (u <= MAX_CATEGORICAL_TARGET_CARDINALITY), "classification"),
        (num & (u != 2), "regression"),
        (num & (u != 2) & ~(integer & (u <= MAX_CATEGORICAL_TARGET_CARDINALITY)) & F.col("_has_dt"),
         "forecasting"))
    eligible = ~F.col("is_constant") & ~(id_like & (kind != "numerical")) & (kind != "datetime")
    return (profile.select("*", has_dt.alias("_has_dt")).where(eligible)
            .select("column", "position", "kind", F.col("unique_count").alias("cardinality"),
                    F.round(F.col("unique_count") / F.col("n_rows"), 4).alias("cardinality_ratio"),
                    "missing_pct", types.alias("likely_problem_types"))
            .where(F.size("likely_problem_types") > 0))


def recommended_target(candidates: DataFrame) -> DataFrame:
    """The candidate when it is the only one, else no row."""
    return (candidates.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
            .where(F.col("_n") == 1).drop("_n"))


def problem_type(candidates: DataFrame, profile: DataFrame) -> DataFrame:
    """One row ``(problem_type, target_column, confidence)``.

    forecasting if a datetime column exists and some candidate is forecastable; else the
    sole candidate's type; else the type all candidates agree on; else none."""
    has_dt = profile.agg(F.max((F.col("kind") == "datetime").cast("int")).alias("has_dt"))
    c = candidates.select(
        "column", "likely_problem_types",
        F.array_contains("likely_problem_types", "forecasting").alias("fc"),
        F.col("position").alias("_pos"))
    agg = c.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("fc"), 1)).alias("n_fc"),
        F.min_by("column", F.when(F.col("fc"), F.col("_pos"))).alias("first_fc"),
        F.first("column").alias("only"),
        F.first("likely_problem_types").alias("only_types"),
        F.array_distinct(F.flatten(F.collect_list(F.filter("likely_problem_types", lambda t: t != "forecasting"))))
        .alias("non_fc_types"))
    a = agg.withColumn("_k", F.lit(1)).join(has_dt.withColumn("_k", F.lit(1)), "_k")
    fc = (F.col("has_dt") == 1) & (F.col("n_fc") > 0)
    sole = F.col("n") == 1
    ptype = (F.when(fc, "forecasting")
             .when(sole & F.array_contains("only_types", "classification"), "classification")
             .when(sole & F.array_contains("only_types", "regression"), "regression")
             .when(sole, F.lit(None))
             .when(F.size("non_fc_types") == 1, F.col("non_fc_types")[0]))
    target = F.when(fc & sole, F.col("only")).when(fc, F.col("first_fc")).when(sole, F.col("only"))
    conf = (F.when(fc & sole, "high").when(fc & (F.col("n_fc") == 1), "medium").when(fc, "low")
            .when(sole, "high").when(F.size("non_fc_types") == 1, "medium").otherwise("low"))
    return a.select(ptype.cast("string").alias("problem_type"), target.alias("target_column"),
                    conf.alias("confidence"))


def item_column(profile: DataFrame, exclude=(), suspicious=None) -> DataFrame:
    """Best categorical, non-ID-like column with ≥2 rows per value (later column wins ties).

    One row ``(item_column, avg_rows_per_value)`` or no row."""
    p = profile.withColumn("_pos", F.col("position"))
    id_like = (F.col("kind") != "text") & (F.col("unique_pct") >= ID_LIKE_UNIQUE_RATIO * 100) & (F.col("n_rows") > 1)
    keep = ((F.col("kind") == "categorical") & ~id_like & (F.col("unique_count") > 1)
            & ~F.col("column").isin(*[e for e in exclude if e]))
    if suspicious:
        keep = keep & ~F.col("column").isin(*suspicious)
    avg = F.col("n_rows") / F.col("unique_count")
    cand = p.where(keep).select("column", avg.alias("avg_rows"), "_pos").where(
        F.col("avg_rows") >= MIN_ITEM_AVG_ROWS_PER_VALUE)
    best = cand.agg(F.max_by(F.struct("column", "avg_rows"), F.struct("avg_rows", "_pos")).alias("b"))
    return best.where(F.col("b").isNotNull()).select(F.col("b.column").alias("item_column"),
                                                     F.round("b.avg_rows", 4).alias("avg_rows_per_value"))


def detect_targets(df: DataFrame, target: str | None = None) -> DataFrame:
    return target_candidates(column_profile(df, target))
