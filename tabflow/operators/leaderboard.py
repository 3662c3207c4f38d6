"""Leaderboard, importances and audit rules over results tables.

Results table: ``(run_id, cycle, model, status, metric, value, error, train_seconds)`` for
any number of runs; every rule is a grouped aggregate or a window per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.operators.metrics import LOWER_IS_BETTER

# Fixed values.
FAILURE_RULES = (  # (category, status equals, any of these words in the lower-cased error), first match wins
    ("missing_dependency", "skipped_missing_dependency", None),
    ("unsupported_validation_strategy", "skipped_unsupported_validation_strategy", None),
    ("scoring_failure", None, ("scoring failed",)),
    ("prediction_failure", None, ("predict",)),
    ("invalid_input", None, ("column", "class", "empty", "invalid", "nan")),
    ("preprocessing_failure", None, ("feature", "transform", "encode", "scale")),
)
REL_TOL, ABS_TOL = 1e-3, 1e-6
TOP_IMPORTANCES = 10
MIN_CONSENSUS_MODELS = 2
LOW_SCORE = 60
LISTED_COLUMNS = 10


def primary_metric(results: DataFrame, problem_type: str, preferred=()) -> DataFrame:
    """Per run, the first preferred metric every successful model reports; else roc_auc if
    universal (classification) or accuracy; rmse for regression/forecasting."""
    ok = results.where((F.col("status") == "success") & F.col("value").isNotNull())
    n_models = ok.groupBy("run_id").agg(F.countDistinct("model").alias("n_models"))
    per_metric = ok.groupBy("run_id", "metric").agg(F.countDistinct("model").alias("n_have"))
    universal = per_metric.join(n_models, "run_id").where(F.col("n_have") == F.col("n_models")).select(
        "run_id", "metric")
    prefs = [p.strip().lower() for p in preferred if p and p.strip()]
    if problem_type == "classification":
        fallback = ["roc_auc"]
        last = "accuracy"
    elif problem_type in ("regression", "forecasting"):
        fallback, last = [], "rmse"
    else:
        fallback, last = [], "score"
    order = prefs + fallback
    prio = F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))]) if order else None
    runs = results.select("run_id").distinct()
    if prio is not None:
        pick = (universal.where(F.col("metric").isin(*order))
                .groupBy("run_id").agg(F.min_by("metric", prio[F.col("metric")]).alias("picked")))
        runs = runs.join(pick, "run_id", "left")
    else:
        runs = runs.withColumn("picked", F.lit(None).cast("string"))
    m = F.coalesce(F.col("picked"), F.lit(last))
    return runs.select("run_id", m.alias("primary_metric"), (~m.isin(*LOWER_IS_BETTER)).alias("higher_is_better"))


def leaderboard(results: DataFrame, primary: DataFrame) -> DataFrame:
    """One row per (run, model): its primary value and rank (successes only, direction
    aware, ties by model name); failed or metric-less models are kept unranked."""
    models = results.select("run_id", "model").distinct()
    st = results.groupBy("run_id", "model").agg(
        F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("success").alias("status"))
    vals = (results.where(F.col("status") == "success").join(primary, "run_id")
            .where(F.col("metric") == F.col("primary_metric"))
            .select("run_id", "model", "value", "higher_is_better"))
    j = models.join(st, ["run_id", "model"]).join(vals, ["run_id", "model"], "left").join(
        primary.select("run_id", "primary_metric"), "run_id")
    rankable = (F.col("status") == "success") & F.col("value").isNotNull()
    signed = F.when(F.col("higher_is_better"), F.col("value")).otherwise(-F.col("value"))
    ranked = j.withColumn("_r", rankable).withColumn("rank", F.when(F.col("_r"), F.row_number().over(
        W.partitionBy("run_id", "_r").orderBy(signed.desc(), F.col("model").asc())).cast("bigint")))
    return ranked.select("run_id", "model", "status", "primary_metric", "value", "rank",
                         F.coalesce(F.col("rank") == 1, F.lit(False)).alias("is_winner"))


def leaderboard_flat(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """Rank by a single higher-is-better score per run."""
    w = W.partitionBy("run_id").orderBy(F.col(score_col).desc(), F.col("model").asc())
    return scores.where(F.col(score_col).isNotNull()).withColumn("rank", F.row_number().over(w).cast("bigint")).select(
        "run_id", "model", score_col, "rank", (F.col("rank") == 1).alias("is_winner"))


def failure_category(results: DataFrame) -> DataFrame:
    """Ordered text rules on status and the lower-cased error."""
    msg = F.lower(F.coalesce(F.col("error"), F.lit("")))
    expr = None
    for cat, status, words in FAILURE_RULES:
        cond = (F.col("status") == status) if status else None
        if words:
            wc = None
            for w in words:
                c = msg.contains(w)
                wc = c if wc is None else (wc | c)
            cond = wc if cond is None else (cond & wc)
        expr = F.when(cond, cat) if expr is None else expr.when(cond, cat)
    expr = expr.when(F.col("status") == "failed", "training_failure").otherwise("unknown")
    return (results.where(F.col("status") != "success").select("run_id", "model", "status", "error").distinct()
            .withColumn("category", expr))


def dataset_issues(issues: DataFrame, n_features: int | None = None) -> DataFrame:
    """What speaks against the dataset itself, from its quality issues table: ``(category, n_columns, columns, value)`` for a
    quality score under ``LOW_SCORE``, missing values, constant columns, possible leakage, no rows and (``n_features`` 0) no
    features; the first ``LISTED_COLUMNS`` names, sorted."""
    from tabflow.operators.quality import quality_score
    kind = F.col("issue_type")

    def named(category: str, cond, *cols):
        names = F.array_distinct(F.flatten(F.collect_list(F.when(cond, F.array_compact(F.array(*cols or ["column"]))))))
        return F.struct(F.lit(category).alias("category"), F.size(names).cast("bigint").alias("n_columns"),
                        F.array_join(F.slice(F.array_sort(names), 1, LISTED_COLUMNS), ", ").alias("columns"), F.lit(None).cast("double").alias("value"))

    found = issues.agg(F.array(
        named("missing_values", kind == "missing_values"), named("constant_columns", kind == "constant_column"),
        named("possible_leakage", kind == "possible_leakage", "column", "other_column")).alias("r"),
        F.count(F.when(kind == "empty_dataset", 1)).alias("empty"))
    columns = found.select(F.inline("r")).where("n_columns > 0")
    none = [F.lit(None).cast("bigint").alias("n_columns"), F.lit(None).cast("string").alias("columns")]
    low = quality_score(issues).where(F.col("quality_score") < LOW_SCORE).select(
        F.lit("low_quality_score").alias("category"), *none, F.col("quality_score").alias("value"))
    empty = found.where("empty > 0").select(F.lit("empty_dataset").alias("category"), *none, F.lit(None).cast("double").alias("value"))
    out = columns.unionByName(low).unionByName(empty)
    if n_features == 0:
        out = out.unionByName(found.select(F.lit("no_features").alias("category"), *none, F.lit(None).cast("double").alias("value")))
    return out


def failure_summary(results: DataFrame, issues: DataFrame | None = None, n_features: int | None = None) -> DataFrame:
    """Per run: models, failures and their categories, the dataset's issues and its suitability: ``not_suitable`` without
    rows or features, ``suitable_with_warnings`` with any other dataset issue, else ``suitable`` (failed models say
    nothing about the dataset)."""
    per_model = results.groupBy("run_id", "model").agg(
        F.bool_or(F.col("status") == "success").alias("ok"))
    cats = failure_category(results).groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("failure_categories"))
    s = per_model.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_models"),
                                        F.count(F.when(~F.col("ok"), 1)).alias("n_failed"))
    out = s.join(cats, "run_id", "left")
    if issues is not None:
        found = dataset_issues(issues, n_features)
    else:
        found = results.sparkSession.createDataFrame([("no_features",)] if n_features == 0 else [], "category string")
    listed = found.agg(F.array_sort(F.collect_set("category")).alias("d"))  # one row of at most six words
    out = out.withColumn("_k", F.lit(1)).join(listed.withColumn("_k", F.lit(1)), "_k")
    bad = F.arrays_overlap("d", F.array(F.lit("empty_dataset"), F.lit("no_features")))
    return out.select("run_id", "n_models", "n_failed", (F.col("n_models") - F.col("n_failed")).alias("n_success"),
                      F.coalesce("failure_categories", F.lit("")).alias("failure_categories"),
                      F.array_join("d", ",").alias("dataset_issues"),
                      F.when(bad, "not_suitable").when(F.size("d") > 0, "suitable_with_warnings").otherwise("suitable").alias("suitability"))


def check_recommendation(claims: DataFrame, results: DataFrame, board: DataFrame, importances: DataFrame) -> DataFrame:
    """Every statement of a recommendation against the computed tables: ``(run_id, kind, name, claimed, actual, verdict, kept)``.

    ``claims`` is ``(run_id, kind, name, claimed)``: ``recommended_model`` (name), ``metric`` (name, claimed value), ``feature``
    (name), ``alternative`` (a model's name) and ``flag`` (name: the reason). The recommended model is always the leaderboard's
    winner (``confirmed`` or ``overridden``, name is the winner then); metrics must be the winner's within rel 1e-3 / abs 1e-6,
    features among the winner's importances (``unverifiable`` if it has none), alternatives evaluated models, and a flag
    needs a reason."""
    winner = board.where("is_winner").select("run_id", F.col("model").alias("winner"))
    c = claims.join(winner, "run_id", "left")
    ok = results.where((F.col("status") == "success") & F.col("value").isNotNull())
    actual = ok.select("run_id", F.col("model").alias("winner"), F.col("metric").alias("name"), F.col("value").alias("actual")).distinct()
    known = results.select("run_id", F.col("model").alias("name"), F.lit(True).alias("_known")).distinct()
    seen = importances.select(F.col("model").alias("winner"), F.col("feature").alias("name"), F.lit(True).alias("_seen")).distinct()
    some = importances.select(F.col("model").alias("winner"), F.lit(True).alias("_some")).distinct()
    j = (c.join(actual, ["run_id", "winner", "name"], "left").join(known, ["run_id", "name"], "left")
         .join(seen, ["winner", "name"], "left").join(some, ["winner"], "left"))
    kind, a, b = F.col("kind"), F.col("claimed"), F.col("actual")
    close = F.abs(a - b) <= F.greatest(F.lit(REL_TOL) * F.greatest(F.abs(a), F.abs(b)), F.lit(ABS_TOL))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    verdict = (F.when(kind == "recommended_model", F.when(F.col("name").eqNullSafe(F.col("winner")), "confirmed").otherwise("overridden"))
               .when(kind == "metric", F.when(b.isNull(), "unknown_metric").when(close, "verified").otherwise("mismatch"))
               .when(kind == "feature", F.when(yes("_seen"), "verified").when(yes("_some"), "not_important").otherwise("unverifiable"))
               .when(kind == "alternative", F.when(yes("_known"), "verified").otherwise("unknown_model"))
               .when(kind == "flag", F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "no_reason").otherwise("flagged")).otherwise("unknown_kind"))
    return j.select("run_id", "kind", F.when(kind == "recommended_model", F.col("winner")).otherwise(F.col("name")).alias("name"), "claimed",
                    F.when(kind == "metric", b).alias("actual"), verdict.alias("verdict"),
                    (verdict.isin("confirmed", "overridden", "verified", "flagged")).alias("kept"))


def claim_check(claims: DataFrame, results: DataFrame) -> DataFrame:
    """A claimed (model, metric, value) must match the results within rel 1e-3 / abs 1e-6;
    claims about unknown models are flagged."""
    r = results.where(F.col("status") == "success").select("run_id", "model", "metric",
                                                           F.col("value").alias("actual"))
    known = results.select("run_id", "model").distinct().withColumn("_known", F.lit(True))
    j = claims.join(r, ["run_id", "model", "metric"], "left").join(known, ["run_id", "model"], "left")
    a, b = F.col("claimed"), F.col("actual")
    close = F.abs(a - b) <= F.greatest(F.lit(REL_TOL) * F.greatest(F.abs(a), F.abs(b)), F.lit(ABS_TOL))
    verdict = (F.when(F.col("_known").isNull(), "unknown_model").when(b.isNull(), "unknown_metric")
               .when(close, "verified").otherwise("mismatch"))
    return j.select("run_id", "model", "metric", "claimed", "actual", verdict.alias("verdict"))


def consensus_importance(importances: DataFrame, top_k: int = TOP_IMPORTANCES,
                         min_models: int = MIN_CONSENSUS_MODELS) -> DataFrame:
    """Rank features per model, then agreement (models including it) and mean rank."""
    w = W.partitionBy("model").orderBy(F.desc("importance"), F.asc("feature"))
    r = importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    n_models = importances.select("model").distinct().count()
    if n_models < min_models:
        return r.limit(0).select("feature", F.lit(0).alias("n_models"), F.lit(0.0).alias("avg_rank"))
    return r.groupBy("feature").agg(F.count(F.lit(1)).alias("n_models"), F.round(F.avg("rank"), 4).alias("avg_rank"))


def top_importance_names(importances: DataFrame, n: int = 5, kind_order=("native", "permutation")) -> DataFrame:
    """Per model, the first non-empty importance kind and its top-n feature names."""
    prio = F.create_map(*[x for i, k in enumerate(kind_order) for x in (F.lit(k), F.lit(i))])
    d = importances.withColumn("_p", prio[F.col("kind")])
    first = d.groupBy("model").agg(F.min("_p").alias("_p"))
    d = d.join(first, ["model", "_p"])
    w = W.partitionBy("model").orderBy(F.desc("importance"), F.asc("feature"))
    d = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return d.groupBy("model", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]),
                     ",").alias("top_features"))
