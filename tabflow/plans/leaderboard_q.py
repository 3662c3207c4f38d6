"""Registered queries for leaderboards, acceptance, importances and audit.

The results table comes from rule-based scorers over the data (so both engines can build
it): on ``labels`` three scorers plus one whose prediction set is empty (a failed model),
and on ``lineitem`` two regression rules."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tabflow.functions.exprs import hash_unit, safe_corr
from tabflow.operators import explain as X
from tabflow.operators import leaderboard as L
from tabflow.operators import metrics as V
from tabflow.operators import models as M
from tabflow.operators.quality import quality_issues
from tabflow.operators.split import split_random
from tabflow.plans.common import orders_gaps, sql_hash_unit, union_all
from tabflow.plans.metrics_q import _auc_sql
from tabflow.plans.models_q import DOC_FEATURES, doc_frame
from tabflow.plans.quality_q import ORDERS_ISSUES_SQL, sql_score
from tabflow.plans.registry import query, table
from tabflow.sources.runs import build_record

RULES = {"rule_mixed": (0.3, 0.7, 7), "rule_hash": (0.0, 1.0, 11), "rule_constant": (0.0, 0.0, 0)}


def _rule_score(a, b, seed):
    if a == 0 and b == 0:
        return F.lit(0.5)
    return F.round(F.lit(a) * F.col("quality").cast("double") + F.lit(b) * hash_unit("doc_id", seed=seed), 2)


def _sql_rule_score(a, b, seed):
    if a == 0 and b == 0:
        return "0.5::DOUBLE"
    return f"round({a}::DOUBLE * CAST(quality AS DOUBLE) + {b}::DOUBLE * {sql_hash_unit('doc_id', seed=seed)}, 2)"


def _res(df, run_id, model):
    return df.select(F.lit(run_id).alias("run_id"), F.lit(1).alias("cycle"), F.lit(model).alias("model"), "*")


def rule_results(spark, sf):
    lab = table(spark, sf, "labels")
    parts = []
    for name, (a, b, seed) in RULES.items():
        s = _rule_score(a, b, seed)
        p = lab.select(F.col("quality").alias("label"), s.alias("score"), (s >= 0.5).cast("int").alias("prediction"))
        acc = V.accuracy(p)
        auc = V.roc_auc_binary(p, "label", "score")
        wide = acc.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), "_k")
        parts.append(_res(V.to_long(wide, ["accuracy", "roc_auc"]), "labels", name))
    empty = lab.select(_rule_score(0.3, 0.7, 7).alias("score")).where(F.col("score") > 2)
    parts.append(empty.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(
        F.lit("labels").alias("run_id"), F.lit(1).alias("cycle"), F.lit("rule_empty").alias("model"),
        F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), "n"))
    li = table(spark, sf, "lineitem")
    for name, pred in (("qty_rule", F.col("l_quantity") * F.lit(1500.0) +
                        hash_unit("l_orderkey", "l_linenumber") * F.lit(5000.0)),
                       ("flat_rule", F.lit(38000.0))):
        p = li.select(F.col("l_extendedprice").alias("label"), pred.alias("prediction"))
        parts.append(_res(V.to_long(V.regression_metrics(p), ["mae", "rmse"]), "lineitem", name))
    out = None
    for p in parts:
        p = p.select("run_id", "cycle", "model", "metric", "value")
        out = p if out is None else out.unionByName(p)
    return out.select("run_id", "cycle", "model",
                      F.when(F.col("metric").isNull(), "failed").otherwise("success").alias("status"),
                      "metric", F.round("value", 6).alias("value"),
                      F.when(F.col("metric").isNull(), "empty prediction set: no rows to score").alias("error"),
                      F.lit(0.0).alias("train_seconds"))


def _rules_sql():
    parts = []
    for name, (a, b, seed) in RULES.items():
        src = f"(SELECT quality AS label, {_sql_rule_score(a, b, seed)} AS score FROM labels)"
        parts.append(f"""SELECT 'labels' AS run_id, 1 AS cycle, '{name}' AS model, 'accuracy' AS metric,
  avg(CAST(label = CAST(score >= 0.5 AS INTEGER) AS DOUBLE)) AS value FROM {src}""")
        parts.append(f"""SELECT 'labels', 1, '{name}', 'roc_auc', roc_auc FROM ({_auc_sql(src)})""")
    parts.append(f"""SELECT 'labels', 1, 'rule_empty', NULL, NULL FROM (SELECT count(*) AS n FROM labels
  WHERE {_sql_rule_score(0.3, 0.7, 7)} > 2) WHERE n = 0""")
    for name, pred in (("qty_rule", f"l_quantity * 1500.0::DOUBLE + {sql_hash_unit('l_orderkey', 'l_linenumber')}"
                                    f" * 5000.0::DOUBLE"), ("flat_rule", "38000.0::DOUBLE")):
        src = f"(SELECT l_extendedprice AS label, {pred} AS prediction FROM lineitem)"
        parts.append(f"SELECT 'lineitem', 1, '{name}', 'mae', avg(abs(label - prediction)) FROM {src}")
        parts.append(f"SELECT 'lineitem', 1, '{name}', 'rmse', sqrt(avg((label - prediction) ^ 2)) FROM {src}")
    return f"""(SELECT run_id, CAST(cycle AS INTEGER) AS cycle, model,
  CASE WHEN metric IS NULL THEN 'failed' ELSE 'success' END AS status, metric, round(value, 6) AS value,
  CASE WHEN metric IS NULL THEN 'empty prediction set: no rows to score' END AS error, 0.0::DOUBLE AS train_seconds
FROM ({union_all(parts)}))"""


RESULTS = _rules_sql()


@query("results_table", f"SELECT * FROM {RESULTS}")
def results_table(spark, sf):
    return rule_results(spark, sf)


THRESH = {"accuracy": 0.6, "roc_auc": 0.6}


@query("acceptance_gate", f"""SELECT run_id, cycle, model, bool_and(coalesce(r.value >= t.threshold, false)) AS accepted
FROM (SELECT DISTINCT run_id, cycle, model FROM {RESULTS} WHERE run_id = 'labels') m
CROSS JOIN (SELECT 'accuracy' AS metric, 0.6 AS threshold UNION ALL SELECT 'roc_auc', 0.6) t
LEFT JOIN (SELECT * FROM {RESULTS} WHERE status = 'success') r USING (run_id, cycle, model, metric)
GROUP BY 1, 2, 3""")
def acceptance_gate(spark, sf):
    res = rule_results(spark, sf).where(F.col("run_id") == "labels")
    return M.meets_acceptance(res, THRESH)


@query("best_so_far", f"""SELECT model, max(value) AS best FROM {RESULTS} WHERE status = 'success' AND
  metric = 'accuracy' GROUP BY model ORDER BY best DESC, model ASC LIMIT 2""")
def best_so_far(spark, sf):
    return M.best_so_far(rule_results(spark, sf), "accuracy", 2)


PRIMARY_SQL = f"""SELECT run_id, CASE WHEN run_id = 'labels' THEN
    CASE WHEN (SELECT count(DISTINCT model) FROM {RESULTS} WHERE run_id = 'labels' AND status = 'success'
               AND metric = 'roc_auc' AND value IS NOT NULL) =
              (SELECT count(DISTINCT model) FROM {RESULTS} WHERE run_id = 'labels' AND status = 'success'
               AND value IS NOT NULL) THEN 'roc_auc' ELSE 'accuracy' END
  ELSE 'rmse' END AS primary_metric, true AS higher_is_better FROM (SELECT DISTINCT run_id FROM {RESULTS})"""
PRIMARY_SQL = f"""SELECT run_id, primary_metric, primary_metric NOT IN ('rmse', 'mae', 'mape', 'smape', 'mase')
  AS higher_is_better FROM ({PRIMARY_SQL})"""


def _primary(spark, sf):
    res = rule_results(spark, sf)
    a = L.primary_metric(res.where(F.col("run_id") == "labels"), "classification")
    b = L.primary_metric(res.where(F.col("run_id") == "lineitem"), "regression")
    return res, a.unionByName(b)


@query("primary_metric", PRIMARY_SQL)
def primary_metric(spark, sf):
    return _primary(spark, sf)[1]


@query("leaderboard", f"""WITH p AS ({PRIMARY_SQL}),
m AS (SELECT run_id, model, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'success' END AS status
      FROM {RESULTS} GROUP BY 1, 2),
v AS (SELECT r.run_id, r.model, r.value FROM {RESULTS} r JOIN p ON r.run_id = p.run_id AND r.metric = p.primary_metric
      WHERE r.status = 'success'),
j AS (SELECT m.run_id, m.model, m.status, p.primary_metric, v.value, p.higher_is_better,
        m.status = 'success' AND v.value IS NOT NULL AS rk FROM m JOIN p USING (run_id)
        LEFT JOIN v USING (run_id, model))
SELECT run_id, model, status, primary_metric, value,
  CASE WHEN rk THEN row_number() OVER (PARTITION BY run_id, rk ORDER BY
    CASE WHEN higher_is_better THEN value ELSE -value END DESC, model ASC) END AS rank,
  coalesce(CASE WHEN rk THEN row_number() OVER (PARTITION BY run_id, rk ORDER BY
    CASE WHEN higher_is_better THEN value ELSE -value END DESC, model ASC) END = 1, false) AS is_winner FROM j""")
def leaderboard(spark, sf):
    res, prim = _primary(spark, sf)
    return L.leaderboard(res, prim)


@query("leaderboard_flat", f"""SELECT run_id, model, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC,
  model ASC) AS rank, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, model ASC) = 1 AS is_winner
FROM (SELECT run_id, model, CASE WHEN metric IN ('rmse', 'mae') THEN -value ELSE value END AS score FROM {RESULTS}
      WHERE metric IN ('rmse', 'accuracy'))""")
def leaderboard_flat(spark, sf):
    res = rule_results(spark, sf).where(F.col("metric").isin("rmse", "accuracy"))
    return L.leaderboard_flat(V.normalised_score(res).select("run_id", "model", "score"))


FAILCAT_SQL = f"""SELECT DISTINCT run_id, model, status, error,
  CASE WHEN status = 'skipped_missing_dependency' THEN 'missing_dependency'
       WHEN status = 'skipped_unsupported_validation_strategy' THEN 'unsupported_validation_strategy'
       WHEN lower(coalesce(error, '')) LIKE '%scoring failed%' THEN 'scoring_failure'
       WHEN lower(coalesce(error, '')) LIKE '%predict%' THEN 'prediction_failure'
       WHEN regexp_matches(lower(coalesce(error, '')), 'column|class|empty|invalid|nan') THEN 'invalid_input'
       WHEN regexp_matches(lower(coalesce(error, '')), 'feature|transform|encode|scale') THEN 'preprocessing_failure'
       WHEN status = 'failed' THEN 'training_failure' ELSE 'unknown' END AS category
FROM {RESULTS} WHERE status <> 'success'"""


@query("failure_category", FAILCAT_SQL)
def failure_category(spark, sf):
    return L.failure_category(rule_results(spark, sf))


DATASET_SQL = f"""WITH i AS MATERIALIZED ({ORDERS_ISSUES_SQL}),
n AS (SELECT issue_type, "column" AS c FROM i UNION SELECT issue_type, other_column FROM i WHERE issue_type = 'possible_leakage' AND other_column IS NOT NULL)
SELECT CASE issue_type WHEN 'constant_column' THEN 'constant_columns' ELSE issue_type END AS category, count(DISTINCT c) AS n_columns,
  array_to_string(list_sort(list(DISTINCT c))[:10], ', ') AS columns, NULL::DOUBLE AS value FROM n
WHERE issue_type IN ('missing_values', 'constant_column', 'possible_leakage') GROUP BY issue_type
UNION ALL SELECT 'low_quality_score', NULL, NULL, quality_score FROM ({sql_score(ORDERS_ISSUES_SQL)}) WHERE quality_score < 60"""


@query("failure_summary", f"""WITH pm AS (SELECT run_id, model, bool_or(status = 'success') AS ok FROM {RESULTS}
  GROUP BY 1, 2),
s AS (SELECT run_id, count(*) AS n_models, count(*) FILTER (WHERE NOT ok) AS n_failed FROM pm GROUP BY 1)
SELECT run_id, n_models, n_failed, n_models - n_failed AS n_success,
  coalesce((SELECT string_agg(DISTINCT category, ',' ORDER BY category) FROM ({FAILCAT_SQL}) f
    WHERE f.run_id = s.run_id), '') AS failure_categories, (SELECT string_agg(category, ',' ORDER BY category) FROM ({DATASET_SQL})) AS dataset_issues,
  'suitable_with_warnings' AS suitability FROM s""")
def failure_summary(spark, sf):
    """The rule runs, with the quality issues of orders (with injected gaps) as the dataset's."""
    return L.failure_summary(rule_results(spark, sf), quality_issues(orders_gaps(spark, sf)), 4)


@query("dataset_issues", DATASET_SQL)
def dataset_issues(spark, sf):
    return L.dataset_issues(quality_issues(orders_gaps(spark, sf)), 4)


CLAIMS_SQL = f"""(SELECT run_id, model, metric, CASE model WHEN 'rule_hash' THEN value * 1.01
    WHEN 'rule_constant' THEN value + 1e-7 ELSE value END AS claimed FROM {RESULTS}
  WHERE run_id = 'labels' AND metric = 'accuracy'
  UNION ALL SELECT run_id, 'rule_ghost', metric, value FROM {RESULTS} WHERE model = 'rule_mixed' AND metric = 'accuracy'
  UNION ALL SELECT run_id, model, 'f1', value FROM {RESULTS} WHERE model = 'rule_mixed' AND metric = 'accuracy')"""


def claims(res):
    acc = res.where((F.col("run_id") == "labels") & (F.col("metric") == "accuracy"))
    c1 = acc.select("run_id", "model", "metric",
                    F.when(F.col("model") == "rule_hash", F.col("value") * 1.01)
                    .when(F.col("model") == "rule_constant", F.col("value") + 1e-7).otherwise(F.col("value"))
                    .alias("claimed"))
    mixed = acc.where(F.col("model") == "rule_mixed")
    c2 = mixed.select("run_id", F.lit("rule_ghost").alias("model"), "metric", F.col("value").alias("claimed"))
    c3 = mixed.select("run_id", "model", F.lit("f1").alias("metric"), F.col("value").alias("claimed"))
    return c1.unionByName(c2).unionByName(c3)


@query("claim_check", f"""SELECT c.run_id, c.model, c.metric, c.claimed, r.value AS actual,
  CASE WHEN k.model IS NULL THEN 'unknown_model' WHEN r.value IS NULL THEN 'unknown_metric'
       WHEN abs(c.claimed - r.value) <= greatest(1e-3 * greatest(abs(c.claimed), abs(r.value)), 1e-6) THEN 'verified'
       ELSE 'mismatch' END AS verdict
FROM {CLAIMS_SQL} c LEFT JOIN (SELECT * FROM {RESULTS} WHERE status = 'success') r USING (run_id, model, metric)
LEFT JOIN (SELECT DISTINCT run_id, model FROM {RESULTS}) k ON k.run_id = c.run_id AND k.model = c.model""")
def claim_check(spark, sf):
    res = rule_results(spark, sf)
    return L.claim_check(claims(res), res)


# importance tables derived from the data: |r| between each text feature and each rule's score
def importance_table(spark, sf):
    d = doc_frame(spark, sf)
    parts = []
    for name, (a, b, seed) in RULES.items():
        if a == 0 and b == 0:
            continue
        s = _rule_score(a, b, seed)
        dd = d.select(*DOC_FEATURES, s.alias("score"))
        wide = dd.agg(*[F.round(F.abs(safe_corr(f, "score")), 6).alias(f) for f in DOC_FEATURES])
        long = wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance"))
                                               for f in DOC_FEATURES])).alias("e")).select("e.*")
        parts.append(long.select(F.lit(name).alias("model"), F.lit("native" if name == "rule_mixed" else "permutation")
                                 .alias("kind"), "feature", "importance"))
    return parts[0].unionByName(parts[1]).where(F.col("importance").isNotNull())


def _imp_sql():
    parts = []
    for name, (a, b, seed) in RULES.items():
        if a == 0 and b == 0:
            continue
        kind = "native" if name == "rule_mixed" else "permutation"
        src = f"""(SELECT CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words,
  CAST(len(string_split(d.text, chr(10))) AS DOUBLE) AS n_lines, CAST(d.lang = 'en' AS DOUBLE) AS is_en,
  {_sql_rule_score(a, b, seed).replace('quality', 'l.quality').replace('doc_id', 'd.doc_id')} AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
        for f in DOC_FEATURES:
            parts.append(f"""SELECT '{name}' AS model, '{kind}' AS kind, '{f}' AS feature,
  round(abs(covar_pop({f}, score) / nullif(stddev_pop({f}) * stddev_pop(score), 0)), 6) AS importance FROM {src}""")
    return f"(SELECT * FROM ({union_all(parts)}) WHERE importance IS NOT NULL)"


IMP = _imp_sql()


@query("importance_consensus", f"""SELECT feature, count(*) AS n_models, round(avg(rank), 4) AS avg_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature ASC) AS rank FROM {IMP})
WHERE rank <= 10 GROUP BY feature""")
def importance_consensus(spark, sf):
    return L.consensus_importance(importance_table(spark, sf))


@query("importance_top_names", f"""SELECT model, kind, string_agg(feature, ',' ORDER BY rank) AS top_features FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature ASC) AS rank FROM {IMP})
WHERE rank <= 5 GROUP BY model, kind""")
def importance_top_names(spark, sf):
    return L.top_importance_names(importance_table(spark, sf))


@query("importance_native")
def importance_native(spark, sf):
    d = doc_frame(spark, sf).withColumn("quality", F.col("quality").cast("string"))
    pipe = Pipeline(stages=[StringIndexer(inputCol="quality", outputCol="label_idx", stringOrderType="alphabetAsc"),
                            VectorAssembler(inputCols=DOC_FEATURES, outputCol="features"),
                            RandomForestClassifier(featuresCol="features", labelCol="label_idx", seed=42)])
    model = pipe.fit(d)
    return spark.createDataFrame(X.native_importances(model, DOC_FEATURES, "random_forest"),
                                 "model string, kind string, feature string, importance double")


@query("importance_permutation")
def importance_permutation(spark, sf):
    d = doc_frame(spark, sf).withColumn("quality", F.col("quality").cast("string"))
    pipe = Pipeline(stages=[StringIndexer(inputCol="quality", outputCol="label_idx", stringOrderType="alphabetAsc",
                                          handleInvalid="skip"),
                            VectorAssembler(inputCols=DOC_FEATURES, outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol="label_idx", maxIter=200)])
    parts = split_random(d, ["doc_id"])
    model = pipe.fit(parts.where("split = 'train'"))
    return X.permutation_importance(model, parts.where("split = 'test'").drop("split"), DOC_FEATURES, "quality", ["doc_id"], X.accuracy_score)


def _board_sql(run):
    """The winner of ``run`` with its primary value."""
    return f"""(SELECT r.run_id, r.model AS winner, p.primary_metric, r.value AS winner_value FROM {RESULTS} r JOIN ({PRIMARY_SQL}) p
  ON p.run_id = r.run_id AND p.primary_metric = r.metric WHERE r.run_id = '{run}' AND r.status = 'success'
  ORDER BY CASE WHEN p.higher_is_better THEN -r.value ELSE r.value END, r.model LIMIT 1)"""


def _record_sql(run, source, cols, config, status, error):
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cols)
    own = f"|| CASE WHEN count(r.error) > 0 THEN '; ' ELSE '' END || '{error}'" if error else ""
    return f"""SELECT '{run}' AS run_id, '{status}' AS status, '{config}' AS config, any_value(d.n) AS dataset_rows,
  any_value(d.h) AS dataset_fingerprint, CAST({len(cols)} AS INTEGER) AS dataset_columns, count(DISTINCT r.model) AS n_candidates,
  any_value(b.winner) AS winner, any_value(b.primary_metric) AS primary_metric, any_value(b.winner_value) AS winner_value,
  coalesce(string_agg(DISTINCT r.model || ': ' || r.error, '; ' ORDER BY r.model || ': ' || r.error), '') {own} AS errors
FROM {RESULTS} r JOIN {_board_sql(run)} b ON b.run_id = r.run_id, (SELECT count(*) AS n,
  CAST(sum(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::UBIGINT::BIGINT) AS BIGINT) AS h FROM {source}) d WHERE r.run_id = '{run}'"""


RECORDED = {"labels": ("labels", ["doc_id", "quality", "toxic"], {"target": "quality"}, None, None, "complete"),
            "lineitem": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], {"target": "l_extendedprice"}, "stopped by the user", "cancelled", "cancelled")}


@query("run_record", union_all([_record_sql(run, src, cols, '{"target": "' + config["target"] + '"}', state, error)
                                for run, (src, cols, config, error, _, state) in RECORDED.items()]))
def run_record(spark, sf):
    """The records of a complete and of a cancelled run."""
    res, prim = _primary(spark, sf)
    res = res.checkpoint(eager=True)
    board = L.leaderboard(res, prim)
    out = None
    for run, (src, cols, config, error, status, _) in RECORDED.items():
        one = build_record(res.where(F.col("run_id") == run), board.where(F.col("run_id") == run), table(spark, sf, src).select(*cols), config, error, status=status)
        out = one if out is None else out.unionByName(one)
    return out.select("run_id", "status", "config", "dataset_rows", "dataset_fingerprint", "dataset_columns", "n_candidates", "winner",
                      "primary_metric", "winner_value", F.array_join("errors", "; ").alias("errors"))


SAID_SQL = f"""(SELECT 'labels' AS run_id, 'recommended_model' AS kind, 'rule_hash' AS name, NULL::DOUBLE AS claimed
  UNION ALL SELECT 'labels', 'metric', metric, CASE metric WHEN 'accuracy' THEN value * 1.0005 ELSE value * 1.1 END FROM {RESULTS}
    WHERE run_id = 'labels' AND model = 'rule_mixed'
  UNION ALL SELECT 'labels', 'metric', 'f1', 0.9 UNION ALL SELECT 'labels', 'feature', 'n_words', NULL UNION ALL SELECT 'labels', 'feature', 'moon_phase', NULL
  UNION ALL SELECT 'labels', 'alternative', 'rule_constant', NULL UNION ALL SELECT 'labels', 'alternative', 'rule_ghost', NULL
  UNION ALL SELECT 'labels', 'flag', NULL, NULL UNION ALL SELECT 'lineitem', 'recommended_model', 'qty_rule', NULL
  UNION ALL SELECT 'lineitem', 'feature', 'l_quantity', NULL UNION ALL SELECT 'lineitem', 'flag', 'few rows', NULL)"""


@query("check_recommendation", f"""WITH w AS (SELECT run_id, winner FROM {_board_sql('labels')} UNION ALL SELECT run_id, winner FROM {_board_sql('lineitem')}),
i AS MATERIALIZED (SELECT DISTINCT model, feature FROM {IMP}),
c AS (SELECT s.*, w.winner, r.value AS v, EXISTS (SELECT 1 FROM {RESULTS} k WHERE k.run_id = s.run_id AND k.model = s.name) AS known,
    EXISTS (SELECT 1 FROM i WHERE i.model = w.winner AND i.feature = s.name) AS seen, EXISTS (SELECT 1 FROM i WHERE i.model = w.winner) AS rated
  FROM {SAID_SQL} s JOIN w USING (run_id) LEFT JOIN {RESULTS} r ON r.run_id = s.run_id AND r.model = w.winner AND r.metric = s.name AND s.kind = 'metric'),
d AS (SELECT run_id, kind, CASE kind WHEN 'recommended_model' THEN winner ELSE name END AS name, claimed, v AS actual, CASE kind
    WHEN 'recommended_model' THEN CASE WHEN name = winner THEN 'confirmed' ELSE 'overridden' END
    WHEN 'metric' THEN CASE WHEN v IS NULL THEN 'unknown_metric' WHEN abs(claimed - v) <= greatest(1e-3 * greatest(abs(claimed), abs(v)), 1e-6) THEN 'verified' ELSE 'mismatch' END
    WHEN 'feature' THEN CASE WHEN seen THEN 'verified' WHEN rated THEN 'not_important' ELSE 'unverifiable' END
    WHEN 'alternative' THEN CASE WHEN known THEN 'verified' ELSE 'unknown_model' END
    WHEN 'flag' THEN CASE WHEN trim(coalesce(name, '')) = '' THEN 'no_reason' ELSE 'flagged' END END AS verdict FROM c)
SELECT *, verdict IN ('confirmed', 'overridden', 'verified', 'flagged') AS kept FROM d""")
def check_recommendation(spark, sf):
    res, prim = _primary(spark, sf)
    res = res.checkpoint(eager=True)
    mixed = res.where("run_id = 'labels' AND model = 'rule_mixed'")
    said = mixed.select("run_id", F.lit("metric").alias("kind"), F.col("metric").alias("name"),
                        (F.col("value") * F.when(F.col("metric") == "accuracy", F.lit(1.0005)).otherwise(F.lit(1.1))).alias("claimed"))
    fixed = [("labels", "recommended_model", "rule_hash", None), ("labels", "metric", "f1", 0.9), ("labels", "feature", "n_words", None),
             ("labels", "feature", "moon_phase", None), ("labels", "alternative", "rule_constant", None), ("labels", "alternative", "rule_ghost", None),
             ("labels", "flag", None, None), ("lineitem", "recommended_model", "qty_rule", None), ("lineitem", "feature", "l_quantity", None),
             ("lineitem", "flag", "few rows", None)]
    said = said.unionByName(spark.createDataFrame(fixed, "run_id string, kind string, name string, claimed double"))
    return L.check_recommendation(said, res, L.leaderboard(res, prim), importance_table(spark, sf))
