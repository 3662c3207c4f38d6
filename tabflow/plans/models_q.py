"""Registered queries for model training (M01–M23, U01). MLlib fits are rows-only checks;
baselines, label indexing, one-feature regression and the results-table rules have oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.functions.exprs import hash_unit
from tabflow.operators import models as M
from tabflow.operators.split import kfold, kfold_stratified, split_stratified
from tabflow.plans.common import sql_hash_unit
from tabflow.plans.registry import query, table

DOC_FEATURES = ["n_chars", "n_words", "n_lines", "is_en"]
REG_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def doc_frame(spark, sf):
    """documents ⋈ labels with simple numeric text features and the ``quality`` label."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        (F.col("lang") == "en").cast("double").alias("is_en"), "quality", "toxic")


def reg_frame(spark, sf):
    """lineitem with a derived target ``y = 3·qty + 100·discount + hash noise``."""
    li = table(spark, sf, "lineitem")
    y = 3 * F.col("l_quantity") + 100 * F.col("l_discount") + 10 * hash_unit("l_orderkey", "l_linenumber", seed=5)
    return li.select("l_orderkey", "l_linenumber", *REG_FEATURES, y.alias("y"),
                     (hash_unit("l_orderkey", "l_linenumber") < 0.8).alias("is_train"))


def _doc_split(spark, sf):
    d = doc_frame(spark, sf)
    tr = d.where(hash_unit("doc_id") < 0.8)
    te = d.where(hash_unit("doc_id") >= 0.8)
    return tr, te


H_DOC = sql_hash_unit("doc_id")


def _run(*args, **kw):
    """Results without the wall time, so that they repeat."""
    return M.run_candidates(*args, **kw).drop("train_seconds")


@query("clf_baseline", f"""WITH tr AS (SELECT quality FROM labels WHERE {H_DOC} < 0.8),
m AS (SELECT CAST(quality AS VARCHAR) AS prediction FROM tr GROUP BY quality ORDER BY count(*) DESC, CAST(quality AS VARCHAR)
      LIMIT 1)
SELECT (SELECT prediction FROM m) AS prediction, count(*) AS n_test,
  round(avg(CAST(CAST(quality AS VARCHAR) = (SELECT prediction FROM m) AS DOUBLE)), 6) AS accuracy
FROM labels WHERE {H_DOC} >= 0.8""")
def clf_baseline(spark, sf):
    lab = table(spark, sf, "labels")
    tr, te = lab.where(hash_unit("doc_id") < 0.8), lab.where(hash_unit("doc_id") >= 0.8)
    pred = M.fit_predict(M.REGISTRY[("classification", "baseline")], tr, te, ["toxic"], "quality", "classification")
    return pred.agg(F.first("prediction").alias("prediction"), F.count(F.lit(1)).alias("n_test"),
                    F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy"))


H_LI = sql_hash_unit("l_orderkey", "l_linenumber")
REG_SQL = f"""(SELECT l_quantity, l_discount, l_tax,
  3 * l_quantity + 100 * l_discount + 10 * {sql_hash_unit('l_orderkey', 'l_linenumber', seed=5)} AS y,
  {H_LI} < 0.8 AS is_train FROM lineitem)"""


@query("reg_baseline", f"""SELECT count(*) AS n_test,
  round(sqrt(avg((y - (SELECT avg(y) FROM {REG_SQL} WHERE is_train)) ^ 2)), 6) AS rmse
FROM {REG_SQL} WHERE NOT is_train""")
def reg_baseline(spark, sf):
    d = reg_frame(spark, sf)
    pred = M.fit_predict(M.REGISTRY[("regression", "baseline")], d.where("is_train"), d.where("not is_train"),
                         REG_FEATURES, "y", "regression")
    return pred.agg(F.count(F.lit(1)).alias("n_test"),
                    F.round(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2)), 6).alias("rmse"))


@query("reg_linear", f"""SELECT round(regr_slope(y, l_quantity), 4) AS slope,
  round(regr_intercept(y, l_quantity), 4) AS intercept FROM {REG_SQL} WHERE is_train""")
def reg_linear(spark, sf):
    from pyspark.ml.regression import LinearRegression
    d = M._prep(reg_frame(spark, sf).where("is_train"), ["l_quantity"], "y")
    m = LinearRegression(featuresCol="features", labelCol="y", solver="normal").fit(d)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))],
                                 "slope double, intercept double")


@query("target_index", """SELECT o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE)
  AS label_idx FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def target_index(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus")
    lm = M.index_labels(o, "o_orderstatus")
    return lm.transform(o.distinct()).select("o_orderstatus", "label_idx")


@query("input_checks", f"""SELECT count(*) AS n_rows, count(quality) AS n_labelled,
  count(DISTINCT quality) AS n_classes, count(*) >= 20 AND count(DISTINCT quality) >= 2 AS valid FROM labels""")
def input_checks(spark, sf):
    lab = table(spark, sf, "labels")
    M.validate_input(lab, "quality", ["toxic"])
    return lab.agg(F.count(F.lit(1)).alias("n_rows"), F.count("quality").alias("n_labelled"),
                   F.countDistinct("quality").alias("n_classes"), F.lit(True).alias("valid"))


def _clf(name):
    def run(spark, sf):
        tr, te = _doc_split(spark, sf)
        return _run(spark, tr, te, DOC_FEATURES, "quality", "classification", [name], run_id=name)
    return run


def _reg(name):
    def run(spark, sf):
        d = reg_frame(spark, sf)
        return _run(spark, d.where("is_train"), d.where("not is_train"), REG_FEATURES, "y", "regression",
                                [name], run_id=name)
    return run


for _key, _name in [("clf_logistic", "logistic_regression"), ("clf_forest", "random_forest"),
                    ("clf_gbt", "gradient_boosting"), ("clf_tree", "decision_tree"), ("clf_linear_svc", "svm"),
                    ("clf_naive_bayes", "naive_bayes"), ("clf_mlp", "neural_network"),
                    ("clf_knn_scaled", "k_nearest_neighbors")]:
    query(_key)(_clf(_name))
for _key, _name in [("reg_forest", "random_forest"), ("reg_gbt", "gradient_boosting"), ("reg_tree", "decision_tree"),
                    ("reg_huber", "huber_regression"), ("reg_fm", "factorization_machine"),
                    ("reg_linear_fit", "linear_regression"), ("reg_knn_scaled", "k_nearest_neighbors")]:
    query(_key)(_reg(_name))


@query("class_probabilities")
def class_probabilities(spark, sf):
    """The positive class's probability by logistic regression and by the calibrated support vector machine."""
    tr, te = _doc_split(spark, sf)
    out = None
    for name in ("logistic_regression", "svm"):
        pred = M.fit_predict(M.REGISTRY[("classification", name)], tr, te, DOC_FEATURES, "quality", "classification")
        one = pred.select(F.lit(name).alias("model"), "label", "prediction", F.round("prob_pos", 6).alias("prob_pos"))
        out = one if out is None else out.unionByName(one)
    return out


@query("cv_score")
def cv_score(spark, sf):
    d = reg_frame(spark, sf).where("is_train")
    folds = kfold(d, ["l_orderkey", "l_linenumber"], k=3)
    score, _ = M.cv_score(folds, REG_FEATURES, "y", "regression", M.REGISTRY[("regression", "linear_regression")])
    return spark.createDataFrame([("linear_regression", "rmse", score)], "model string, metric string, value double")


@query("tune_grid")
def tune_grid(spark, sf):
    """The linear and the tree candidate tuned by f1 over their whole spaces; the best parameters refitted on all train rows."""
    tr, te = _doc_split(spark, sf)
    folds, _ = kfold_stratified(tr, "quality", ["doc_id"], k=3)
    names = ["logistic_regression", "decision_tree"]
    tuned, params = M.tune_models(folds, DOC_FEATURES, "quality", "classification", names)
    refit = _run(spark, tr, te, DOC_FEATURES, "quality", "classification", sorted(params), params=params, run_id="tuned")
    test = refit.where("metric = 'f1'").select("model", F.round("value", 6).alias("test_f1"))
    return tuned.join(test, "model", "left").drop("error")


@query("run_candidates")
def run_candidates(spark, sf):
    tr, te = _doc_split(spark, sf)
    return _run(spark, tr, te, DOC_FEATURES, "quality", "classification", run_id="labels")


@query("improvement_cycles")
def improvement_cycles(spark, sf):
    d = doc_frame(spark, sf)
    s = split_stratified(d, "quality", ["doc_id"]).cache()
    res, best, final = M.improvement_cycles(
        spark, s.where("split = 'train'"), s.where("split = 'validation'"), s.where("split = 'test'"),
        DOC_FEATURES, "quality", names=["baseline", "logistic_regression", "decision_tree"], key_cols=["doc_id"])
    # Wall time is no result: it stays in the operator's table.
    return (res.unionByName(final) if final is not None else res).drop("train_seconds")


@query("best_cycle", """WITH r AS (SELECT 'run' || (doc_id % 3) AS run_id, CAST(doc_id % 4 AS INTEGER) AS cycle, lang AS model,
    CASE WHEN source = 'src3' THEN 'failed' ELSE 'success' END AS status, round(avg(n_chars), 3) AS value FROM documents GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, cycle, model) AS rk FROM r WHERE status = 'success')
SELECT run_id, cycle, model, value AS best FROM k WHERE rk = 1""")
def best_cycle(spark, sf):
    """M20's choice on a results table made of the documents: best value per run, then earlier cycle, then name."""
    d = table(spark, sf, "documents")
    res = d.groupBy(F.concat(F.lit("run"), (F.col("doc_id") % 3).cast("string")).alias("run_id"), (F.col("doc_id") % 4).cast("int").alias("cycle"),
                    F.col("lang").alias("model"), F.when(F.col("source") == "src3", "failed").otherwise("success").alias("status")).agg(
        F.round(F.avg("n_chars"), 3).alias("value")).withColumn("metric", F.lit("f1"))
    return M.best_cycle(res)


@query("registry_custom")
def registry_custom(spark, sf):
    """A user-registered candidate (ridge regression) runs through the same runner."""
    from pyspark.ml.regression import LinearRegression
    M.register(M.Candidate("ridge", "regression",
                           lambda f, y, d, k, **kw: LinearRegression(featuresCol=f, labelCol=y, regParam=1.0,
                                                                     elasticNetParam=0.0), proba=False))
    d = reg_frame(spark, sf)
    return _run(spark, d.where("is_train"), d.where("not is_train"), REG_FEATURES, "y", "regression",
                            ["ridge"], run_id="custom")
