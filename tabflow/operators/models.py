"""MLlib candidate registry, training runner, tuning and improvement cycles.

Every fit is a distributed MLlib Estimator over an assembled feature vector; results are
rows of a results table ``(run_id, model, status, metric, value, error)`` so ranking,
acceptance and failure analysis are set-based queries (``leaderboard.py``). The driver
only loops over the (small) list of candidates, never over data.
"""

from __future__ import annotations

import json
import time
import traceback
from dataclasses import dataclass, field
from itertools import islice, product
from typing import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, FMRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.ordering import join_on
from tabflow.operators import metrics as V
from tabflow.operators import sums as S

# Fixed values.
SEED = 42
MIN_ROWS_REQUIRED = 20
MIN_CLASSES_REQUIRED = 2
MIN_ROWS_PER_FOLD = 10
MAX_TRIALS = 24
N_FOLDS = 3
DEFAULT_ACCEPTANCE = {"accuracy": 0.70, "roc_auc": 0.70, "f1": 0.65}
MAX_CYCLES = 3
CALIBRATION_FOLDS = 3
MIN_CALIBRATION_ROWS = 30  # of each class, so that every fold has some
MERGED = 8
CLASS_WEIGHT_MODELS = ("logistic_regression", "random_forest", "decision_tree", "svm")
CYCLE_VARIANTS = {
    2: {"random_forest": {"numTrees": 300, "maxDepth": 12}, "logistic_regression": {"regParam": 0.02},
        "gradient_boosting": {"maxIter": 300, "maxDepth": 6}, "decision_tree": {"maxDepth": 8},
        "svm": {"regParam": 0.5}, "k_nearest_neighbors": {"k": 7}, "neural_network": {"layers_hidden": [100, 50]}, "naive_bayes": {"smoothing": 1e-8}},
    3: {"random_forest": {"numTrees": 500, "maxDepth": 20}, "logistic_regression": {"regParam": 0.005},
        "gradient_boosting": {"maxIter": 500, "maxDepth": 8}, "decision_tree": {"maxDepth": 4},
        "svm": {"regParam": 2.0}, "k_nearest_neighbors": {"k": 15}, "neural_network": {"layers_hidden": [100, 50, 25]},
        "naive_bayes": {"smoothing": 1e-10}},
}


@dataclass
class Candidate:
    """A named model: task, an Estimator factory ``(features_col, label_col, n_features, n_classes)``,
    an optional parameter grid factory and whether features are standardised first."""
    name: str
    task: str
    make: Callable
    grid: Callable | None = None
    scaled: bool = False
    proba: bool = True
    weights: bool = False
    extra: dict = field(default_factory=dict)
    space: dict = field(default_factory=dict)  # M17: parameter -> values to try


REGISTRY: dict[tuple[str, str], Candidate] = {}


def register(c: Candidate) -> Candidate:
    REGISTRY[(c.task, c.name)] = c
    return c


def _grid(*pairs):
    def build(est):
        g = ParamGridBuilder()
        for param, values in pairs:
            g = g.addGrid(getattr(est, param), values)
        return g.build()
    return build


# Parameters to try, by task and name; "class_weight" is an axis of its own. Unbounded depth is MLlib's deepest, 30;
# boosting takes fewer iterations than in-memory libraries do, since each one is a job.
FOREST_SPACE = {"numTrees": [100, 300], "maxDepth": [30, 20], "minInstancesPerNode": [1, 2]}
BOOST_SPACE = {"maxIter": [20, 50], "maxDepth": [3, 6], "stepSize": [0.05, 0.1]}
TREE_SPACE = {"maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2]}
KNN_SPACE = {"k": [3, 5, 7]}
SPACES = {
    ("classification", "logistic_regression"): {"C": [0.1, 1.0, 10.0], "class_weight": [None, "balanced"]},
    ("classification", "random_forest"): FOREST_SPACE, ("regression", "random_forest"): FOREST_SPACE,
    ("classification", "gradient_boosting"): BOOST_SPACE, ("regression", "gradient_boosting"): BOOST_SPACE,
    ("classification", "decision_tree"): TREE_SPACE, ("regression", "decision_tree"): TREE_SPACE,
    ("classification", "svm"): {"C": [0.1, 1.0, 10.0]},
    ("classification", "k_nearest_neighbors"): KNN_SPACE, ("regression", "k_nearest_neighbors"): KNN_SPACE,
}


def _mlp(f, y, d, k, hidden=(100,), **kw):
    return MultilayerPerceptronClassifier(featuresCol=f, labelCol=y, layers=[d, *hidden, max(k, 2)], maxIter=500,
                                          seed=SEED)


def _gbt_clf(f, y, d, k, **kw):
    gbt = GBTClassifier(featuresCol="features", labelCol="label", seed=SEED, maxIter=kw.get("maxIter", 20),
                        maxDepth=kw.get("maxDepth", 5))
    if k > 2:
        return OneVsRest(classifier=gbt, featuresCol=f, labelCol=y)
    return gbt.setFeaturesCol(f).setLabelCol(y)


def _svc(f, y, d, k, **kw):
    reg = kw["regParam"] / 100 if "regParam" in kw else 0.01 / kw.get("C", 1.0)
    svc = LinearSVC(featuresCol="features", labelCol="label", regParam=reg, maxIter=100)
    if k > 2:
        return OneVsRest(classifier=svc, featuresCol=f, labelCol=y)
    return svc.setFeaturesCol(f).setLabelCol(y)


def _with(est, params: dict):
    """``est`` with those of ``params`` that it has as MLlib parameters (the others went into its making)."""
    for name, value in params.items():
        if est.hasParam(name):
            est = est._set(**{name: value})
    return est


for _c in [
    Candidate("baseline", "classification", lambda f, y, d, k, **kw: None, proba=False),
    Candidate("logistic_regression", "classification",
              lambda f, y, d, k, **kw: LogisticRegression(featuresCol=f, labelCol=y, maxIter=1000,
                                                          regParam=kw.get("regParam", 0.01 / kw.get("C", 1.0))),
              grid=_grid(("regParam", [0.001, 0.01, 0.1, 1.0])), scaled=True, weights=True),
    Candidate("random_forest", "classification",
              lambda f, y, d, k, **kw: RandomForestClassifier(featuresCol=f, labelCol=y, numTrees=kw.get("numTrees", 100),
                                                              maxDepth=kw.get("maxDepth", 5), seed=SEED),
              grid=_grid(("numTrees", [50, 100]), ("maxDepth", [5, 10])), weights=True),
    Candidate("gradient_boosting", "classification", _gbt_clf, grid=_grid(("maxDepth", [3, 5])), proba=True),
    Candidate("decision_tree", "classification",
              lambda f, y, d, k, **kw: DecisionTreeClassifier(featuresCol=f, labelCol=y,
                                                              maxDepth=kw.get("maxDepth", 5), seed=SEED),
              grid=_grid(("maxDepth", [3, 5, 8])), weights=True),
    Candidate("svm", "classification", _svc, scaled=True, weights=True),
    Candidate("naive_bayes", "classification",
              lambda f, y, d, k, **kw: NaiveBayes(featuresCol=f, labelCol=y, modelType="gaussian",
                                                  smoothing=kw.get("smoothing", 1e-9))),
    Candidate("neural_network", "classification",
              lambda f, y, d, k, **kw: _mlp(f, y, d, k, tuple(kw.get("layers_hidden", [100]))), scaled=True),
    Candidate("k_nearest_neighbors", "classification", lambda f, y, d, k, **kw: None, scaled=True),
    Candidate("baseline", "regression", lambda f, y, d, k, **kw: None, proba=False),
    Candidate("linear_regression", "regression",
              lambda f, y, d, k, **kw: LinearRegression(featuresCol=f, labelCol=y), proba=False),
    Candidate("random_forest", "regression",
              lambda f, y, d, k, **kw: RandomForestRegressor(featuresCol=f, labelCol=y, numTrees=100, seed=SEED),
              grid=_grid(("maxDepth", [5, 10])), proba=False),
    Candidate("gradient_boosting", "regression",
              lambda f, y, d, k, **kw: GBTRegressor(featuresCol=f, labelCol=y, seed=SEED, maxIter=20), proba=False),
    Candidate("decision_tree", "regression",
              lambda f, y, d, k, **kw: DecisionTreeRegressor(featuresCol=f, labelCol=y, seed=SEED), proba=False),
    Candidate("huber_regression", "regression",
              lambda f, y, d, k, **kw: LinearRegression(featuresCol=f, labelCol=y, loss="huber"), scaled=True,
              proba=False),
    Candidate("k_nearest_neighbors", "regression", lambda f, y, d, k, **kw: None, scaled=True, proba=False),
    Candidate("factorization_machine", "regression",
              lambda f, y, d, k, **kw: FMRegressor(featuresCol=f, labelCol=y, seed=SEED, stepSize=0.01), scaled=True,
              proba=False),
]:
    _c.space = SPACES.get((_c.task, _c.name), {})
    register(_c)


def candidates_for(task: str, names=None) -> list[Candidate]:
    out = [c for (t, _), c in REGISTRY.items() if t == task]
    return [c for c in out if names is None or c.name in names]


# ----------------------------------------------------------------------------- data preparation

def validate_input(df: DataFrame, label: str, features) -> DataFrame:
    """One aggregate; raises on missing columns, <20 rows or <2 classes."""
    missing = [c for c in [label, *features] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    r = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(label).alias("n_labelled"),
               F.countDistinct(label).alias("n_classes")).first()
    if r["n_rows"] < MIN_ROWS_REQUIRED:
        raise ValueError(f"Insufficient data: {r['n_rows']} rows (need at least {MIN_ROWS_REQUIRED}).")
    if r["n_classes"] < MIN_CLASSES_REQUIRED:
        raise ValueError(f"Invalid target values: found {r['n_classes']} class(es)")
    return df


def index_labels(train: DataFrame, label: str, out: str = "label_idx"):
    """Label codes by sorted label (alphabetAsc); the fitted indexer maps back."""
    idx = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="skip")
    model = idx.fit(train.withColumn(label, F.col(label).cast("string")))
    return model


def _keep_unseen(label_model):
    """The fitted indexer, keeping rows whose class it never saw (they get the code after the last)."""
    return label_model.copy().setHandleInvalid("keep")


def _prep(df: DataFrame, features, label: str, label_model=None):
    d = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f_{c}") for c in features])
    d = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(d)
    if label_model is not None:
        d = label_model.transform(d.withColumn(label, F.col(label).cast("string")))
    return d


def balanced_weights(train: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Class weights n / (k · n_c) joined by class (the class table is bounded by k)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.withColumn("_j", F.lit(1)).join(tot.withColumn("_j", F.lit(1)), "_j").select(
        label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(weight_col))
    return join_on(train, w, [label])  # a NULL class has its weight too; one row per class


# ----------------------------------------------------------------------------- fit / predict

def _knn_fit_predict(tr: DataFrame, te: DataFrame, features, y: str, label: str, task: str, labels, k: int = 5) -> DataFrame:
    """Exact ``k`` nearest training rows on features standardised with train mean / population
    std (std 0 → 1); majority vote (ties → first sorted class) or mean target."""
    from tabflow.operators import neighbors as N
    cols = [f"_f_{c}" for c in features]
    spark = tr.sparkSession
    from tabflow.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    # The train rows are written already, so their ids, which break ties, are stable. Test rows are searched once per distinct
    # vector and find their answer by their features.
    tr_r = tr.select(F.monotonically_increasing_id().alias("_id"), *cols, F.col(y).alias("_y"))
    te_r = te.select(*cols, F.col(label).alias("_label"))
    st = tr_r.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    vec = F.array(*[(F.col(c) - F.lit(st[f"m{i}"] or 0.0)) / F.lit(st[f"s{i}"] or 1.0) for i, c in enumerate(cols)])
    tr_i = tr_r.select("_id", vec.alias("_v"), "_y")
    asked = te_r.select(*cols).distinct().checkpoint(eager=True).withColumn("_id", F.monotonically_increasing_id())
    nb = N.knn_search(N.build_index(tr_i, "_id", F.col("_v"), payload=("_y",), k=k), asked.select("_id", vec.alias("_v")), "_id", F.col("_v"), k=k)
    if task == "classification":
        found = N.knn_vote(nb, "_y", classes=[float(i) for i in range(len(labels))])
    else:
        found = N.knn_mean(nb, "_y")
    found = asked.join(found, asked["_id"] == found["qid"], "left").drop("_id", "qid").checkpoint(eager=True)
    te_r = te_r.join(found, cols, "left")
    if task == "classification":
        out = te_r.select(
            F.col("_label").cast("string").alias("label"),
            F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("prediction").cast("int") + 1).alias("prediction"),
            F.col("probability"))
        if len(labels) == 2:
            out = out.withColumn("prob_pos", F.col("probability")[1])
        return out.checkpoint(eager=True)  # one row per test row; every metric reads it, none re-searches
    return te_r.select(F.col("_label").cast("double").alias("label"), F.col("prediction").cast("double")).checkpoint(eager=True)


def _platt(margins: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through (margin, z), with Platt's softened targets against over-confidence."""
    n = {r["z"]: r["n"] for r in margins.groupBy("z").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    up, down = (n.get(1.0, 0) + 1) / (n.get(1.0, 0) + 2), 1 / (n.get(0.0, 0) + 2)
    share = F.when(F.col("z") == 1, up).otherwise(down)
    rows = margins.select("margin", F.inline(F.array(F.struct(F.lit(1.0).alias("t"), share.alias("w")), F.struct(F.lit(0.0).alias("t"), (1 - share).alias("w")))))
    rows = VectorAssembler(inputCols=["margin"], outputCol="m").transform(rows)
    lr = LogisticRegression(featuresCol="m", labelCol="t", weightCol="w", maxIter=100, regParam=0.0, standardization=True).fit(rows)
    return float(lr.coefficients[0]), float(lr.intercept)


def _calibrated_svm(cand: Candidate, tr: DataFrame, y: str, n_classes: int, params: dict, weight_col: str | None) -> Callable:
    """Linear support vector machines with probabilities; returns ``apply(prepared test rows)``.

    One machine per pair of classes. Its margins are calibrated by a logistic curve through margins of rows it has not
    seen: ``CALIBRATION_FOLDS`` machines, each fitted without one fold, give the fold's margins. With more than two
    classes the pairs' probabilities r_ij are coupled: p_i is proportional to 1 / (sum over j of 1 / r_ij − (k − 2)).
    ``calibrate=False`` skips the folds (the probabilities are then plain logistic margins)."""
    from tabflow.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(tr.sparkSession)
    cols = ["features", y] + ([weight_col] if weight_col and weight_col in tr.columns else [])
    rows = tr.select(*cols).withColumn("_fold", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(CALIBRATION_FOLDS)).cast("int")).checkpoint(eager=True)
    scaler = StandardScaler(inputCol="features", outputCol="features_s", withMean=True, withStd=True).fit(rows)
    rows = scaler.transform(rows)
    sizes = {int(r[0]): r[1] for r in rows.groupBy(y).agg(F.count(F.lit(1))).collect()}  # one row per class
    raw = lambda m, d: m.transform(d).select("z", vector_to_array("rawPrediction")[1].alias("margin"))
    pairs = []
    for a in range(n_classes):
        for b in range(a + 1, n_classes):
            two = rows.where(F.col(y).isin(float(a), float(b))).withColumn("z", (F.col(y) == b).cast("double"))
            svc = cand.make("features_s", "z", 0, 2, **params)
            if len(cols) > 2 and cand.weights:
                svc = svc.setWeightCol(weight_col)
            model, curve = svc.fit(two), (1.0, 0.0)
            if params.get("calibrate", True):
                if min(sizes.get(a, 0), sizes.get(b, 0)) >= MIN_CALIBRATION_ROWS:
                    parts = [raw(svc.fit(two.where(F.col("_fold") != f)), two.where(F.col("_fold") == f)) for f in range(CALIBRATION_FOLDS)]
                else:  # too few rows to leave any out
                    parts = [raw(model, two)]
                margins = parts[0]
                for p in parts[1:]:
                    margins = margins.unionByName(p)
                curve = _platt(margins.checkpoint(eager=True))
            pairs.append((a, b, model, curve))

    def apply(te: DataFrame) -> DataFrame:
        d = scaler.transform(te)
        r = {}
        for i, (a, b, model, (slope, cut)) in enumerate(pairs):
            d = model.copy().setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_side{i}").transform(d)
            up = 1 / (1 + F.exp(-(vector_to_array(f"_raw{i}")[1] * slope + cut)))
            d = d.withColumn(f"_up{i}", F.least(F.greatest(up, F.lit(1e-7)), F.lit(1 - 1e-7))).drop(f"_raw{i}", f"_side{i}")
            r[b, a], r[a, b] = F.col(f"_up{i}"), 1 - F.col(f"_up{i}")
        k = n_classes
        if k == 1:
            p = [F.lit(1.0)]
        elif k == 2:
            p = [r[0, 1], r[1, 0]]
        else:
            p = [1 / (sum((1 / r[i, j] for j in range(k) if j != i), F.lit(0.0)) - (k - 2)) for i in range(k)]
        d = d.withColumn("_p", F.array(*p))
        total = F.aggregate("_p", F.lit(0.0), lambda acc, v: acc + v)
        d = d.withColumn("probability", F.transform("_p", lambda v: v / total))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return d.withColumn("prediction", best.cast("double"))

    return apply


def _fit_sums(est, tr: DataFrame, inputs: list[str], y: str, n_classes: int) -> Callable | None:
    """``apply(prepared test rows)`` of an estimator that needs the train rows only as sums (``sums.py``), else None."""
    if isinstance(est, FMRegressor) and est.getFeaturesCol() == "features_s":
        return S.fit_fm(est, tr, inputs, y)
    if isinstance(est, (GBTRegressor, GBTClassifier)):
        return S.fit_boosted(est, tr, inputs, y, isinstance(est, GBTClassifier))
    if isinstance(est, (RandomForestRegressor, RandomForestClassifier)):
        return S.fit_forest(est, tr, inputs, y, n_classes if isinstance(est, RandomForestClassifier) else 0)
    return None


def _merged(rows: DataFrame) -> DataFrame:
    """The rows in no more partitions than can run at once, at most ``MERGED`` joined to one: for fits of hundreds of short passes."""
    n = rows.rdd.getNumPartitions()
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // MERGED)))


def fit_predict(cand: Candidate, train: DataFrame, test: DataFrame, features, label: str, task: str,
                params: dict | None = None, weight_col: str | None = None, prepared: Prepared | None = None) -> DataFrame:
    """Train on ``train``, predict ``test``: ``(label, prediction[, prob_pos, probability])``."""
    return fit_candidate(cand, train, features, label, task, params, weight_col, prepared)(test)


@dataclass
class Prepared:
    """Train rows ready for any candidate (written once: every fit makes several passes), and the label codes."""
    rows: DataFrame
    y: str
    labels: list | None
    label_model: object


def prepare_train(train: DataFrame, features, label: str, task: str, weight_col: str | None = None) -> Prepared:
    from tabflow.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(train.sparkSession)
    lm = index_labels(train, label) if task == "classification" else None
    y = "label_idx" if lm is not None else label
    inputs = [f"_f_{c}" for c in features]
    cols = list(dict.fromkeys([y, *inputs])) + ([weight_col] if weight_col and weight_col in train.columns else [])
    rows = _prep(train, features, label, lm).select(*cols).checkpoint(eager=True)
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)  # the numbers are written once, not twice
    return Prepared(rows, y, lm.labels if lm is not None else None, lm)


def fit_candidate(cand: Candidate, train: DataFrame, features, label: str, task: str, params: dict | None = None,
                  weight_col: str | None = None, prepared: Prepared | None = None) -> Callable[[DataFrame], DataFrame]:
    """Train on ``train`` (or on its ``prepared`` rows); returns ``predict(test)``, which uses this very fit every time it is called.

    Test rows whose class is not in ``train`` are predicted like any other (and so count as wrong)."""
    params = dict(params or {})
    if params.pop("class_weight", None) == "balanced" and not weight_col:
        weight_col, prepared = "_weight", None
        train = balanced_weights(train, label, weight_col)
    prepared = prepared or prepare_train(train, features, label, task, weight_col)
    tr, y, labels, lm = prepared.rows, prepared.y, prepared.labels, prepared.label_model

    def as_trained(test: DataFrame) -> DataFrame:
        return _prep(test, features, label, _keep_unseen(lm) if lm is not None else None)

    if cand.name == "k_nearest_neighbors":
        def predict(test: DataFrame) -> DataFrame:
            return _knn_fit_predict(tr, as_trained(test), features, y, label, task, labels, params.get("k", 5))

        predict.labels = labels
        return predict
    if cand.name == "svm" and task == "classification":
        apply = _calibrated_svm(cand, tr, y, len(labels), params, weight_col)
    elif cand.name == "baseline":  # M01 / M02
        if task == "classification":
            best = tr.groupBy(y).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(y)).first()[y]
        else:
            best = tr.agg(F.avg(y)).first()[0]

        def apply(te: DataFrame) -> DataFrame:
            return te.withColumn("prediction", F.lit(float(best)))
    else:
        est = _with(cand.make("features_s" if cand.scaled else "features", y, len(features), len(labels or []), **params), params)
        if weight_col and cand.weights and hasattr(est, "setWeightCol"):
            est = est.setWeightCol(weight_col)
        apply = _fit_sums(est, tr, [f"_f_{c}" for c in features], y, len(labels or []))
        if apply is None:
            stages = ([StandardScaler(inputCol="features", outputCol="features_s", withMean=True, withStd=True)]
                      if cand.scaled else []) + [est]
            fit_cols = ["features", y] + ([weight_col] if weight_col and weight_col in tr.columns else [])
            rows = tr.select(*fit_cols)
            model = Pipeline(stages=stages).fit(_merged(rows) if cand.name == "neural_network" else rows)
            apply = model.transform

    def predict(test: DataFrame) -> DataFrame:
        pred = apply(as_trained(test))
        if task == "classification":
            out = pred.select(F.col(label).cast("string").alias("label"),
                              F.element_at(F.array(*[F.lit(v) for v in labels]),
                                           F.col("prediction").cast("int") + 1).alias("prediction"),
                              *([(F.col("probability") if isinstance(pred.schema["probability"].dataType, T.ArrayType)
                                  else vector_to_array("probability")).alias("probability")]
                                if cand.proba and "probability" in pred.columns else []))
            if "probability" in out.columns and len(labels) == 2:
                out = out.withColumn("prob_pos", F.col("probability")[1])  # M19: second sorted class
            return out.checkpoint(eager=True)  # one row per test row; every metric pass reads it
        return pred.select(F.col(label).cast("double").alias("label"), F.col("prediction").cast("double")) \
            .checkpoint(eager=True)

    predict.labels = labels
    return predict


def score_predictions(pred: DataFrame, task: str, labels=None) -> DataFrame:
    """Metrics of one prediction table as long ``(metric, value)`` rows (V13): accuracy, weighted precision, recall and
    f1, ROC-AUC and PR-AUC (macro for more than two ``labels``); or mae, rmse, r2, mape and smape."""
    if task == "classification":
        acc = V.accuracy(pred)
        prf = V.weighted_prf(pred)
        wide = acc.withColumn("_k", F.lit(1)).join(prf.withColumn("_k", F.lit(1)), "_k")
        names = ["accuracy", "precision", "recall", "f1"]
        if "prob_pos" in pred.columns:
            pos = labels[1] if labels else pred.agg(F.max("label")).first()[0]
            auc = V.roc_auc_binary(pred, "label", "prob_pos", pos)
            pr = V.average_precision(pred, "label", "prob_pos", pos)
            wide = wide.join(auc.withColumn("_k", F.lit(1)), "_k").join(pr.withColumn("_k", F.lit(1)), "_k")
            names += ["roc_auc", "pr_auc"]
        elif "probability" in pred.columns and labels and len(labels) > 2:
            # One row per test row and class (a fitted model's classes); macro one-vs-rest.
            probs = pred.withColumn("_row", F.monotonically_increasing_id()).select(
                "_row", "label", F.posexplode("probability").alias("_c", "prob")).select(
                "_row", "label", "prob", F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("_c") + 1).alias("class"))
            auc = V.roc_auc_ovr(probs, "_row").select(F.col("roc_auc_ovr").alias("roc_auc"))
            pr = V.pr_auc_macro(probs, "_row").select(F.col("pr_auc_macro").alias("pr_auc"))
            wide = wide.join(auc.withColumn("_k", F.lit(1)), "_k").join(pr.withColumn("_k", F.lit(1)), "_k")
            names += ["roc_auc", "pr_auc"]
        return V.to_long(wide, names)
    return V.to_long(V.regression_metrics(pred), ["mae", "rmse", "r2", "mape", "smape"])


def run_candidates(spark: SparkSession, train: DataFrame, test: DataFrame, features, label: str, task: str,
                   names=None, run_id: str = "run", params: dict | None = None, weight_col: str | None = None,
                   cycle: int = 1, fitted: dict | None = None) -> DataFrame:
    """Train every candidate; a failure becomes a result row and never aborts the run.

    The train rows are prepared and written once for all candidates. ``fitted`` collects ``(cycle, model name) -> predict``
    of every fit."""
    rows = []
    try:
        prepared = prepare_train(train, features, label, task, weight_col)
    except Exception:  # noqa: BLE001
        prepared = None  # then every candidate tells why
    for cand in candidates_for(task, names):
        t0 = time.time()
        try:
            predict = fit_candidate(cand, train, features, label, task, (params or {}).get(cand.name), weight_col, prepared)
            pred = predict(test)
            if fitted is not None:
                fitted[(cycle, cand.name)] = predict
            for r in score_predictions(pred, task, getattr(predict, "labels", None)).collect():  # a handful of metric rows
                rows.append((run_id, cycle, cand.name, "success", r["metric"], r["value"], None,
                             round(time.time() - t0, 3)))
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {e}"
            rows.append((run_id, cycle, cand.name, "failed", None, None, msg, round(time.time() - t0, 3)))
            traceback.clear_frames(e.__traceback__)
    return spark.createDataFrame(rows, RESULT_SCHEMA)


RESULT_SCHEMA = ("run_id string, cycle int, model string, status string, metric string, value double, "
                 "error string, train_seconds double")


def cv_score(train: DataFrame, features, label: str, task: str, cand: Candidate, fold_col: str = "fold",
             grid=None, max_trials: int | None = MAX_TRIALS) -> tuple[float | None, dict]:
    """Mean cross-validated score on train rows with precomputed folds (X07/X08);
    skipped (None) below 10 rows per fold. With a grid, the best parameters are returned;
    a grid of more than ``max_trials`` points is an error (None: any size).

    A ``scaled`` candidate is scored with its scaler, fitted inside every fold."""
    n, k = train.agg(F.count(F.lit(1)), F.countDistinct(fold_col)).first()
    if k < 2 or n / k < MIN_ROWS_PER_FOLD or cand.name == "baseline":
        return None, {}
    if cand.name == "k_nearest_neighbors":  # no Estimator: score each held-out fold in turn (k ≤ a few)
        folds = [r[0] for r in train.select(fold_col).distinct().collect()]
        scores = []
        for f in folds:
            pred = fit_predict(cand, train.where(F.col(fold_col) != f), train.where(F.col(fold_col) == f),
                               features, label, task)
            if task == "classification":
                scores.append(pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
            else:
                scores.append(pred.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0])
        return float(sum(scores) / len(scores)), {}
    if task == "classification":
        lm = index_labels(train, label)
        d = _prep(train, features, label, lm)
        y, ev = "label_idx", MulticlassClassificationEvaluator(labelCol="label_idx", metricName="accuracy")
        n_classes = len(lm.labels)
    else:
        d, y, n_classes = _prep(train, features, label), label, 0
        ev = RegressionEvaluator(labelCol=label, metricName="rmse")
    from tabflow.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(train.sparkSession)
    # Every fold and grid point reads the prepared rows; write them once instead of re-deriving them.
    d = d.select("features", y, fold_col).checkpoint(eager=True)
    est = cand.make("features_s" if cand.scaled else "features", y, len(features), n_classes)
    maps = (grid(est) if grid else None) or ParamGridBuilder().build()
    if max_trials is not None and len(maps) > max_trials:
        raise ValueError(f"the grid has {len(maps)} points, more than max_trials={max_trials}")
    whole = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="features_s", withMean=True, withStd=True), est]) if cand.scaled else est
    cv = CrossValidator(estimator=whole, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col, parallelism=4,
                        seed=SEED)
    model = cv.fit(d.withColumn(fold_col, F.col(fold_col).cast("int")))
    scores = model.avgMetrics
    best = max(range(len(scores)), key=lambda i: scores[i] if ev.isLargerBetter() else -scores[i])
    best_params = {p.name: v for p, v in maps[best].items()}
    return float(scores[best]), best_params


TUNE_METRICS = {"classification": ("f1", "accuracy"), "regression": ("rmse", "mae", "r2")}


def _tune_score(pred: DataFrame, task: str, metric: str) -> float | None:
    """One metric of a prediction table, larger is better."""
    if task == "classification":
        return (V.accuracy(pred) if metric == "accuracy" else V.weighted_prf(pred)).first()[metric]
    value = V.regression_metrics(pred).first()[metric]
    return value if metric == "r2" or value is None else -value


def tune_model(train: DataFrame, features, label: str, task: str, cand: Candidate, fold_col: str = "fold", metric: str | None = None,
               max_trials: int = MAX_TRIALS, space: dict | None = None) -> dict:
    """Try every point of ``cand.space`` (the first ``max_trials``, last axis fastest) on the given folds of train rows
    and return the best: ``{model, status, params, score, metric, trials, error}``; score is the mean over the folds, larger
    is better (errors negated), and equal scores go to the earlier point. A candidate without a space is skipped, and a
    failure is a result, not an exception."""
    from tabflow.session import ensure_checkpoint_dir
    out = {"model": cand.name, "status": "skipped", "params": None, "score": None, "metric": None, "trials": 0, "error": None}
    space = cand.space if space is None else space
    if not space:
        return dict(out, error="no tuning space")
    metric = metric or TUNE_METRICS[task][0]
    if metric not in TUNE_METRICS[task]:
        raise ValueError(f"metric must be one of {TUNE_METRICS[task]}")
    ensure_checkpoint_dir(train.sparkSession)
    try:
        rows = train.checkpoint(eager=True)  # read by every trial
        folds = [r[0] for r in rows.select(fold_col).distinct().orderBy(fold_col).collect()]
        ready = {f: prepare_train(rows.where(F.col(fold_col) != f), features, label, task) for f in folds}  # for all trials
        best, trials = None, 0
        for point in islice(product(*space.values()), max_trials):
            params = {k: v for k, v in zip(space, point) if v is not None}
            use = dict(params, calibrate=False) if cand.name == "svm" else params
            scores = [_tune_score(fit_predict(cand, rows.where(F.col(fold_col) != f), rows.where(F.col(fold_col) == f), features, label, task, use,
                                              None, ready[f]), task, metric) for f in folds]
            trials += 1
            score = sum(scores) / len(scores)
            if best is None or score > best[0]:
                best = (score, params)
        return dict(out, status="success", params=best[1], score=round(best[0], 6), metric=metric, trials=trials)
    except Exception as e:  # noqa: BLE001
        traceback.clear_frames(e.__traceback__)
        return dict(out, status="failed", metric=metric, error=f"{type(e).__name__}: {e}")


TUNE_SCHEMA = "model string, status string, params string, score double, metric string, trials int, error string"


def tune_models(train: DataFrame, features, label: str, task: str, names=None, fold_col: str = "fold", metric: str | None = None,
                max_trials: int = MAX_TRIALS) -> tuple[DataFrame, dict]:
    """M17 for many candidates: the table of ``tune_model`` results (params as JSON) and the best parameters by name, to be
    given to ``run_candidates(params=...)``, which fits each once on all of train."""
    found = [tune_model(train, features, label, task, c, fold_col, metric, max_trials) for c in candidates_for(task, names)]
    rows = [tuple(json.dumps(r[k], sort_keys=True) if k == "params" and r[k] is not None else r[k] for k in
                  ("model", "status", "params", "score", "metric", "trials", "error")) for r in found]
    return train.sparkSession.createDataFrame(rows, TUNE_SCHEMA), {r["model"]: r["params"] for r in found if r["status"] == "success"}


def meets_acceptance(results: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Per (run, cycle, model): every threshold met, a missing metric counts as not met."""
    th = DEFAULT_ACCEPTANCE if thresholds is None else thresholds
    spark = results.sparkSession
    if not th:  # nothing to meet is never met
        return results.select("run_id", "cycle", "model", F.lit(False).alias("accepted")).distinct()
    t = spark.createDataFrame(list(th.items()), "metric string, threshold double")
    models = results.select("run_id", "cycle", "model").distinct()
    pairs = models.withColumn("_k", F.lit(1)).join(F.broadcast(t.withColumn("_k", F.lit(1))), "_k").drop("_k")
    j = pairs.join(results.where(F.col("status") == "success").select("run_id", "cycle", "model", "metric", "value"),
                   ["run_id", "cycle", "model", "metric"], "left")
    return j.groupBy("run_id", "cycle", "model").agg(
        F.bool_and(F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False))).alias("accepted"))


def best_so_far(results: DataFrame, metric: str, n: int = 3, higher_is_better: bool = True) -> DataFrame:
    """Top-n model names by their best score so far."""
    agg = F.max("value") if higher_is_better else F.min("value")
    best = (results.where((F.col("status") == "success") & (F.col("metric") == metric))
            .groupBy("model").agg(agg.alias("best")))
    order = F.desc("best") if higher_is_better else F.asc("best")
    return best.orderBy(order, F.asc("model")).limit(n)


def best_cycle(results: DataFrame, metric: str = "f1", higher_is_better: bool = True) -> DataFrame:
    """The winning fit per run: ``(run_id, cycle, model, best)`` with the best ``metric`` over all cycles (ties: the
    earlier cycle, then the smaller name)."""
    v = F.col("value") if higher_is_better else -F.col("value")
    ok = results.where((F.col("status") == "success") & (F.col("metric") == metric) & F.col("value").isNotNull())
    return (ok.groupBy("run_id").agg(F.min(F.struct((-v).alias("loss"), "cycle", "model", "value")).alias("w"))
            .select("run_id", "w.cycle", "w.model", F.col("w.value").alias("best")))


def improvement_cycles(spark: SparkSession, train: DataFrame, valid: DataFrame, test: DataFrame, features,
                       label: str, names=None, thresholds: dict | None = None, metric: str = "f1",
                       key_cols=("id",)) -> tuple[DataFrame, str | None, DataFrame | None]:
    """≤3 cycles on validation; cycle 1 defaults; then class weights (+ oversampling) when
    imbalanced and a candidate can use weights, else fixed variants of the top 3; stop when a candidate is
    accepted. The winner is the best fit over all cycles by ``metric``; if it was accepted, that very fit (its
    parameters, weights and sampling) is scored once on test, otherwise there is no test score."""
    from tabflow.operators.split import class_balance, oversample
    imbalanced = class_balance(train, label).agg(F.max(F.col("imbalanced").cast("int"))).first()[0] == 1
    all_results, fitted = None, {}
    names = list(names) if names else [c.name for c in candidates_for("classification")]
    todo, params, weight, tr = names, {}, None, train
    for cycle in range(1, MAX_CYCLES + 1):
        res = run_candidates(spark, tr, valid, features, label, "classification", todo, params=params,
                             weight_col=weight, cycle=cycle, fitted=fitted).cache()
        all_results = res if all_results is None else all_results.unionByName(res)
        if meets_acceptance(res, thresholds).where("accepted").limit(1).count() > 0:
            break
        if cycle == MAX_CYCLES:
            break
        if imbalanced and any(m in CLASS_WEIGHT_MODELS for m in names):
            todo = [m for m in names if m in CLASS_WEIGHT_MODELS]
            tr = balanced_weights(train, label)
            weight = "weight"
            if cycle + 1 == 3:
                tr = balanced_weights(oversample(train, label, list(key_cols)).drop("draw"), label)
        else:
            top = [r["model"] for r in best_so_far(all_results, metric, 3).collect()]
            todo = [m for m in top if m != "baseline"]
            params = {m: CYCLE_VARIANTS[cycle + 1].get(m, {}) for m in todo}
    best = best_cycle(all_results, metric).first()
    if best is None:
        return all_results, None, None
    met = meets_acceptance(all_results, thresholds).where(
        "accepted and cycle = {} and model = '{}'".format(best["cycle"], best["model"])).limit(1).count() > 0
    if not met:
        return all_results, best["model"], None
    winner = fitted[(best["cycle"], best["model"])]
    scores = score_predictions(winner(test), "classification", getattr(winner, "labels", None)).collect()
    final = spark.createDataFrame([("run", 0, best["model"], "success", r["metric"], r["value"], None, None) for r in scores],
                                  RESULT_SCHEMA)
    return all_results, best["model"], final
