"""Set-based evaluation metrics (V01–V15) over prediction tables.

Classification input: ``(label, prediction)`` and, for ranking metrics, a score per row
(binary) or a long ``(row key, class, prob)`` table (multiclass). Ranking metrics are
exact (no binning): rows are first aggregated per distinct score, then running totals
over scores come from range-partitioned slices (``running_totals``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.functions.ordering import running_totals

# Fixed values.
LOWER_IS_BETTER = ("rmse", "mae", "mape", "smape", "mase")
METRIC_ALIASES = {"root_mean_squared_error": "rmse", "mean_absolute_error": "mae",
                  "mean_absolute_percentage_error": "mape",
                  "symmetric_mean_absolute_percentage_error": "smape"}
SMAPE_FLOOR = 1e-9


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """V01."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def per_class_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """``(class, tp, fp, fn, support)`` over the union of true and predicted classes."""
    y, p = F.col(label).cast("string"), F.col(pred).cast("string")
    both = df.select(F.explode(F.array(F.struct(y.alias("cls"), (y == p).cast("int").alias("tp"),
                                                F.lit(0).alias("fp"), (y != p).cast("int").alias("fn"),
                                                F.lit(1).alias("support")),
                                       F.struct(p.alias("cls"), F.lit(0).alias("tp"), (y != p).cast("int").alias("fp"),
                                                F.lit(0).alias("fn"), F.lit(0).alias("support")))).alias("s"))
    return both.groupBy("s.cls").agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "fp", "fn", "support")]) \
        .withColumnRenamed("cls", "class")


def per_class_prf(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision / recall / F1 per class; zero division → 0."""
    c = per_class_counts(df, label, pred)
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return c.select("class", "support", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def weighted_prf(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Support-weighted precision, recall and F1."""
    p = per_class_prf(df, label, pred)
    tot = F.sum("support")
    return p.agg(*[(F.sum(F.col(m) * F.col("support")) / tot).alias(m) for m in ("precision", "recall", "f1")])


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """``(actual, predicted, count)`` for every pair of sorted classes, zeros included.

    The class list (bounded by the number of classes) is gathered with ``collect_set`` and
    exploded twice; counts come from one ``groupBy``."""
    y, p = F.col(label).cast("string"), F.col(pred).cast("string")
    classes = df.agg(F.array_sort(F.array_union(F.collect_set(y), F.collect_set(p))).alias("c"))
    pairs = classes.select(F.explode("c").alias("actual"), "c").select("actual", F.explode("c").alias("predicted"))
    counts = df.groupBy(y.alias("actual"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    return pairs.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def _score_table(df: DataFrame, positive, score: str, group_cols=()):
    g = list(group_cols)
    return df.groupBy(*g, F.col(score).cast("double").alias("s")).agg(
        F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))


def roc_auc_binary(df: DataFrame, label: str, score: str, positive_value=1, group_cols=()) -> DataFrame:
    """Exact ROC-AUC with tied scores counted as half (rank-sum form).

    NULL when a group has only one class."""
    g = list(group_cols)
    st = _score_table(df, F.col(label) == F.lit(positive_value), score, g)
    cum = running_totals(st, "s", ["neg"], partition_cols=g)
    part = cum.select(*g, "pos", "neg", (F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg")))
                      .alias("num"))
    agg = part.groupBy(*g).agg(F.sum("num").alias("num"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(*g, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("num") / (F.col("P") * F.col("N")))
                      .alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, positive_value=1, group_cols=()) -> DataFrame:
    """Average precision = Σ (R_k − R_{k−1}) · P_k over distinct thresholds, descending."""
    g = list(group_cols)
    st = _score_table(df, F.col(label) == F.lit(positive_value), score, g)
    cum = running_totals(st, "s", ["pos", "neg"], partition_cols=g, descending=True)
    part = cum.select(*g, "pos", (F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("t"))
    agg = part.groupBy(*g).agg(F.sum("t").alias("t"), F.sum("pos").alias("P"))
    return agg.select(*g, F.when(F.col("P") > 0, F.col("t") / F.col("P")).alias("pr_auc"))


def roc_auc_ovr(probs: DataFrame, key: str, label: str = "label", cls: str = "class", prob: str = "prob") -> DataFrame:
    """V07 (one-vs-rest, macro): per-class AUC of ``prob`` for ``label == class``, averaged."""
    d = probs.select(cls, prob, (F.col(label).cast("string") == F.col(cls).cast("string")).cast("int").alias("_y"))
    per = roc_auc_binary(d, "_y", prob, 1, [cls])
    return per.agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def roc_auc_ovo(probs: DataFrame, key: str, label: str = "label", cls: str = "class", prob: str = "prob") -> DataFrame:
    """V07 (one-vs-one, macro): for every class pair (a, b), rows of either class, AUC of P(a)
    for a-vs-b and of P(b) for b-vs-a, averaged.

    No row is copied per pair: one running count of the rows of a over the scores P(a) says how many of them every other row
    lies below, and those sums go by the other row's label. The pairs that come out are those that have rows."""
    rows = probs.select(F.col(cls).cast("string").alias("a"), F.col(label).cast("string").alias("b"), F.col(prob).cast("double").alias("s"))
    rows = rows.where("b IS NOT NULL").groupBy("a", "s", "b").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("a") == F.col("b")
    at = rows.groupBy("a", "s").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("pos"),
                                    F.collect_list(F.when(~own, F.struct("b", "n"))).alias("others"))  # one entry per label
    cum = running_totals(at, "s", ["pos"], partition_cols=["a"], descending=True)
    above = F.col("cum_pos") - F.col("pos") + 0.5 * F.col("pos")
    per = cum.select("a", above.alias("above"), F.inline("others")).groupBy("a", "b").agg(
        F.sum(F.col("n") * F.col("above")).alias("num"), F.sum("n").alias("neg"))
    total = at.groupBy("a").agg(F.sum("pos").alias("own")).where("own > 0")
    per = per.join(total, "a").select("a", "b", (F.col("num") / (F.col("own") * F.col("neg"))).alias("roc_auc"))
    sym = per.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("z"), "roc_auc") \
        .groupBy("x", "z").agg(F.avg("roc_auc").alias("auc"))
    return sym.agg(F.avg("auc").alias("roc_auc_ovo"))


def pr_auc_macro(probs: DataFrame, key: str, label: str = "label", cls: str = "class", prob: str = "prob") -> DataFrame:
    """One-vs-rest average precision per class, averaged."""
    d = probs.select(cls, prob, (F.col(label).cast("string") == F.col(cls).cast("string")).cast("int").alias("_y"))
    per = average_precision(d, "_y", prob, 1, [cls])
    return per.agg(F.avg("pr_auc").alias("pr_auc_macro"))


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """V09–V11 in one pass; SST is the population variance times the count."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    d = df.select(y.alias("y"), p.alias("p"))
    yy, pp = F.col("y"), F.col("p")
    agg = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(yy - pp)).alias("mae"),
                F.sqrt(F.avg((yy - pp) * (yy - pp))).alias("rmse"),
                F.sum((yy - pp) * (yy - pp)).alias("sse"), (F.var_pop(yy) * F.count(yy)).alias("sst"),
                F.min(F.abs(yy)).alias("min_abs_y"),
                F.avg(F.abs((yy - pp) / F.when(yy != 0, yy))).alias("mape_raw"),
                F.avg(2.0 * F.abs(pp - yy) / F.when(F.abs(yy) + F.abs(pp) == 0, F.lit(SMAPE_FLOOR))
                      .otherwise(F.abs(yy) + F.abs(pp))).alias("smape_raw"))
    r2 = (F.when(F.col("n") < 2, F.lit(None))
          .when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("sse") / F.col("sst")))
    return agg.select("n", "mae", "rmse", r2.alias("r2"),
                      F.when((F.col("n") > 0) & (F.col("min_abs_y") > 0), F.col("mape_raw") * 100).alias("mape"),
                      (F.col("smape_raw") * 100).alias("smape"))


def mase(train: DataFrame, test: DataFrame, entity_cols, time_col: str, label: str = "y", pred: str = "prediction",
         period: int = 7) -> DataFrame:
    """Test MAE / mean |y_t − y_{t−period}| on the training series, per entity.

    NULL when the training series has ≤ period points or the scale is 0. Training rows
    look back within slices of their entity (no entity-wide window)."""
    from tabflow.functions.ordering import entity_positions, with_halo
    ent = list(entity_cols)
    t = entity_positions(train.select(*ent, time_col, label), ent, [time_col])
    w = W.partitionBy(*ent, "_slice").orderBy("pos")
    t = with_halo(t, ent, period).withColumn("_prev", F.lag(label, period).over(w)).where("NOT _halo")
    scale = t.groupBy(*ent).agg(F.count(F.lit(1)).alias("n_train"),
                                F.avg(F.abs(F.col(label) - F.col("_prev"))).alias("scale"))
    err = test.groupBy(*ent).agg(F.avg(F.abs(F.col(label) - F.col(pred))).alias("mae"))
    j = err.join(scale, ent, "left")
    return j.select(*ent, "mae", "scale", F.when((F.col("n_train") > period) & (F.col("scale") != 0),
                                                 F.col("mae") / F.col("scale")).alias("mase"))


def forecasting_metrics(train: DataFrame, pred: DataFrame, entity_cols, time_col: str, label: str = "y", prediction: str = "prediction",
                        period: int = 7) -> DataFrame:
    """``(mae, rmse, smape, mase)`` of a forecast over all series; mase is the mean over the series that have one."""
    errors = regression_metrics(pred.select(F.col(label).alias("label"), F.col(prediction).alias("prediction")))
    scaled = mase(train, pred, entity_cols, time_col, label, prediction, period).agg(F.avg("mase").alias("mase"))
    return (errors.withColumn("_k", F.lit(1)).join(scaled.withColumn("_k", F.lit(1)), "_k")  # one row each
            .select("mae", "rmse", "smape", "mase"))


def to_long(wide: DataFrame, metrics) -> DataFrame:
    """Wide metric row(s) → ``(metric, value)`` rows."""
    return wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                            for m in metrics])).alias("m")).select("m.metric", "m.value")


def normalised_score(results: DataFrame, metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Alias metric names and give every metric a higher-is-better ``score``."""
    alias = F.create_map(*[x for k, v in METRIC_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    name = F.coalesce(alias[F.col(metric_col)], F.col(metric_col))
    return results.withColumn(metric_col, name).withColumn(
        "score", F.when(F.col(metric_col).isin(*LOWER_IS_BETTER), -F.col(value_col)).otherwise(F.col(value_col)))


def residual_sample(df: DataFrame, time_col: str, label: str = "y", pred: str = "prediction", n: int = 200) -> DataFrame:
    """The last n rows by time with actual, predicted and residual (p − y) — a top-k (ties by the values)."""
    return (df.orderBy(F.col(time_col).desc(), F.col(label).desc(), F.col(pred).desc()).limit(n)
            .select(time_col, F.col(label).alias("actual"), F.col(pred).alias("predicted"),
                    (F.col(pred) - F.col(label)).alias("residual")))
