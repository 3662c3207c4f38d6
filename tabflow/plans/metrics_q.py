"""Registered queries for metrics (V01–V15) over prediction tables derived from the data.

Binary: ``labels`` with a score mixing the true label and a hash (ties at 2 decimals).
Multiclass: ``orders.o_orderstatus`` with per-class hash scores boosted for the true class.
Regression: ``lineitem.l_extendedprice`` against a quantity-based estimate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.functions.exprs import hash_unit
from tabflow.operators import metrics as V
from tabflow.operators.split import split_chronological_entity
from tabflow.plans.common import DAILY_BY_PRIORITY, daily_orders_by_priority, sql_hash_unit
from tabflow.plans.registry import query, table

CLASSES = ["F", "O", "P"]


def binary_preds(spark, sf):
    lab = table(spark, sf, "labels")
    score = F.round(F.lit(0.3) * F.col("quality").cast("double") + F.lit(0.7) * hash_unit("doc_id", seed=7), 2)
    return lab.select("doc_id", F.col("quality").alias("label"), score.alias("score"),
                      (score >= 0.5).cast("int").alias("prediction"))


BIN = f"""(SELECT doc_id, quality AS label,
  round(0.3::DOUBLE * CAST(quality AS DOUBLE) + 0.7::DOUBLE * {sql_hash_unit('doc_id', seed=7)}, 2) AS score,
  CAST(round(0.3::DOUBLE * CAST(quality AS DOUBLE) + 0.7::DOUBLE * {sql_hash_unit('doc_id', seed=7)}, 2) >= 0.5
    AS INTEGER) AS prediction FROM labels)"""


def multi_long(spark, sf):
    """``(o_orderkey, label, class, prob)`` and ``(o_orderkey, label, prediction)``."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    raw = {c: hash_unit("o_orderkey", seed=i + 1) + F.when(F.col("label") == c, 0.5).otherwise(0.0)
           for i, c in enumerate(CLASSES)}
    tot = raw["F"] + raw["O"] + raw["P"]
    wide = o.select("o_orderkey", "label", *[F.round(raw[c] / tot, 3).alias(f"p_{c}") for c in CLASSES])
    long = wide.select("o_orderkey", "label", F.explode(F.array(*[F.struct(F.lit(c).alias("class"),
                                                                           F.col(f"p_{c}").alias("prob"))
                                                                  for c in CLASSES])).alias("e")) \
        .select("o_orderkey", "label", "e.class", "e.prob")
    best = F.max_by(F.col("class"), F.struct(F.col("prob"), -F.ascii("class")))
    preds = long.groupBy("o_orderkey", "label").agg(best.alias("prediction"))
    return long, preds


def _sql_raw(c, i):
    return f"({sql_hash_unit('o_orderkey', seed=i + 1)} + CASE WHEN o_orderstatus = '{c}' THEN 0.5 ELSE 0.0 END)"


MULTI_WIDE = ("(SELECT o_orderkey, o_orderstatus AS label, " + ", ".join(
    f"round({_sql_raw(c, i)} / ({' + '.join(_sql_raw(x, j) for j, x in enumerate(CLASSES))}), 3) AS p_{c}"
    for i, c in enumerate(CLASSES)) + " FROM orders)")
MULTI_LONG = "(" + " UNION ALL ".join(
    f"SELECT o_orderkey, label, '{c}' AS class, p_{c} AS prob FROM {MULTI_WIDE}" for c in CLASSES) + ")"
MULTI_PRED = f"""(SELECT o_orderkey, label, arg_max(class, (prob, -ascii(class))) AS prediction
  FROM {MULTI_LONG} GROUP BY 1, 2)"""


@query("m_accuracy", f"SELECT round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM {MULTI_PRED}")
def m_accuracy(spark, sf):
    _, preds = multi_long(spark, sf)
    return V.accuracy(preds).select(F.round("accuracy", 6).alias("accuracy"))


PER_CLASS_SQL = f"""WITH p AS {MULTI_PRED},
c AS (SELECT cls AS class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, CAST(sum(support) AS BIGINT) AS support FROM (
  SELECT label AS cls, CAST(label = prediction AS INTEGER) AS tp, 0 AS fp, CAST(label <> prediction AS INTEGER) AS fn,
    1 AS support FROM p
  UNION ALL SELECT prediction, 0, CAST(label <> prediction AS INTEGER), 0, 0 FROM p) GROUP BY 1),
m AS (SELECT class, support, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c)
SELECT class, support, precision, recall,
  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m"""


@query("m_per_class", f"""SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1 FROM ({PER_CLASS_SQL})""")
def m_per_class(spark, sf):
    _, preds = multi_long(spark, sf)
    p = V.per_class_prf(preds)
    return p.select("class", "support", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")])


@query("m_weighted_prf", f"""SELECT round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1
FROM ({PER_CLASS_SQL})""")
def m_weighted_prf(spark, sf):
    _, preds = multi_long(spark, sf)
    return V.weighted_prf(preds).select(*[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")])


@query("m_confusion", f"""WITH p AS {MULTI_PRED}, c AS (SELECT label AS x FROM p UNION SELECT prediction FROM p)
SELECT a.x AS actual, b.x AS predicted, coalesce(n.cnt, 0) AS count FROM c a CROSS JOIN c b
LEFT JOIN (SELECT label, prediction, count(*) AS cnt FROM p GROUP BY 1, 2) n ON n.label = a.x AND n.prediction = b.x""")
def m_confusion(spark, sf):
    _, preds = multi_long(spark, sf)
    return V.confusion_matrix(preds)


def _auc_sql(src, label="label", score="score", group=None):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
  sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS roc_auc FROM (
  SELECT *, sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM (
    SELECT {g}CAST({score} AS DOUBLE) AS s, sum(CAST({label} AS BIGINT)) AS pos,
      count(*) - sum(CAST({label} AS BIGINT)) AS neg FROM {src} GROUP BY {g}s)) {'GROUP BY ' + group if group else ''}"""


def _ap_sql(src, label="label", score="score", group=None):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    w = f"OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT {g}CASE WHEN sum(pos) > 0 THEN sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos) END AS pr_auc
FROM (SELECT *, sum(pos) {w} AS cum_pos, sum(neg) {w} AS cum_neg FROM (
  SELECT {g}CAST({score} AS DOUBLE) AS s, sum(CAST({label} AS BIGINT)) AS pos,
    count(*) - sum(CAST({label} AS BIGINT)) AS neg FROM {src} GROUP BY {g}s)) {'GROUP BY ' + group if group else ''}"""


@query("m_roc_auc", f"SELECT round(roc_auc, 6) AS roc_auc FROM ({_auc_sql(BIN)})")
def m_roc_auc(spark, sf):
    return V.roc_auc_binary(binary_preds(spark, sf), "label", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


@query("m_pr_auc", f"SELECT round(pr_auc, 6) AS pr_auc FROM ({_ap_sql(BIN)})")
def m_pr_auc(spark, sf):
    return V.average_precision(binary_preds(spark, sf), "label", "score").select(F.round("pr_auc", 6).alias("pr_auc"))


OVR_SRC = f"(SELECT class, prob, CAST(label = class AS INTEGER) AS y FROM {MULTI_LONG})"
OVO_SRC = f"""(SELECT a.a, a.b, l.prob, CAST(l.label = a.a AS INTEGER) AS y FROM {MULTI_LONG} l JOIN
  (SELECT x.c AS a, y.c AS b FROM (SELECT DISTINCT class AS c FROM {MULTI_LONG}) x,
   (SELECT DISTINCT class AS c FROM {MULTI_LONG}) y WHERE x.c <> y.c) a ON l.class = a.a AND l.label IN (a.a, a.b))"""


@query("m_roc_multiclass", f"""SELECT round((SELECT avg(roc_auc) FROM ({_auc_sql(OVR_SRC, 'y', 'prob', 'class')})), 6)
  AS roc_auc_ovr,
  round((SELECT avg(auc) FROM (SELECT least(a, b) AS x, greatest(a, b) AS z, avg(roc_auc) AS auc FROM
    ({_auc_sql(OVO_SRC.replace('a.a, a.b,', "a.a || '|' || a.b AS ab,"), 'y', 'prob', 'ab')}) t,
    LATERAL (SELECT split_part(ab, '|', 1) AS a, split_part(ab, '|', 2) AS b) GROUP BY 1, 2)), 6) AS roc_auc_ovo""")
def m_roc_multiclass(spark, sf):
    long, _ = multi_long(spark, sf)
    ovr = V.roc_auc_ovr(long, "o_orderkey")
    ovo = V.roc_auc_ovo(long, "o_orderkey")
    return (ovr.withColumn("_k", F.lit(1)).join(ovo.withColumn("_k", F.lit(1)), "_k")
            .select(F.round("roc_auc_ovr", 6).alias("roc_auc_ovr"), F.round("roc_auc_ovo", 6).alias("roc_auc_ovo")))


@query("m_pr_multiclass", f"""SELECT round(avg(pr_auc), 6) AS pr_auc_macro FROM ({_ap_sql(OVR_SRC, 'y', 'prob', 'class')})""")
def m_pr_multiclass(spark, sf):
    long, _ = multi_long(spark, sf)
    return V.pr_auc_macro(long, "o_orderkey").select(F.round("pr_auc_macro", 6).alias("pr_auc_macro"))


def reg_preds(spark, sf, label_col="l_extendedprice"):
    li = table(spark, sf, "lineitem")
    p = F.col("l_quantity") * F.lit(1500.0) + hash_unit("l_orderkey", "l_linenumber") * F.lit(5000.0)
    return li.select(F.col(label_col).alias("label"), p.alias("prediction"))


REG = f"""(SELECT l_extendedprice AS label,
  l_quantity * 1500.0::DOUBLE + {sql_hash_unit('l_orderkey', 'l_linenumber')} * 5000.0::DOUBLE AS prediction
  FROM lineitem)"""


def _reg_sql(src):
    return f"""SELECT count(*) AS n, round(avg(abs(label - prediction)), 4) AS mae,
  round(sqrt(avg((label - prediction) * (label - prediction))), 4) AS rmse,
  round(CASE WHEN count(*) < 2 THEN NULL
     WHEN sum((label - m) * (label - m)) = 0 THEN CASE WHEN sum((label - prediction) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
     ELSE 1 - sum((label - prediction) * (label - prediction)) / sum((label - m) * (label - m)) END, 6) AS r2,
  round(CASE WHEN count(*) > 0 AND min(abs(label)) > 0 THEN avg(abs((label - prediction) / label)) * 100 END, 6)
    AS mape,
  round(avg(2.0 * abs(prediction - label) / CASE WHEN abs(label) + abs(prediction) = 0 THEN 1e-9
    ELSE abs(label) + abs(prediction) END) * 100, 6) AS smape
FROM (SELECT *, avg(label) OVER () AS m FROM {src})"""


def _reg(df):
    m = V.regression_metrics(df)
    return m.select("n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"),
                    F.round("mape", 6).alias("mape"), F.round("smape", 6).alias("smape"))


@query("m_regression", f"SELECT n, mae, rmse, r2 FROM ({_reg_sql(REG)})")
def m_regression(spark, sf):
    return _reg(reg_preds(spark, sf)).select("n", "mae", "rmse", "r2")


@query("m_mape", f"""SELECT (SELECT mape FROM ({_reg_sql(REG)})) AS mape_price,
  (SELECT mape FROM ({_reg_sql(REG.replace('l_extendedprice AS label', 'l_discount AS label'))})) AS mape_discount""")
def m_mape(spark, sf):
    a = _reg(reg_preds(spark, sf)).select(F.col("mape").alias("mape_price"))
    b = _reg(reg_preds(spark, sf, "l_discount")).select(F.col("mape").alias("mape_discount"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("m_smape", f"SELECT smape FROM ({_reg_sql(REG)})")
def m_smape(spark, sf):
    return _reg(reg_preds(spark, sf)).select("smape")


FC_SPLIT = f"""(SELECT entity, ds, y, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY ds) - 1
  < floor(count(*) OVER (PARTITION BY entity) * 0.8) THEN 'train' ELSE 'test' END AS split FROM {DAILY_BY_PRIORITY})"""


def fc_split(spark, sf):
    return split_chronological_entity(daily_orders_by_priority(spark, sf), "entity", "ds")


@query("m_mase", f"""WITH s AS {FC_SPLIT},
tr AS (SELECT entity, ds, y, lag(y, 7) OVER (PARTITION BY entity ORDER BY ds) AS prev FROM s WHERE split = 'train'),
sc AS (SELECT entity, count(*) AS n_train, avg(abs(y - prev)) AS scale FROM tr GROUP BY 1),
last AS (SELECT entity, arg_max(y, ds) AS naive FROM s WHERE split = 'train' GROUP BY 1),
er AS (SELECT s.entity, avg(abs(s.y - last.naive)) AS mae FROM s JOIN last USING (entity) WHERE split = 'test'
       GROUP BY 1)
SELECT er.entity, round(mae, 4) AS mae, round(scale, 4) AS scale,
  round(CASE WHEN n_train > 7 AND scale <> 0 THEN mae / scale END, 6) AS mase FROM er LEFT JOIN sc USING (entity)""")
def m_mase(spark, sf):
    s = fc_split(spark, sf)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    naive = train.groupBy("entity").agg(F.max_by("y", "ds").alias("prediction"))
    out = V.mase(train, test.join(naive, "entity"), ["entity"], "ds", "y", "prediction")
    return out.select("entity", F.round("mae", 4).alias("mae"), F.round("scale", 4).alias("scale"),
                      F.round("mase", 6).alias("mase"))


@query("m_long_format", f"""SELECT metric, value FROM (SELECT n, mae, rmse, r2, mape, smape FROM ({_reg_sql(REG)}))
UNPIVOT INCLUDE NULLS (value FOR metric IN (mae, rmse, r2, mape, smape))""")
def m_long_format(spark, sf):
    return V.to_long(_reg(reg_preds(spark, sf)), ["mae", "rmse", "r2", "mape", "smape"])


@query("m_normalised_score", f"""SELECT metric, value, CASE WHEN metric IN ('rmse', 'mae', 'mape', 'smape', 'mase')
  THEN -value ELSE value END AS score FROM (
  SELECT CASE metric WHEN 'mean_absolute_error' THEN 'mae' WHEN 'root_mean_squared_error' THEN 'rmse'
    ELSE metric END AS metric, value FROM (
    SELECT CAST(mae AS DOUBLE) AS mean_absolute_error, CAST(rmse AS DOUBLE) AS root_mean_squared_error,
      CAST(r2 AS DOUBLE) AS r2 FROM ({_reg_sql(REG)}))
    UNPIVOT (value FOR metric IN (mean_absolute_error, root_mean_squared_error, r2)))""")
def m_normalised_score(spark, sf):
    w = _reg(reg_preds(spark, sf)).select(F.col("mae").alias("mean_absolute_error"),
                                          F.col("rmse").alias("root_mean_squared_error"), "r2")
    return V.normalised_score(V.to_long(w, ["mean_absolute_error", "root_mean_squared_error", "r2"]))


@query("residual_sample", f"""SELECT ds, actual, predicted, residual FROM (
  SELECT s.ds, s.y AS actual, l.naive AS predicted, l.naive - s.y AS residual FROM {FC_SPLIT} s
  JOIN (SELECT entity, arg_max(y, ds) AS naive FROM {FC_SPLIT} WHERE split = 'train' GROUP BY 1) l USING (entity)
  WHERE s.split = 'test') ORDER BY ds DESC, actual DESC, predicted DESC LIMIT 200""")
def residual_sample(spark, sf):
    s = fc_split(spark, sf)
    naive = s.where(F.col("split") == "train").groupBy("entity").agg(F.max_by("y", "ds").alias("prediction"))
    test = s.where(F.col("split") == "test").join(naive, "entity")
    return V.residual_sample(test, "ds", "y", "prediction", 200)
