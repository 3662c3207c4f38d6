"""Model importances.

Permutation importance builds every ``(feature, repeat)`` copy of the scoring rows in one
plan: a keyed bijection of the row numbers says whose value a row takes in a repeat (an
equi-join on numbers), the copies are an ``explode`` over feature names, the fitted
model scores the union once, and a ``groupBy(feature, repeat)`` computes the score drop.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.functions.ordering import global_row_index

# Fixed values.
N_REPEATS = 5
TOP_K = 10


def native_importances(model, features, model_name: str, top_k: int = TOP_K) -> list[tuple]:
    """Tree importances or |coefficients| → ``(model, kind, feature, importance)`` rows, top k.
    (One value per feature: bounded by the feature count.)"""
    stage = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(stage, "featureImportances"):
        vals = stage.featureImportances.toArray().tolist()
    elif hasattr(stage, "coefficients"):
        vals = [abs(v) for v in stage.coefficients.toArray().tolist()]
    elif hasattr(stage, "coefficientMatrix"):
        m = stage.coefficientMatrix.toArray()
        vals = [float(abs(m[:, j]).mean()) for j in range(m.shape[1])]
    else:
        return []
    rows = sorted(zip(features, vals), key=lambda t: (-t[1], t[0]))[:top_k]
    return [(model_name, "native", f, float(v)) for f, v in rows]


WALKS = 64
FEISTEL_ROUNDS = 6


def shuffled_position(position, n: int, seed):
    """A keyed bijection of 0..n-1 as a column: a Feistel network over (x, y) with position = x·b + y, for a·b cells just above
    n, walked on until it is back below n. Fewer than a cells are outside, so few walks are ever needed (``WALKS`` always
    suffice for n up to 4096; beyond it the chance that a row needs more is below n**-30)."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def once(v):
        x, y = F.floor(v / b).cast("long"), F.pmod(v, F.lit(b))
        for k in range(0, FEISTEL_ROUNDS, 2):
            x = F.pmod(x + F.pmod(F.xxhash64(y, F.lit(k), seed), F.lit(a)), F.lit(a))
            y = F.pmod(y + F.pmod(F.xxhash64(x, F.lit(k + 1), seed), F.lit(b)), F.lit(b))
        return x * b + y

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.lit(n).cast("long"),
                       lambda acc, k: F.when((k > 1) & (acc < n), acc).otherwise(once(F.when(k == 1, position).otherwise(acc))))


def permutation_importance(model, df: DataFrame, features, label_col: str, key_cols, score_fn,
                           repeats: int = N_REPEATS, seed: int = 42) -> DataFrame:
    """Mean drop of ``score_fn`` (higher is better) when one feature is shuffled.

    Rows are numbered once in key order; in every repeat a row takes the value of the row that a keyed bijection of the
    numbers names (``shuffled_position``), so nothing is sorted per repeat and all repeats are one hash join. The rows per
    (feature, repeat) stream through the model into partial scores; they are never stored.

    ``model.transform`` must read the raw feature columns (e.g. a PipelineModel with its
    assembler). ``score_fn(pred_df, group_cols)`` returns ``group_cols + [score]``."""
    base = global_row_index(df.select(*dict.fromkeys([*key_cols, *features, label_col])), list(key_cols), "_idx")
    n = base.count()
    baseline = score_fn(model.transform(df), []).first()  # one number
    b = baseline["score"] if baseline is not None else None
    rows = base.select(*dict.fromkeys([*features, label_col]), "_idx", F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat"))
    rows = rows.withColumn("_src", shuffled_position(F.col("_idx"), n, F.col("repeat") + F.lit(seed)))
    donor = base.select(F.col("_idx").alias("_src"), *[F.col(f).alias(f"_d_{f}") for f in features])
    copies = rows.join(donor, "_src").select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    copies = copies.select(*[F.when(F.col("feature") == f, F.col(f"_d_{f}")).otherwise(F.col(f)).alias(f) for f in features],
                           label_col, "repeat", "feature")
    permuted = score_fn(model.transform(copies), ["feature", "repeat"])
    return (permuted.groupBy("feature").agg(F.avg(F.lit(b) - F.col("score")).alias("importance"),
                                            F.stddev_samp(F.lit(b) - F.col("score")).alias("importance_std"))
            .withColumn("kind", F.lit("permutation")))


def accuracy_score(pred: DataFrame, group_cols, label_col: str = "label_idx") -> DataFrame:
    return pred.groupBy(*group_cols).agg(F.avg((F.col(label_col) == F.col("prediction")).cast("double")).alias("score"))


def neg_rmse_score(pred: DataFrame, group_cols, label_col: str = "y") -> DataFrame:
    return pred.groupBy(*group_cols).agg((-F.sqrt(F.avg((F.col(label_col) - F.col("prediction")) ** 2))).alias("score"))


__all__ = ["native_importances", "permutation_importance", "accuracy_score", "neg_rmse_score", "vector_to_array"]
