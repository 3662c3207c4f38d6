"""Feature selection and engineering, entity scope.

Lags and rolling means are computed from per-entity *positions* (``entity_positions``)
with equi-joins on ``(entity, position)``, never with a window partitioned by entity
alone, so one huge entity is still spread over every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import col_, is_numeric_type
from tabflow.functions.ordering import entity_positions, with_halo
from tabflow.operators.profile import _inline

# Fixed values.
DROP_REASON_ORDER = ("constant_column", "near_constant_column", "id_like_column", "possible_leakage")


def entity_filter(df: DataFrame, entity_col: str, value) -> DataFrame:
    """keep one entity (compared as text) and drop the entity column.

    When the literal converts to the column's own type the comparison is typed, so the
    predicate reaches the Parquet scan as a pushed filter."""
    dt = df.schema[entity_col].dataType
    try:
        typed = F.lit(value).cast(dt)
        cond = F.col(entity_col) == typed if str(value) == str(_py_cast(value, dt)) else None
    except Exception:  # noqa: BLE001
        cond = None
    if cond is None:
        cond = F.col(entity_col).cast("string") == F.lit(str(value))
    out = df.where(cond).drop(entity_col)
    return out


def _py_cast(value, dt):
    if is_numeric_type(dt):
        return int(value) if dt.typeName() in ("integer", "long", "short", "byte") else float(value)
    return value


def date_parts(df: DataFrame, time_col: str) -> DataFrame:
    """weekday (Mon=0), month and day of month."""
    t = F.col(time_col)
    return df.select("*", F.weekday(t).alias(f"{time_col}_dayofweek"), F.month(t).alias(f"{time_col}_month"),
                     F.dayofmonth(t).alias(f"{time_col}_day"))


def lag_rolling_features(df: DataFrame, target: str, time_col: str, entity_col: str | None = None,
                         lags=(1, 7), windows=(7,), tiebreak: str | None = None) -> DataFrame:
    """``<y>_lag_<k>`` and ``<y>_rolling_mean_<w>`` (mean of the previous w values,
    null until w previous values exist), per entity, in time order.

    Real windows over slices of an entity, each with the rows it needs from the slice before it: one shuffle for
    all lags and windows, and no difference of running sums that a large value could spoil. Rows with a NULL entity
    are one entity, rows with a NULL time come first in theirs."""
    ent = [entity_col] if entity_col else []
    order = [time_col] + ([tiebreak] if tiebreak else [])
    pos = entity_positions(df, ent, order)
    back = max([0, *lags, *windows])
    cut = with_halo(pos, ent, back)
    by = W.partitionBy(*ent, "_slice").orderBy("pos")
    out = cut.select("*", *[F.lag(target, k).over(by).alias(f"{target}_lag_{k}") for k in lags],
                     *[F.when((F.col("pos") >= w) & (F.count(target).over(by.rowsBetween(-w, -1)) == w),
                              F.avg(col_(target).cast("double")).over(by.rowsBetween(-w, -1))).alias(f"{target}_rolling_mean_{w}")
                       for w in windows])
    return out.where("NOT _halo").drop("pos", "_slice", "_halo")


def dropna_rows(df: DataFrame) -> DataFrame:
    """drop rows holding any NULL."""
    return df.dropna("any")


class PopulationScaler:
    """(x − mean) / std with population std fitted on the given rows; std 0 → divide by 1."""

    def __init__(self, cols):
        self.cols = list(cols)
        self.stats: dict = {}

    def fit(self, df: DataFrame) -> "PopulationScaler":
        structs = [F.struct(F.lit(c).alias("column"), F.avg(col_(c).cast("double")).alias("mean"),
                            F.stddev_pop(col_(c).cast("double")).alias("std")) for c in self.cols]
        self.stats = {r["column"]: (r["mean"], r["std"]) for r in _inline(df, structs).collect()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = []
        for c in df.columns:
            if c in self.stats:
                mean, std = self.stats[c]
                exprs.append(((col_(c).cast("double") - F.lit(mean)) / F.lit(std if std else 1.0)).alias(c))
            else:
                exprs.append(col_(c))
        return df.select(*exprs)


def feature_frame(df: DataFrame, target: str | None = None, time_col: str | None = None,
                  entity_col: str | None = None, drop_entity: bool = False) -> tuple[DataFrame, list[str]]:
    """numeric columns except target/time (and entity when pooled), NULL → 0."""
    skip = {c for c in (target, time_col) if c}
    if drop_entity and entity_col:
        skip.add(entity_col)
    cols = [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in skip]
    return df.select(*[F.coalesce(col_(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]), cols


def assemble(df: DataFrame, cols, out_col: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out_col, handleInvalid="keep").transform(df)


def selection_log(profile: DataFrame, issues: DataFrame, requested, keep_always=()) -> DataFrame:
    """every column with kept flag and, when dropped, the first reason by priority."""
    pr = F.create_map(*[x for i, t in enumerate(DROP_REASON_ORDER) for x in (F.lit(t), F.lit(i))])
    reasons = (issues.where(F.col("column").isNotNull() & F.col("issue_type").isin(*DROP_REASON_ORDER))
               .select("column", "issue_type", pr[F.col("issue_type")].alias("prio"))
               .groupBy("column").agg(F.min_by("issue_type", "prio").alias("first_reason")))
    keep = set(requested) | {c for c in keep_always if c}
    kept = F.col("column").isin(*keep) if keep else F.lit(False)
    return (profile.select("column", "position").join(reasons, "column", "left")
            .select("column", kept.alias("kept"),
                    F.when(kept, F.lit(None)).otherwise(F.coalesce("first_reason", F.lit("not selected")))
                    .cast("string").alias("reason")))


def default_features(profile: DataFrame, issues: DataFrame, target: str | None = None) -> DataFrame:
    """all columns minus target, id-like, leakage, constant and near-constant ones."""
    flagged = issues.where(F.col("issue_type").isin(*DROP_REASON_ORDER))
    bad = flagged.select("column").unionByName(flagged.select(F.col("other_column").alias("column"))) \
        .where(F.col("column").isNotNull())
    out = profile.select("column").join(bad, "column", "left_anti")
    if target:
        out = out.where(F.col("column") != target)
    return out
