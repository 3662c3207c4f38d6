"""Leakage-safe cleaning (C01–C17): ``TableCleaner.fit(train) -> TableCleanerModel``.

Every statistic is learned from the frame given to ``fit`` in three passes (one wide
null/parse-gate agg, one wide median/bound agg, one long ``(column, value)`` count for
modes and levels) and stored; ``transform`` is then a pure projection (plus one join
for high-cardinality label codes and a chunked window for time filling), so it applies
unchanged to train, test, new batches and streams.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import col_, is_numeric_type, parse_numeric_or_range
from tabflow.functions.ordering import SLICE_ROWS, entity_positions, global_row_index, join_on, order_slices, with_halo
from tabflow.functions.quantiles import quantile_table
from tabflow.operators.profile import _inline, value_counts

# Fixed values.
NUMERIC_TEXT_MIN_PARSE_RATIO = 0.8
MISSING_DROP_THRESHOLD = 0.7
UNKNOWN_THRESHOLD = 0.05
MAX_ONE_HOT_LEVELS = 15
UNKNOWN_LABEL = "Unknown"
BROADCAST_LEVELS_MAX = 1_000_000


# ----------------------------------------------------------------------------- building blocks

def drop_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact duplicate removal; returns the frame and a one-row count report."""
    out = df.dropDuplicates()
    report = (df.agg(F.count(F.lit(1)).alias("rows_before")).withColumn("_k", F.lit(1))
              .join(out.agg(F.count(F.lit(1)).alias("rows_after")).withColumn("_k", F.lit(1)), "_k").drop("_k")
              .withColumn("removed", F.col("rows_before") - F.col("rows_after")))
    return out, report


def fill_forward_backward(df: DataFrame, cols, order_cols, entity_cols=(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Forward fill then back fill along ``order_cols``, per entity.

    Rows are filled inside the slices of ``order_slices``, and values crossing a slice border come from a running
    last/first over the small per-slice summary, so a hot entity is spread over tasks."""
    entity_cols, cols = list(entity_cols), list(cols)
    d = order_slices(df, entity_cols, order_cols, slice_rows)
    part = entity_cols + ["_chunk"]
    w = W.partitionBy(*part).orderBy(*order_cols)
    before = w.rowsBetween(W.unboundedPreceding, 0)
    after = w.rowsBetween(0, W.unboundedFollowing)
    key = F.struct(*[col_(c) for c in order_cols])
    summ = d.groupBy(*part).agg(*[F.max_by(col_(c), F.when(col_(c).isNotNull(), key)).alias(f"_last_{c}") for c in cols],
                                *[F.min_by(col_(c), F.when(col_(c).isNotNull(), key)).alias(f"_first_{c}") for c in cols])
    ew = W.partitionBy(*entity_cols).orderBy("_chunk")
    for c in cols:
        summ = (summ.withColumn(f"_cf_{c}", F.last(f"_last_{c}", True).over(ew.rowsBetween(W.unboundedPreceding, -1)))
                .withColumn(f"_cb_{c}", F.first(f"_first_{c}", True).over(ew.rowsBetween(1, W.unboundedFollowing))))
    summ = summ.select(*part, *[f"_cf_{c}" for c in cols], *[f"_cb_{c}" for c in cols])
    for c in cols:
        d = (d.withColumn(f"_ff_{c}", F.last(col_(c), True).over(before))
             .withColumn(f"_bf_{c}", F.first(col_(c), True).over(after)))
    j = join_on(d, summ, part, "left")
    out = j.select(*[F.coalesce(col_(c), F.col(f"_ff_{c}"), F.col(f"_cf_{c}"), F.col(f"_bf_{c}"), F.col(f"_cb_{c}"))
                     .alias(c) if c in cols else col_(c) for c in df.columns])
    return out


def time_order_violations(df: DataFrame, time_col: str, input_order_col: str, entity_cols=(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """C17: rows whose time is earlier than the previous row's in input order (per entity)."""
    pos = entity_positions(df.select(*entity_cols, input_order_col, time_col), entity_cols, [input_order_col], slice_rows=slice_rows)
    w = W.partitionBy(*entity_cols, "_slice").orderBy("pos")
    return (with_halo(pos, entity_cols, 1, slice_rows=slice_rows).withColumn("_prev", F.lag(time_col).over(w)).where("NOT _halo")
            .agg(F.count(F.when(F.col("_prev") > F.col(time_col), 1)).alias("violations"),
                 F.count(F.lit(1)).alias("n_rows")))


def clip(c, lo, hi):
    return F.least(F.greatest(col_(c), F.lit(lo)), F.lit(hi))


# ----------------------------------------------------------------------------- estimator / model

@dataclass
class CleanerState:
    target: str | None = None
    time_col: str | None = None
    entity_col: str | None = None
    order_tiebreak: str | None = None
    text_cols: list = field(default_factory=list)
    converted: list = field(default_factory=list)
    dropped: dict = field(default_factory=dict)
    flag_cols: list = field(default_factory=list)
    numeric_cols: list = field(default_factory=list)
    categorical_cols: list = field(default_factory=list)
    numeric_fill: dict = field(default_factory=dict)
    categorical_fill: dict = field(default_factory=dict)
    bounds: dict = field(default_factory=dict)
    one_hot: dict = field(default_factory=dict)
    label_cols: dict = field(default_factory=dict)
    rows_fit: int = 0
    rows_dropped_missing_target: int = 0


class TableCleaner:
    """Learns fill values, bounds, dropped columns and encodings on the rows given to fit."""

    def __init__(self, target=None, time_col=None, entity_col=None, text_cols=(), order_tiebreak=None,
                 missing_threshold=MISSING_DROP_THRESHOLD, unknown_threshold=UNKNOWN_THRESHOLD,
                 cap_outliers=False, outlier_method="iqr", iqr_multiplier=1.5, zscore_threshold=3.0,
                 max_one_hot_levels=MAX_ONE_HOT_LEVELS, encode=True):
        self.target, self.time_col, self.entity_col = target, time_col, entity_col
        self.text_cols = list(text_cols)
        self.order_tiebreak = order_tiebreak
        self.missing_threshold, self.unknown_threshold = missing_threshold, unknown_threshold
        self.cap_outliers, self.outlier_method = cap_outliers, outlier_method
        self.iqr_multiplier, self.zscore_threshold = iqr_multiplier, zscore_threshold
        self.max_one_hot_levels, self.encode = max_one_hot_levels, encode

    def _excluded(self):
        return {c for c in (self.target, self.time_col, self.entity_col) if c}

    def fit(self, df: DataFrame) -> "TableCleanerModel":
        st = CleanerState(self.target, self.time_col, self.entity_col, self.order_tiebreak, list(self.text_cols))
        excluded = self._excluded()
        work = df
        if self.target and self.target in df.columns:
            work = work.where(F.col(self.target).isNotNull())
        for c in st.text_cols:
            work = work.withColumn(c, F.coalesce(col_(c), F.lit("")))
        strings = [f.name for f in work.schema.fields if isinstance(f.dataType, T.StringType)
                   and f.name not in excluded and f.name not in st.text_cols]
        # pass 1: row counts, null counts, numeric-text gate
        n = F.count(F.lit(1))
        structs = [F.struct(F.lit(c).alias("column"), n.alias("n"), F.count(col_(c)).alias("nonnull"),
                            (F.count(parse_numeric_or_range(c)) if c in strings else F.lit(None).cast("bigint"))
                            .alias("parsed")) for c in work.columns]
        stats = {r["column"]: r for r in _inline(work, structs).collect()}  # one row per column
        total = df.count() if self.target else None
        st.rows_fit = next(iter(stats.values()))["n"] if stats else 0
        st.rows_dropped_missing_target = (total - st.rows_fit) if total is not None else 0
        for c in strings:
            s = stats[c]
            if s["nonnull"] and s["parsed"] / s["nonnull"] >= NUMERIC_TEXT_MIN_PARSE_RATIO:
                st.converted.append(c)
        missing = {c: (stats[c]["n"] - (stats[c]["parsed"] if c in st.converted else stats[c]["nonnull"]))
                   for c in work.columns}
        for c in work.columns:
            if c in excluded or st.rows_fit == 0:
                continue
            frac = missing[c] / st.rows_fit
            if frac > self.missing_threshold:
                st.dropped[c] = round(frac, 4)
        work = work.select(*[parse_numeric_or_range(c).alias(c) if c in st.converted else col_(c)
                             for c in work.columns if c not in st.dropped])
        st.numeric_cols = [f.name for f in work.schema.fields if is_numeric_type(f.dataType) and f.name not in excluded]
        st.categorical_cols = [f.name for f in work.schema.fields if isinstance(f.dataType, T.StringType)
                               and f.name not in excluded and f.name not in st.text_cols]
        st.flag_cols = [c for c in st.numeric_cols + st.categorical_cols if missing[c] > 0]
        # pass 2: medians and outlier bounds
        need_median = [c for c in st.numeric_cols if missing[c] > 0 and not self.time_col]
        agg_structs = []
        for c in st.numeric_cols:
            x = col_(c).cast("double")
            fields = [F.lit(c).alias("column")]
            if self.cap_outliers:
                fields += [F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")]
            agg_structs.append(F.struct(*fields))
        if agg_structs and (need_median or self.cap_outliers):
            qcols = st.numeric_cols if self.cap_outliers else need_median
            qt = quantile_table(work, qcols, [0.25, 0.5, 0.75])  # exact; columns × 3 values
            for r in _inline(work, agg_structs).collect():  # one row per numeric column
                c = r["column"]
                r = dict(r.asDict(), median=qt.get((c, 0.5)), q=[qt.get((c, 0.25)), qt.get((c, 0.75))]
                         if (c, 0.25) in qt else None)
                if missing[c] > 0:
                    st.numeric_fill[c] = "ffill_bfill" if self.time_col else r["median"]
                if self.cap_outliers:
                    if self.outlier_method == "zscore":
                        if r["std"]:
                            k = self.zscore_threshold
                            st.bounds[c] = [r["mean"] - k * r["std"], r["mean"] + k * r["std"]]
                    elif r["q"] is not None:
                        q1, q3 = r["q"]
                        if q3 != q1:
                            st.bounds[c] = [q1 - self.iqr_multiplier * (q3 - q1), q3 + self.iqr_multiplier * (q3 - q1)]
        elif self.time_col:
            st.numeric_fill = {c: "ffill_bfill" for c in st.numeric_cols if missing[c] > 0}
        # pass 3: modes and levels from the long (column, value) counts
        level_df = None
        if st.categorical_cols:
            vc = value_counts(work, st.categorical_cols).cache()
            summary = vc.groupBy("column").agg(
                F.count(F.lit(1)).alias("n_levels"),
                F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode")).collect()
            summary = {r["column"]: r for r in summary}  # one row per categorical column
            for c in st.categorical_cols:
                frac = missing[c] / st.rows_fit if st.rows_fit else 0.0
                if frac > 0:
                    mode = summary[c]["mode"] if c in summary else None
                    st.categorical_fill[c] = UNKNOWN_LABEL if frac > self.unknown_threshold else (mode or "missing")
            if self.encode:
                fills = [(c, v) for c, v in st.categorical_fill.items()]
                levels = vc.select("column", "value")
                if fills:
                    levels = levels.unionByName(work.sparkSession.createDataFrame(fills, "column string, value string"))
                levels = levels.distinct()
                n_levels = {r["column"]: r["n"] for r in
                            levels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
                small = [c for c in st.categorical_cols if n_levels.get(c, 0) <= self.max_one_hot_levels]
                if small:
                    rows = levels.where(F.col("column").isin(small)).collect()  # ≤15 levels per column
                    for c in small:
                        st.one_hot[c] = sorted(r["value"] for r in rows if r["column"] == c)
                big = [c for c in st.categorical_cols if c not in small]
                if big:
                    # Codes are places in the order of (column, value), counted from the column's first level:
                    # a column with many levels is ranked by many tasks.
                    placed = global_row_index(levels.where(F.col("column").isin(big)), ["column", "value"], "_place")
                    start = placed.groupBy("column").agg(F.min("_place").alias("_start"))
                    level_df = placed.join(start, "column").select(
                        "column", "value", (F.col("_place") - F.col("_start")).cast("int").alias("code"))
                    st.label_cols = {c: n_levels[c] for c in big}
            vc.unpersist()
        return TableCleanerModel(st, level_df)


class TableCleanerModel:
    """Applies stored cleaning state; never recomputes statistics from its input."""

    def __init__(self, state: CleanerState, levels: DataFrame | None = None):
        self.state, self.levels = state, levels

    @property
    def needs_history(self) -> bool:
        return any(v == "ffill_bfill" for v in self.state.numeric_fill.values())

    def transform(self, df: DataFrame) -> DataFrame:
        st = self.state
        out = df
        if st.target and st.target in out.columns:
            out = out.where(F.col(st.target).isNotNull())
        for c in st.text_cols:
            if c in out.columns:
                out = out.withColumn(c, F.coalesce(col_(c), F.lit("")))
        out = out.select(*[parse_numeric_or_range(c).alias(c) if c in st.converted else col_(c)
                           for c in out.columns if c not in st.dropped])
        out = out.select("*", *[col_(c).isNull().cast("int").alias(f"{c}_was_missing")
                                for c in st.flag_cols if c in out.columns])
        ff = [c for c, v in st.numeric_fill.items() if v == "ffill_bfill" and c in out.columns]
        if ff:
            order = [st.time_col] + ([st.order_tiebreak] if st.order_tiebreak else [])
            ent = [st.entity_col] if st.entity_col else []
            out = fill_forward_backward(out, ff, order, ent)
        fills = {c: v for c, v in st.numeric_fill.items() if v != "ffill_bfill" and c in out.columns}
        fills.update({c: v for c, v in st.categorical_fill.items() if c in out.columns})
        # A fractional median would be cut by the column's integer type: those columns become double.
        wide = [f.name for f in out.schema.fields if isinstance(fills.get(f.name), float) and not fills[f.name].is_integer()
                and isinstance(f.dataType, T.IntegralType)]
        out = out.select(*[col_(c).cast("double").alias(c) if c in wide else col_(c) for c in out.columns])
        types = dict(out.dtypes)
        out = out.select(*[F.coalesce(col_(c), F.lit(fills[c]).cast(types[c])).alias(c) if fills.get(c) is not None else col_(c) for c in out.columns])
        for c, (lo, hi) in st.bounds.items():
            if c in out.columns:
                out = out.withColumn(c, clip(c, lo, hi))
        for c, levels in st.one_hot.items():
            if c in out.columns:
                dummies = [F.coalesce((col_(c) == F.lit(lv)).cast("int"), F.lit(0)).alias(f"{c}_{lv}") for lv in levels[1:]]
                out = out.select(*[F.col(f"`{x}`") for x in out.columns if x != c], *dummies)
        for c, n_levels in st.label_cols.items():
            if c in out.columns and self.levels is not None:
                lv = self.levels.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias("_code"))
                if n_levels <= BROADCAST_LEVELS_MAX:  # size known from fit
                    lv = F.broadcast(lv)
                out = (join_on(out, lv, [c], "left")
                       .withColumn(c, F.coalesce(F.col("_code"), F.lit(-1))).drop("_code"))
        return out

    # Persistence ------------------------------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self.state)),)], "state string").coalesce(1) \
            .write.mode("overwrite").json(path.rstrip("/") + "/state")
        if self.levels is not None:
            self.levels.write.mode("overwrite").parquet(path.rstrip("/") + "/levels")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TableCleanerModel":
        row = spark.read.schema("state string").json(path.rstrip("/") + "/state").first()
        state = CleanerState(**json.loads(row["state"]))
        levels = None
        if state.label_cols:
            levels = spark.read.parquet(path.rstrip("/") + "/levels")
        return TableCleanerModel(state, levels)

    def report(self) -> dict:
        st = self.state
        return {"rows_dropped_missing_target": st.rows_dropped_missing_target,
                "dropped_columns_high_missingness": st.dropped,
                "missingness_flags_added": [f"{c}_was_missing" for c in st.flag_cols],
                "numeric_text_converted": st.converted,
                "imputation": {**{c: v for c, v in st.numeric_fill.items()}, **st.categorical_fill},
                "outlier_bounds": st.bounds,
                "encoded_columns": list(st.one_hot) + [f"{c} (label codes)" for c in st.label_cols]}


def numeric_text_gate(df: DataFrame, cols, min_ratio: float = NUMERIC_TEXT_MIN_PARSE_RATIO) -> DataFrame:
    """``(column, n_nonnull, n_parsed, parse_ratio, converted)`` for string columns."""
    structs = [F.struct(F.lit(c).alias("column"), F.count(col_(c)).alias("n_nonnull"),
                        F.count(parse_numeric_or_range(c)).alias("n_parsed")) for c in cols]
    ratio = F.try_divide(F.col("n_parsed"), F.col("n_nonnull"))
    return _inline(df, structs).select("*", F.round(ratio, 4).alias("parse_ratio"),
                                       F.coalesce(ratio >= min_ratio, F.lit(False)).alias("converted"))
