"""Set-based forecasters and per-entity scope.

Series are ``(entity, time, y)``; positions inside each entity come from
``entity_positions`` (sliced, so a hot entity is not one task), and every forecaster
is a handful of aggregates per entity joined back to the test rows: last value,
last season, AR(1) coefficients on differences, least-squares lines. Holt's linear
smoothing is a linear recurrence; it is a scan of affine maps (``holt``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import col_
from tabflow.functions.ordering import entity_positions, join_on, with_halo
from tabflow.session import ensure_checkpoint_dir

# Fixed values.
SEASON = 7
MIN_ROWS_PER_ENTITY = 10
MIN_TRAIN_ROWS, MIN_TEST_ROWS = 5, 1
HOLT_ALPHAS = (0.2, 0.5, 0.8)
HOLT_BETAS = (0.1, 0.3)
#: Steps of a slice at least, and the size below which a slice's matrix passes nothing on.
HOLT_SLICE = 4096
HOLT_FADED = 1e-40


def ordered_series(df: DataFrame, entity: str, time_col: str, y: str) -> DataFrame:
    """``(entity, time, y double, pos)`` with 0-based positions per entity in time order (ties by value)."""
    d = df.select(entity, time_col, F.col(y).cast("double").alias("y"))
    return entity_positions(d, [entity], [time_col, "y"])


def _test_steps(test: DataFrame, entity: str, time_col: str) -> DataFrame:
    """Test rows with ``h`` = 1-based step after the end of the training series."""
    return entity_positions(test, [entity], [time_col], pos_col="h0") \
        .withColumn("h", F.col("h0") + 1).drop("h0")


def naive(train: DataFrame, test: DataFrame, entity: str, time_col: str, y: str = "y") -> DataFrame:
    """The last training value for the whole horizon (of equal times the largest value)."""
    last = train.groupBy(entity).agg(F.max_by(y, F.struct(time_col, y)).alias("prediction"))
    return join_on(test, last, [entity], "left")


def seasonal_naive(train: DataFrame, test: DataFrame, entity: str, time_col: str, y: str = "y",
                   season: int = SEASON) -> DataFrame:
    """The last ``season`` training values repeated (fewer if the series is shorter)."""
    tr = ordered_series(train, entity, time_col, y)
    n = tr.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    m = F.least(F.lit(season), F.col("_n"))
    tail = (join_on(tr, n, [entity]).where(F.col("pos") >= F.col("_n") - m)
            .select(entity, (F.col("pos") - (F.col("_n") - m)).alias("_phase"), F.col("y").alias("prediction")))
    steps = join_on(_test_steps(test, entity, time_col), n, [entity], "left")
    steps = steps.withColumn("_phase", F.pmod(F.col("h") - 1, F.least(F.lit(season), F.col("_n"))))
    return join_on(steps, tail, [entity, "_phase"], "left").drop("_phase", "_n")


def _ar1(tr: DataFrame, entity: str, lag: int) -> DataFrame:
    """φ = Σ d_t d_{t−1} / Σ d_{t−1}² for d_t = y_t − y_{t−lag}, plus the last d and y per entity; one window over slices."""
    w = W.partitionBy(entity, "_slice").orderBy("pos")
    d = with_halo(tr.select(entity, "pos", "y"), [entity], lag + 1).select(
        entity, "pos", "y", "_halo", (F.col("y") - F.lag("y", lag).over(w)).alias("d"),
        (F.lag("y", 1).over(w) - F.lag("y", lag + 1).over(w)).alias("d_prev")).where("NOT _halo")
    return d.groupBy(entity).agg(
        F.try_divide(F.sum(F.col("d") * F.col("d_prev")), F.sum(F.col("d_prev") * F.col("d_prev"))).alias("phi"),
        F.max_by("d", "pos").alias("d_last"), F.max_by("y", "pos").alias("y_last"))


def ar_on_differences(train: DataFrame, test: DataFrame, entity: str, time_col: str, y: str = "y") -> DataFrame:
    """AR(1) on first differences; ŷ_{n+h} = y_n + d_n·Σ_{k=1..h} φ^k (closed form)."""
    tr = ordered_series(train, entity, time_col, y)
    coef = _ar1(tr, entity, 1)
    steps = join_on(_test_steps(test, entity, time_col), coef, [entity], "left")
    phi, h = F.coalesce(F.col("phi"), F.lit(0.0)), F.col("h").cast("double")
    geo = F.when(F.abs(phi - 1) < 1e-12, h).otherwise(phi * (1 - F.pow(phi, h)) / (1 - phi))
    return steps.withColumn("prediction", F.col("y_last") + F.coalesce(F.col("d_last"), F.lit(0.0)) * geo) \
        .drop("phi", "d_last", "y_last")


def seasonal_ar(train: DataFrame, test: DataFrame, entity: str, time_col: str, y: str = "y",
                season: int = SEASON) -> DataFrame:
    """Seasonal naive plus an AR(1) on seasonal differences: ŷ = naive_s(h) + φ^h·D_n."""
    tr = ordered_series(train, entity, time_col, y)
    coef = _ar1(tr, entity, season)
    base = seasonal_naive(train, test, entity, time_col, y, season)
    j = join_on(base, coef, [entity], "left")
    adj = F.coalesce(F.pow(F.col("phi"), F.col("h").cast("double")) * F.col("d_last"), F.lit(0.0))
    return j.withColumn("prediction", F.col("prediction") + adj).drop("phi", "d_last", "y_last")


def linear_trend(train: DataFrame, test: DataFrame, entity: str, time_col: str, y: str = "y") -> DataFrame:
    """Least-squares line of y on position per entity (``regr_slope``/``regr_intercept``)."""
    tr = ordered_series(train, entity, time_col, y)
    coef = tr.groupBy(entity).agg(F.regr_slope("y", "pos").alias("_b"), F.regr_intercept("y", "pos").alias("_a"),
                                  F.count(F.lit(1)).alias("_n"))
    steps = join_on(_test_steps(test, entity, time_col), coef, [entity], "left")
    x = F.col("_n") - 1 + F.col("h")
    return steps.withColumn("prediction", F.col("_a") + F.coalesce(F.col("_b"), F.lit(0.0)) * x) \
        .drop("_a", "_b", "_n")


# ----------------------------------------------------------------------------- Holt (scan of affine maps)

def _holt_step(l, b, y, alpha: float, beta: float):
    """Level and trend after ``y``."""
    up = alpha * y + (1 - alpha) * (l + b)
    return up, beta * (up - l) + (1 - beta) * b


def _holt_matrix(alpha: float, beta: float) -> np.ndarray:
    """The linear part of a step: the state after ``y`` is this matrix times the state before, plus (α, αβ)·y."""
    return np.array([[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]])


def holt(train: DataFrame, test: DataFrame, entity: str, time_col: str, y: str = "y",
         alphas=HOLT_ALPHAS, betas=HOLT_BETAS, slice_rows: int | None = None) -> DataFrame:
    """Additive-trend exponential smoothing with (α, β) picked per series from a grid by
    in-sample one-step squared error; forecast l_n + h·b_n.

    A step is an affine map of the state (level, trend), and so is a slice of ``slice_rows`` steps: a matrix power known
    beforehand and the state it reaches from zero. Slices fold their values once from zero; a prefix over the slice ends
    (doubling: slice s takes the state of slice s − 2^j through the matrix power of 2^j slices; powers that have faded to
    nothing are left out) gives the true state before every slice; a second fold from there adds up the errors. All
    grid points go together in JVM folds over sorted arrays; a row is shuffled and written once, as part of its slice.

    Training rows without a value are left out of their series; a series of one value forecasts it; columns may have any
    name; NULL is an entity of its own."""
    plain = test.toDF(*[f"_t{i}" for i in range(len(test.columns))])
    ent, when = (f"_t{test.columns.index(c)}" for c in (entity, time_col))
    known = train.where(col_(y).isNotNull()).select(col_(entity).alias(ent), col_(time_col).alias(when), col_(y).alias("_y"))
    out = _holt(known, plain, ent, when, "_y", [(float(a), float(b)) for a in alphas for b in betas], slice_rows)
    return out.toDF(*[test.columns[int(c[2:])] if c.startswith("_t") else c for c in out.columns])


def _holt(train: DataFrame, test: DataFrame, entity: str, time_col: str, y: str, grid, slice_rows: int | None) -> DataFrame:
    ensure_checkpoint_dir(train.sparkSession)
    tr = ordered_series(train, entity, time_col, y)
    if slice_rows is None:  # as many slices as rows in one, where a series is long enough
        longest = tr.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        slice_rows = max(HOLT_SLICE, math.isqrt(longest) + 1)
    points = F.struct("pos", "y")
    slices = tr.groupBy(entity, F.floor((F.col("pos") - 1) / slice_rows).alias("s")).agg(
        F.transform(F.sort_array(F.collect_list(points)), lambda x: x["y"]).alias("ys")).checkpoint(eager=True)
    # Slice −1 is the first value alone: the state before slice 0 is that value and the first difference.
    first = slices.where("s = -1").select(entity, F.col("ys")[0].alias("y0"))
    start = join_on(first, slices.where("s = 0").select(entity, F.col("ys")[0].alias("y1")), [entity], "left")
    steps = slices.where("s >= 0")
    k = range(len(grid))
    zero = F.struct(*[F.lit(0.0).alias(f"{x}{g}") for g in k for x in "lb"])

    def fold(acc, v):
        return F.struct(*[e.alias(f"{x}{g}") for g, (a, b) in enumerate(grid)
                          for x, e in zip("lb", _holt_step(acc[f"l{g}"], acc[f"b{g}"], v, a, b))])

    ends = steps.select(entity, "s", F.aggregate("ys", zero, fold).alias("e")).select(entity, "s", *[F.col(f"e.{x}{g}") for g in k for x in "lb"])
    begin = start.select(entity, F.lit(-1).cast("bigint").alias("s"),
                         *[(F.col("y0") if x == "l" else F.coalesce(F.col("y1") - F.col("y0"), F.lit(0.0))).alias(f"{x}{g}") for g in k for x in "lb"])
    state = ends.union(begin).checkpoint(eager=True)
    last = state.agg(F.max("s")).first()[0]
    power, reach = [np.linalg.matrix_power(_holt_matrix(a, b), slice_rows) for a, b in grid], 1
    while last is not None and reach <= last + 1 and max(abs(m).max() for m in power) > HOLT_FADED:
        before = state.select(entity, (F.col("s") + reach).alias("s"), *[F.col(f"{x}{g}").alias(f"p{x}{g}") for g in k for x in "lb"])
        j = join_on(state, before, [entity, "s"], "left")
        state = j.select(entity, "s", *[
            (F.col(f"{x}{g}") + F.coalesce(F.col(f"pl{g}") * float(power[g][i, 0]) + F.col(f"pb{g}") * float(power[g][i, 1]), F.lit(0.0))).alias(f"{x}{g}")
            for g in k for i, x in enumerate("lb")]).checkpoint(eager=True)
        power, reach = [m @ m for m in power], reach * 2

    before = state.select(entity, (F.col("s") + 1).alias("s"), F.struct(
        *[(F.lit(0.0) if x == "q" else F.col(f"{x}{g}")).alias(f"{x}{g}") for g in k for x in "lbq"]).alias("c"))

    def scored(acc, v):
        out = []
        for g, (a, b) in enumerate(grid):
            l, t = acc[f"l{g}"], acc[f"b{g}"]
            off = v - (l + t)
            out += [e.alias(f"{x}{g}") for x, e in zip("lbq", (*_holt_step(l, t, v, a, b), acc[f"q{g}"] + off * off))]
        return F.struct(*out)

    done = join_on(steps, before, [entity, "s"]).select(entity, "s", F.aggregate("ys", F.col("c"), scored).alias("c"))
    totals = done.groupBy(entity).agg(*[F.sum(f"c.q{g}").alias(f"q{g}") for g in k], F.max_by("c", "s").alias("c"))
    best = F.array_min(F.array(*[F.struct(F.col(f"q{g}").alias("sse"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"),
                                          F.col(f"c.l{g}").alias("l"), F.col(f"c.b{g}").alias("b")) for g, (a, b) in enumerate(grid)]))
    final = join_on(first, totals.select(entity, best.alias("_p")), [entity], "left")
    final = final.select(entity, F.coalesce("_p.l", "y0").alias("_l"), F.coalesce("_p.b", F.lit(0.0)).alias("_b"))
    out = join_on(_test_steps(test, entity, time_col), final, [entity], "left")
    return out.withColumn("prediction", F.col("_l") + F.col("h") * F.col("_b")).drop("_l", "_b")


# ----------------------------------------------------------------------------- per-entity scope

def entity_eligibility(df: DataFrame, entity: str, time_col: str, train_frac: float = 0.8,
                       max_entities: int | None = None) -> DataFrame:
    """Per entity: rows, train/test sizes and whether it is modelled, with the skip reason."""
    n = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"))
    n_train = F.floor(F.col("n_rows") * train_frac)
    out = n.select(entity, "n_rows", n_train.alias("n_train"), (F.col("n_rows") - n_train).alias("n_test"))
    reason = (F.when(F.col("n_rows") < MIN_ROWS_PER_ENTITY, "too_few_rows")
              .when(F.col("n_train") < MIN_TRAIN_ROWS, "too_few_train_rows")
              .when(F.col("n_test") < MIN_TEST_ROWS, "too_few_test_rows"))
    out = out.withColumn("skip_reason", reason)
    if max_entities:
        # The largest max_entities entities: a bounded top-N (no single-task window over all entities).
        top = out.orderBy(F.desc("n_rows"), F.asc(entity)).limit(max_entities).select(entity, F.lit(True).alias("_top"))
        out = join_on(out, F.broadcast(top), [entity], "left").withColumn(
            "skip_reason", F.when(F.col("skip_reason").isNull() & F.col("_top").isNull(), "entity_cap")
            .otherwise(F.col("skip_reason"))).drop("_top")
    return out.withColumn("eligible", F.col("skip_reason").isNull())


def per_entity_linear_fit(df: DataFrame, entity: str, x: str, y: str, split_col: str = "split") -> DataFrame:
    """One least-squares line per entity on its train rows, scored on its test rows."""
    tr = df.where(F.col(split_col) == "train")
    coef = tr.groupBy(entity).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    te = join_on(df.where(F.col(split_col) == "test"), coef, [entity], "left")  # entities without train rows keep a row
    pred = F.col("intercept") + F.col("slope") * F.col(x)
    return te.groupBy(entity, "slope", "intercept").agg(
        F.sqrt(F.avg((F.col(y) - pred) ** 2)).alias("rmse"), F.count(F.lit(1)).alias("n_test"))


def grouped_least_squares(df: DataFrame, group_cols, features, y: str, collinear: float = 1e-10) -> DataFrame:
    """Least squares of ``y`` on ``features`` per group: (group.., n, intercept, beta array), one pass.

    The normal equations are grouped covariances (merged on the map side, so a hot group costs one row a task); they are
    solved in the plan, one elimination step per projection. Rows with a NULL in y or a feature are left out. A feature
    that adds nothing to those before it (its pivot is below ``collinear`` of its variance) has the coefficient 0."""
    p = len(features)
    x = [col_(c).cast("double") for c in features]
    rows = df.select(*[col_(c).alias(f"g{i}") for i, c in enumerate(group_cols)], *[c.alias(f"x{i}") for i, c in enumerate(x)],
                     col_(y).cast("double").alias("y")).dropna(subset=[*(f"x{i}" for i in range(p)), "y"])
    groups = [f"g{i}" for i in range(len(group_cols))]
    t = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)],
                                  *[F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)],
                                  *[F.covar_pop(f"x{i}", "y").alias(f"c{i}") for i in range(p)])
    t = t.select("*", *[F.col(f"s{i}_{i}").alias(f"v{i}") for i in range(p)])
    for k in range(p):  # eliminate feature k from the ones after it
        sound = F.col(f"s{k}_{k}") > F.col(f"v{k}") * collinear
        ratio = {i: F.when(sound, F.col(f"s{k}_{i}") / F.col(f"s{k}_{k}")).otherwise(0.0) for i in range(k + 1, p)}
        new = {f"s{i}_{j}": F.col(f"s{i}_{j}") - ratio[i] * F.col(f"s{k}_{j}") for i in range(k + 1, p) for j in range(i, p)}
        new.update({f"c{i}": F.col(f"c{i}") - ratio[i] * F.col(f"c{k}") for i in range(k + 1, p)})
        t = t.select(*[new[c].alias(c) if c in new else F.col(c) for c in t.columns])
    for k in reversed(range(p)):
        rest = F.col(f"c{k}")
        for j in range(k + 1, p):
            rest = rest - F.col(f"s{k}_{j}") * F.col(f"b{j}")
        t = t.select("*", F.when(F.col(f"s{k}_{k}") > F.col(f"v{k}") * collinear, rest / F.col(f"s{k}_{k}")).otherwise(0.0).alias(f"b{k}"))
    cut = F.col("my")
    for i in range(p):
        cut = cut - F.col(f"b{i}") * F.col(f"m{i}")
    return t.select(*[F.col(g).alias(c) for g, c in zip(groups, group_cols)], "n", cut.alias("intercept"),
                    F.array(*[F.col(f"b{i}") for i in range(p)]).cast("array<double>").alias("beta"))


def per_entity_regression(train: DataFrame, test: DataFrame, entity: str, features, y: str = "y") -> DataFrame:
    """Test rows with the ``prediction`` of their entity's least squares on ``features`` (NULL: no fit or a NULL feature)."""
    coef = grouped_least_squares(train, [entity], features, y).select(col_(entity), F.col("intercept").alias("_a"), F.col("beta").alias("_b"))
    j = join_on(test, coef, [entity], "left")
    pred = F.col("_a")
    for i, c in enumerate(features):
        pred = pred + F.col("_b")[i] * col_(c).cast("double")
    return j.withColumn("prediction", pred).drop("_a", "_b")


#: Forecasters of ``per_entity_pipeline`` by name: (train, test, entity, time, y) -> test rows with ``prediction``.
PER_ENTITY_MODELS = {"naive": naive, "seasonal_naive": seasonal_naive, "ar_differences": ar_on_differences, "seasonal_ar": seasonal_ar,
                     "linear_trend": linear_trend, "holt": holt}


def per_entity_pipeline(df: DataFrame, entity: str, time_col: str, y: str, features=(), models=tuple(PER_ENTITY_MODELS),
                        train_frac: float = 0.8, max_entities: int | None = None, tiebreak=()) -> DataFrame:
    """One model of each kind per eligible entity: ``(entity, model, status, skip_reason, n_train, n_test, mae, rmse)``.

    Every kind is fitted for all entities at once (grouped aggregates, joined to the test rows), on the first
    ``train_frac`` of an entity's rows in time order, and scored on the rest; ``features`` adds the kind
    ``linear_regression``. An entity that is not eligible is listed once, as ``skipped`` with its reason and no model; one
    whose model has no prediction for any test row is listed as ``failed`` for that model. Rows without y are left out."""
    from tabflow.operators.split import split_chronological_entity
    ensure_checkpoint_dir(df.sparkSession)
    known = df.where(col_(y).isNotNull()).select(*dict.fromkeys([entity, time_col, y, *features, *tiebreak]))
    listed = entity_eligibility(known, entity, time_col, train_frac, max_entities).checkpoint(eager=True)
    chosen = join_on(known, listed.where("eligible").select(col_(entity)), [entity], "left_semi") if not listed.where("eligible").isEmpty() else known.limit(0)
    split = split_chronological_entity(chosen, entity, time_col, tiebreak, train_frac).checkpoint(eager=True)
    train, test = (split.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    found = None
    kinds = {m: PER_ENTITY_MODELS[m](train, test, entity, time_col, y) for m in models}
    if features:
        kinds["linear_regression"] = per_entity_regression(train, test, entity, list(features), y)
    for name, pred in kinds.items():
        off = F.col("prediction") - col_(y).cast("double")
        one = pred.groupBy(col_(entity)).agg(F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse")).withColumn("model", F.lit(name))
        found = one if found is None else found.unionByName(one)
    sizes = listed.select(col_(entity), "skip_reason", F.col("n_train").cast("bigint").alias("n_train"), F.col("n_test").cast("bigint").alias("n_test"))
    order = [entity, "model", "status", "skip_reason", "n_train", "n_test", "mae", "rmse"]
    done = join_on(found, sizes.where("skip_reason IS NULL"), [entity]).withColumn("status", F.when(F.col("mae").isNull(), "failed").otherwise("success"))
    skipped = sizes.where("skip_reason IS NOT NULL").withColumns({"model": F.lit(None).cast("string"), "status": F.lit("skipped"),
                                                                 "mae": F.lit(None).cast("double"), "rmse": F.lit(None).cast("double")})
    return done.select(*[col_(c) for c in order]).unionByName(skipped.select(*[col_(c) for c in order]))


# ----------------------------------------------------------------------------- runner, regressions over lags

def run_forecasters(train: DataFrame, test: DataFrame, entity: str, time_col: str, y: str = "y", models=tuple(PER_ENTITY_MODELS), run_id: str = "run",
                    period: int = SEASON) -> DataFrame:
    """Score every forecaster on the test rows: results rows (``models.RESULT_SCHEMA``) with mae, rmse, smape and mase; one
    that fails is a result row and never aborts the run."""
    import time

    from tabflow.operators.metrics import forecasting_metrics
    from tabflow.operators.models import RESULT_SCHEMA
    ensure_checkpoint_dir(train.sparkSession)
    train, test = train.checkpoint(eager=True), test.checkpoint(eager=True)  # read by every forecaster
    rows = []
    for name in models:
        t0 = time.time()
        try:
            pred = PER_ENTITY_MODELS[name](train, test, entity, time_col, y).checkpoint(eager=True)
            got = forecasting_metrics(train, pred, [entity], time_col, y, "prediction", period).first()
            rows += [(run_id, 1, name, "success", m, v, None, round(time.time() - t0, 3)) for m, v in got.asDict().items()]
        except Exception as e:  # noqa: BLE001
            rows.append((run_id, 1, name, "failed", None, None, f"{type(e).__name__}: {e}", round(time.time() - t0, 3)))
    return train.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def regression_forecast(split: DataFrame, entity: str, time_col: str, y: str = "y", candidate: str = "linear_regression", lags=(1, 7), windows=(7,),
                        params: dict | None = None) -> DataFrame:
    """Forecast as regression on lags, rolling means and calendar parts: test rows ``(label, prediction)``.

    ``split`` has a ``split`` column; a row's features look back over the true values before it (one step ahead). Rows
    without a full history are left out."""
    from tabflow.operators.features import date_parts, lag_rolling_features
    from tabflow.operators.models import REGISTRY, fit_predict
    ensure_checkpoint_dir(split.sparkSession)
    f = date_parts(lag_rolling_features(split, y, time_col, entity, lags, windows), time_col)
    feats = [*(f"{y}_lag_{k}" for k in lags), *(f"{y}_rolling_mean_{w}" for w in windows), *(f"{time_col}_{p}" for p in ("dayofweek", "month", "day"))]
    f = f.dropna(subset=[y, *feats]).checkpoint(eager=True)  # the fit passes read the feature table, not its lineage
    return fit_predict(REGISTRY[("regression", candidate)], f.where("split = 'train'"), f.where("split = 'test'"), feats, y, "regression", params)


def global_forecast(df: DataFrame, entity: str, time_col: str, y: str = "y", candidate: str = "gradient_boosting", lags=(1, 7), windows=(7,),
                    max_h: int = 28, params: dict | None = None) -> tuple[DataFrame, int]:
    """One regressor over all entities, on their lags and an entity index; the last h points of every entity are the test
    (X11): ``(test rows (label, prediction), h)``. Rows without a target, time or entity are left out."""
    from pyspark.ml.feature import StringIndexer

    from tabflow.operators.features import lag_rolling_features
    from tabflow.operators.models import REGISTRY, fit_predict
    from tabflow.operators.split import holdout_last_h
    ensure_checkpoint_dir(df.sparkSession)
    d = df.select(col_(entity), col_(time_col), col_(y).cast("double").alias(y)).dropna()
    split, h = holdout_last_h(d, entity, time_col, max_h)
    feats = [*(f"{y}_lag_{k}" for k in lags), *(f"{y}_rolling_mean_{w}" for w in windows)]
    f = lag_rolling_features(split, y, time_col, entity, lags, windows).dropna(subset=feats).checkpoint(eager=True)
    f = f.withColumn("_entity", col_(entity).cast("string"))
    f = StringIndexer(inputCol="_entity", outputCol="entity_idx", stringOrderType="alphabetAsc").fit(f).transform(f)
    pred = fit_predict(REGISTRY[("regression", candidate)], f.where("split = 'train'"), f.where("split = 'test'"), [*feats, "entity_idx"], y, "regression", params)
    return pred, h


def per_entity_aggregate(results: DataFrame) -> DataFrame:
    """Mean score and time per model over entities; missing scores are ignored."""
    return results.groupBy("model").agg(F.avg("value").alias("mean_score"), F.avg("train_seconds").alias("mean_seconds"),
                                        F.count("value").alias("n_entities_scored"),
                                        F.count(F.lit(1)).alias("n_entities"))
