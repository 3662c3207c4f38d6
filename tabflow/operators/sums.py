"""Fits whose passes over the train rows do not grow with iterations, rounds or trees.

A factorization machine's squared loss is a polynomial of second degree in the features, so its gradient at any weights
follows from one matrix of sums over the rows. Trees see a row only as its bins, so rows of one cell (all bins equal)
count as one weighted row; a forest draws every row's copies for every tree in one pass and keeps their sums by cell.
Each ``fit_*`` returns ``apply(prepared rows)``, or None where sums cannot stand for the rows; the caller then fits on the rows themselves.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
from pyspark import TaskContext
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms (1, features, products of two) up to which a matrix of sums is made: 24 features.
MOMENT_TERMS = 301
#: Cells up to which trees are fitted on cells; with more, cells would save little.
MAX_CELLS = 40_000
#: Distinct values of a feature up to which its bin bounds are exact, and the relative rank error of the others.
MAX_VALUES, BOUND_ERROR = 1_000, 0.001
#: Depth up to which a forest is grown on cells, and the sums that a task keeps before it passes them on.
MAX_FOREST_DEPTH, TASK_SUMS = 12, 1 << 22


def _terms(x: np.ndarray) -> np.ndarray:
    """(rows, 1 + d + d(d-1)/2): 1, the features and their products two by two."""
    i, j = np.triu_indices(x.shape[1], 1)
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def _summed(rows: DataFrame, d: int) -> np.ndarray:
    """Z'Z over all rows (d scaled features, then the target), Z: the terms and the target."""
    size = 2 + d + d * (d - 1) // 2

    def part(batches):
        import pyarrow as pa
        total = np.zeros((size, size))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
            for lo in range(0, len(x), 4096):
                z = np.hstack([_terms(x[lo:lo + 4096, :d]), x[lo:lo + 4096, d:]])
                total += z.T @ z
        yield pa.RecordBatch.from_pydict({"pos": np.arange(size * size), "value": total.ravel()})

    got = rows.mapInArrow(part, "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()  # size² rows
    out = np.zeros(size * size)
    for r in got:
        out[r["pos"]] = np.nan if r["value"] is None else r["value"]
    return out.reshape(size, size)


def fit_fm(est, train: DataFrame, inputs: list[str], y: str):
    """The factorization machine of ``est`` (an MLlib ``FMRegressor``, AdamW on all rows without a penalty) on standardised ``inputs``."""
    d = len(inputs)
    if not d or 1 + d + d * (d - 1) // 2 > MOMENT_TERMS or est.getSolver() != "adamW" or est.getMiniBatchFraction() != 1.0 or est.getRegParam():
        return None
    scaler = StandardScaler(inputCol="features", outputCol="features_s", withMean=True, withStd=True).fit(train)
    scaled = [(F.col(c) - float(m)) * float(1 / s if s else 0.0) for c, m, s in zip(inputs, scaler.mean, scaler.std)]
    sums = _summed(train.select(*(x.alias(f"x{i}") for i, x in enumerate(scaled)), F.col(y).cast("double").alias("y")), d)
    n = sums[0, 0]
    if not n or not np.isfinite(sums).all():
        return None
    # No iteration is run here: MLlib draws the weights that its fit would start from.
    start = est.copy({est.maxIter: 0}).fit(train.sparkSession.createDataFrame(
        [(Vectors.dense([0.0] * d), 0.0)], [est.getFeaturesCol(), est.getLabelCol()]))
    v = start.factors.toArray()
    i, j = np.triu_indices(d, 1)
    free = np.concatenate([np.ones(v.size), np.full(d, float(est.getFitLinear())), [float(est.getFitIntercept())]])
    w = np.concatenate([v.ravel(), start.linear.toArray() if est.getFitLinear() else np.zeros(d), [start.intercept]])
    m1, m2, last = np.zeros(len(w)), np.zeros(len(w)), None

    def theta(w):
        v = w[:v_size].reshape(d, -1)
        return np.concatenate([w[-1:], w[v_size:-1], (v @ v.T)[i, j]])

    v_size = v.size
    for t in range(1, est.getMaxIter() + 1):
        g = 2 * (sums[:-1, :-1] @ theta(w) - sums[:-1, -1]) / n
        pair = np.zeros((d, d))
        pair[i, j] = g[1 + d:]
        pair += pair.T
        g = free * np.concatenate([(pair @ w[:v_size].reshape(d, -1)).ravel(), g[1:1 + d], g[:1]])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = m1 / (1 - 0.9 ** t) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)
        last, w = w, w - est.getStepSize() * step
        if t > 1 and np.linalg.norm(w - last) < est.getTol() * max(np.linalg.norm(w), 1.0):
            break
    weights = [float(x) for x in theta(w)]
    terms = [F.lit(1.0), *scaled, *(scaled[a] * scaled[b] for a, b in zip(i, j))]

    def apply(te: DataFrame) -> DataFrame:
        out = F.lit(0.0)
        for c, term in zip(weights, terms):
            out = out + F.lit(c) * term
        return te.withColumn("prediction", out)

    return apply


# --- trees -----------------------------------------------------------------------------------------------------

def bin_bounds(train: DataFrame, inputs: list[str], bins: int) -> list[list[float]]:
    """Ascending bounds per feature, as MLlib's trees choose them: between neighbours where it has at most ``bins`` values,
    else where the running count of the values comes nearest to equal shares (MLlib counts a sample, this all rows);
    of more than ``MAX_VALUES`` values, quantiles."""
    d, limit = len(inputs), max(bins, MAX_VALUES)

    def distinct(batches):
        import pyarrow as pa
        seen = [np.zeros(0)] * d
        for b in batches:
            for k in range(d):
                if len(seen[k]) <= limit:  # one more than the limit tells as much as all of them
                    x = b.column(k).to_numpy(zero_copy_only=False)
                    seen[k] = np.union1d(seen[k], x[~np.isnan(x)])[:limit + 1]
        yield pa.RecordBatch.from_pydict({"feature": np.repeat(np.arange(d), [len(v) for v in seen]), "value": np.concatenate(seen)})

    found = train.select(*inputs).mapInArrow(distinct, "feature long, value double").groupBy("feature").agg(F.collect_set("value").alias("values"))
    found = {r["feature"]: sorted(r["values"]) for r in found.select("feature", F.slice(F.array_sort("values"), 1, limit + 1).alias("values")).collect()}
    values = [found.get(k, []) for k in range(d)]
    many = [c for c, v in zip(inputs, values) if len(v) > limit]
    cuts = dict(zip(many, train.approxQuantile(many, [k / bins for k in range(1, bins)], BOUND_ERROR) if many else []))
    for c, v in zip(inputs, values):
        if c not in cuts:
            counts = None
            if len(v) > bins:
                got = {r[0]: r[1] for r in train.where(~F.isnan(c)).groupBy(c).agg(F.count(F.lit(1))).collect()}  # at most the limit
                counts = [got[x] for x in v]
            cuts[c] = _between(v, counts, bins)
    return [sorted(set(cuts[c])) for c in inputs]


def _between(values: list[float], counts: list[int] | None, bins: int) -> list[float]:
    """Middles between neighbours: all, or with ``counts`` those nearest to equal shares of the rows."""
    if counts is None:
        return [a / 2 + b / 2 for a, b in zip(values, values[1:])]
    stride, out = sum(counts) / bins, []
    target, now = stride, counts[0]
    for k in range(1, len(values)):
        before, now = now, now + counts[k]
        if abs(before - target) < abs(now - target):
            out.append(values[k - 1] / 2 + values[k] / 2)
            target += stride
    return out[:bins - 1]


def _bin(c: str, bounds: list[float]) -> F.Column:
    """How many bounds lie below the value: the bin, as a tree's ``<=`` goes."""
    return functools.reduce(operator.add, ((F.col(c) > F.lit(b)).cast("int") for b in bounds), F.lit(0))


class Cells:
    """Train rows by cell (the bins of all features): ``rows`` are the train rows with their ``cell``, ``table`` has one row
    per cell and target class (or per cell): ``cell``, bins ``b0..``, ``n`` (rows, or their weights), ``y`` (class or mean)."""

    def __init__(self, train: DataFrame, inputs: list[str], y: str, bins: int, by_class: bool, weight: str | None = None):
        self.inputs, self.bounds, self.bins = inputs, bin_bounds(train, inputs, bins), bins
        target = F.col(y).cast("double")
        self.rows = train.select(self.key().alias("cell"), target.alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))
        keys = ["cell", "y"] if by_class else ["cell"]
        table = self.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum("weight").alias("n"), F.avg("y").alias("mean"),
                                             F.count(F.when(~F.isnan("y"), 1)).alias("known"), F.count("y").alias("given"))
        self.table = table.select("cell", *self.parts(F.col("cell")), "count", "known", "given", "n", (F.col("y") if by_class else F.col("mean")).alias("y")).checkpoint(eager=True)
        got = self.table.agg(F.count(F.lit(1)), F.sum("count"), F.sum("known"), F.sum("given")).first()
        self.size = got[0]
        #: Whether cells can stand for the rows: few of them, and every target known.
        self.usable = 0 < got[0] <= MAX_CELLS and got[1] == got[2]
        self.nulls = got[1] != got[3]

    def key(self) -> F.Column:
        return functools.reduce(lambda k, x: k * self.bins + x, (_bin(c, b).cast("long") for c, b in zip(self.inputs, self.bounds)), F.lit(0).cast("long"))

    def parts(self, cell: F.Column) -> list[F.Column]:
        """The bins of a cell's number, as features ``b0..``."""
        d = len(self.inputs)
        return [(F.floor(cell / F.lit(self.bins ** (d - 1 - k))) % self.bins).cast("double").alias(f"b{k}") for k in range(d)]

    def vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=[f"b{k}" for k in range(len(self.inputs))], outputCol="bins").transform(df)


def _cells(est, train: DataFrame, inputs: list[str], y: str, by_class: bool, weight: str | None = None) -> Cells | None:
    bins = est.getMaxBins()
    if not inputs or bins ** len(inputs) > 1 << 50 or est.getMinInstancesPerNode() > 1 or est.getMinWeightFractionPerNode() > 0 or est.getSubsamplingRate() != 1.0:
        return None
    cells = Cells(train, inputs, y, bins, by_class, weight)
    return cells if cells.usable else None


def fit_boosted(est, train: DataFrame, inputs: list[str], y: str, by_class: bool):
    """Boosted trees of ``est`` on cells: rows of a cell (and class) have one gradient, and a spread inside a cell shifts the
    impurity of a node and of its children alike, so weighted cells give the gains that their rows give."""
    cells = _cells(est, train, inputs, y, by_class)
    if cells is None:
        return None
    model = est.copy().setFeaturesCol("bins").setLabelCol("y").setWeightCol("n").fit(cells.vectors(cells.table.coalesce(2)))

    def apply(te: DataFrame) -> DataFrame:
        at = te.select("*", *(_bin(c, b).cast("double").alias(f"b{k}") for k, (c, b) in enumerate(zip(cells.inputs, cells.bounds))))
        return model.transform(cells.vectors(at))

    return apply


def _draws(rows: DataFrame, trees: int, seed: int, classes: int) -> DataFrame:
    """(tree, cell, class, w, s): weight and weighted target of the rows that each tree draws, by cell (and class).

    Every tree takes every row a Poisson(1) number of times, as MLlib's bagging does; the numbers repeat with the
    partitions of the (written) rows."""
    most = TASK_SUMS

    def draw(batches):
        import pyarrow as pa
        rng = np.random.default_rng([seed & 0xFFFFFFFF, TaskContext.get().partitionId()])
        keys, total = {}, np.zeros((2, 64, trees))

        def passed_on():
            key, sums = np.repeat(np.fromiter(keys, np.int64, len(keys)), trees), total[:, :len(keys)].reshape(2, -1)
            tree, some = np.tile(np.arange(trees), len(keys)), sums[0] > 0
            return pa.RecordBatch.from_pydict({"tree": tree[some], "key": key[some], "w": sums[0][some], "s": sums[1][some]})

        for b in batches:
            key, y, weight = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for lo in range(0, len(key), 4096):
                k, target, own = key[lo:lo + 4096], y[lo:lo + 4096], weight[lo:lo + 4096]
                order = np.argsort(k, kind="stable")
                k, target, own = k[order], target[order], own[order]
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                at = np.array([keys.setdefault(x, len(keys)) for x in k[first].tolist()])
                if len(keys) > total.shape[1]:
                    total = np.concatenate([total, np.zeros((2, max(len(keys), total.shape[1]), trees))], axis=1)
                taken = rng.poisson(1.0, (len(k), trees)) * own[:, None]
                total[0, at] += np.add.reduceat(taken, first, axis=0)
                total[1, at] += np.add.reduceat(taken * target[:, None], first, axis=0)
                if len(keys) * trees > most:
                    yield passed_on()
                    keys.clear()
                    total[:] = 0
        if keys:
            yield passed_on()

    key = F.col("cell") * classes + (F.col("y").cast("long") if classes > 1 else F.lit(0))
    found = rows.select(key.alias("key"), "y", "weight").mapInArrow(draw, "tree long, key long, w double, s double")
    return found.groupBy("tree", "key").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def fit_forest(est, train: DataFrame, inputs: list[str], y: str, classes: int):
    """The random forest of ``est`` on cells; ``classes``: their number, 0 for regression. One pass over the rows draws the
    copies of all trees; a tree is then grown by one task from its sums by cell (at most ``MAX_CELLS``, and class)."""
    weight = est.getWeightCol() if est.isDefined(est.weightCol) and est.getWeightCol() else None
    if (est.getNumTrees() < 2 or not est.getBootstrap() or est.getMaxDepth() > MAX_FOREST_DEPTH or est.getFeatureSubsetStrategy() != "auto"
            or est.getImpurity() != ("gini" if classes else "variance")):
        return None
    cells = _cells(est, train, inputs, y, classes > 0, weight)
    if cells is None or cells.nulls:  # MLlib tells of null targets
        return None
    d, bins, k, trees, depth, seed = len(inputs), cells.bins, max(classes, 1), est.getNumTrees(), est.getMaxDepth(), est.getSeed()
    tried, least = int(np.ceil(np.sqrt(d) if classes else d / 3)), est.getMinInfoGain()

    def grow(pdf):
        import pandas as pd
        tree, cell = int(pdf["tree"].iloc[0]), pdf["key"].to_numpy() // k
        rng = np.random.default_rng([seed & 0xFFFFFFFF, trees, tree])
        parts = np.stack([cell // bins ** (d - 1 - f) % bins for f in range(d)])
        if classes:
            stats = np.zeros((len(cell), k))
            stats[np.arange(len(cell)), pdf["key"].to_numpy() % k] = pdf["w"].to_numpy()
        else:
            stats = pdf[["w", "s"]].to_numpy()
        size = (lambda t: t.sum(-1)) if classes else (lambda t: t[..., 0])

        def score(t):  # what impurity leaves of the sum of squares: the larger, the purer
            return (np.square(t).sum(-1) if classes else np.square(t[..., 1])) / np.where(size(t) > 0, size(t), 1)

        at, found = np.ones(len(cell), np.int64), {}
        for level in range(depth + 1):
            names, node = np.unique(at, return_inverse=True)
            n = len(names)
            whole = np.stack([np.bincount(node, c, n) for c in stats.T], -1)
            gain, feature, cut = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64)
            allowed = rng.random((n, d)).argsort(1).argsort(1) < tried
            for f in range(d if level < depth else 0):
                left = np.stack([np.bincount(node * bins + parts[f], c, n * bins) for c in stats.T], -1).reshape(n, bins, -1).cumsum(1)[:, :-1]
                right = whole[:, None] - left
                here = (score(left) + score(right) - score(whole)[:, None]) / size(whole)[:, None]
                here = np.where((size(left) > 0) & (size(right) > 0) & allowed[:, f, None], here, -np.inf)
                best = here.argmax(1)
                top = here[np.arange(n), best]
                more = top > gain
                gain[more], feature[more], cut[more] = top[more], f, best[more]
            feature[(gain <= 0) | (gain < least)] = -1
            for i, name in enumerate(names.tolist()):
                value = whole[i] / size(whole[i]) if classes else whole[i, 1:] / whole[i, 0]
                found[name] = [int(feature[i]), int(cut[i]), value.tolist()]
            deeper = feature[node] >= 0
            node, at, stats, parts = node[deeper], at[deeper], stats[deeper], parts[:, deeper]
            if not len(at):
                break
            at = 2 * at + (parts[feature[node], np.arange(len(at))] > cut[node])
        # Leaves of one parent that predict alike are one, as in MLlib's trees.
        says = (lambda v: int(np.argmax(v))) if classes else (lambda v: v[0])
        for name in sorted(found, reverse=True):
            a, b = found.get(2 * name), found.get(2 * name + 1)
            if found[name][0] >= 0 and a[0] < 0 and b[0] < 0 and says(a[2]) == says(b[2]):
                found[name][0] = -1
        return pd.DataFrame([(tree, name, *x) for name, x in found.items()], columns=["tree", "node", "feature", "cut", "value"])

    drawn = _draws(cells.rows, trees, seed, k)
    # As many rows as the trees have nodes.
    nodes = drawn.groupBy("tree").applyInPandas(grow, "tree long, node long, feature long, cut long, value array<double>").collect()
    grown: dict = {}
    for r in nodes:
        grown.setdefault(r["tree"], {})[r["node"]] = r
    packed = []
    for t in sorted(grown):  # per tree: place of the left child (the right one follows it; 0: leaf), feature, cut, value
        order, todo = [], [1]
        while todo:
            name = todo.pop(0)
            order.append(name)
            if grown[t][name]["feature"] >= 0:
                todo += [2 * name, 2 * name + 1]
        place = {name: i for i, name in enumerate(order)}
        rows = [grown[t][name] for name in order]
        packed.append((np.array([place[2 * r["node"]] if r["feature"] >= 0 else 0 for r in rows]), np.array([r["feature"] for r in rows]),
                       np.array([r["cut"] for r in rows]), np.array([r["value"] for r in rows], float)))

    def answer(cell):
        import pandas as pd
        one, back = np.unique(cell.to_numpy(), return_inverse=True)
        parts = np.stack([one // bins ** (d - 1 - f) % bins for f in range(d)]) if d else np.zeros((0, len(one)))
        every, out = np.arange(len(one)), np.zeros((len(one), k))
        for left, feature, cut, value in packed:
            at = np.zeros(len(one), np.int64)
            while (inner := left[at] > 0).any():
                at = np.where(inner, left[at] + (parts[feature[at], every] > cut[at]), at)
            out += value[at]
        return pd.Series([*(out / len(packed))[back]])

    told = F.pandas_udf(answer, "array<double>")

    def apply(te: DataFrame) -> DataFrame:
        out = te.withColumn("probability", told(cells.key()))
        if not classes:
            return out.withColumn("prediction", F.col("probability")[0]).drop("probability")
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    return apply
