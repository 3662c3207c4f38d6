"""Quality scores from a regularised quadratic discriminant on document statistics.

Every text is reduced to ``len(FEATURES)`` statistics, log- or logit-transformed. Per class the mean and the covariance
over all labelled rows are taken from sums that tasks add up; the covariance is shrunk towards the pooled one and
towards its own mean variance. A score is the logistic of the difference of the classes' log densities: Mahalanobis
distances by triangular solves with the Cholesky factors, which are computed once, and log determinants.

Only (features squared) sums per class reach the driver. Defined results: a null or empty text has the statistics of
the empty text and a score like any other; rows without a label, and labels other than 0 and 1, teach nothing; a
label row counts for every document row with its id; with fewer than two classes every score is 0.5; an empty table
gives no rows. Only the named columns are read; language, source and id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.common import col, documents, written
from tabflow.llm.langid import fold
from tabflow.llm.textvec import lower_ascii, rolling, row_bounds, slices, span_hash, spans, utf8, words

FEATURES = ("log_chars", "log_words", "log_lines", "word_length", "word_length_sd", "letters", "upper", "digits", "marks", "stops",
            "symbols", "bars", "wide", "distinct", "top_word", "adjacent", "lines_repeated", "bigrams_distinct")
SHRINK_POOLED, SHRINK_SPHERE = 0.1, 0.02
LEAST_VARIANCE = 1e-4
#: Characters (lines) added to the denominator of rare-character (repeated-line) shares, so that one oddity in a very
#: short text is no extreme value.
FEW_CHARS, FEW_LINES = 60, 3
CUT = 0.3


def logit(x, eps=2e-3):
    x = np.clip(x, 0.0, 1.0)
    return np.log((x + eps) / (1 - x + eps))


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[rows, features] of a slice of whole texts."""
    n = len(offs) - 1

    def per_row(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offs[1:]] - c[offs[:-1]]).astype(float)

    chars = per_row((data & 0xC0) != 0x80)
    low = lower_ascii(data)
    upper = per_row((data >= 65) & (data <= 90))
    wide = per_row(data >= 0xC0)
    letters = per_row((low >= 97) & (low <= 122)) + wide
    digits = per_row((data >= 48) & (data <= 57))
    stops = per_row((data == 44) | (data == 46))
    marks = per_row((data == 33) | (data == 63))
    symbols = per_row(((data >= 35) & (data <= 38)) | (data == 42) | (data == 64) | (data == 94) | (data == 126) | (data == 61) | (data == 95))
    bars = per_row((data == 124) | (data == 60) | (data == 62) | (data == 92) | (data == 123) | (data == 125))
    s, e = words(data, offs)
    first = row_bounds(s, offs)
    count = np.diff(first).astype(float)
    length = (e - s).astype(float)

    def sums(x):
        c = np.concatenate([[0.0], np.cumsum(x)])
        return c[first[1:]] - c[first[:-1]]

    some = np.maximum(count, 1)
    mean = sums(length) / some
    sd = np.sqrt(np.maximum(sums(length * length) / some - mean * mean, 0))
    pre = rolling(low)
    h = span_hash(pre, s, e)
    same = np.concatenate([[False], h[1:] == h[:-1]])
    same[first[:-1][first[:-1] < len(h)]] = False
    adjacent = sums(same)
    ls, le = spans(data != 10, offs)
    lfirst = row_bounds(ls, offs)
    lh = span_hash(pre, ls, le)
    distinct, top, lines_again, pairs = (np.zeros(n) for _ in range(4))
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h[:0]
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            _, c = np.unique(h[a:b], return_counts=True)
            distinct[i], top[i] = len(c) / (b - a), c.max() / (b - a)
            pairs[i] = len(np.unique(two[a:b - 1])) / (b - a - 1) if b - a > 1 else 1.0
        a, b = lfirst[i], lfirst[i + 1]
        if b > a:
            lines_again[i] = (b - a - len(np.unique(lh[a:b]))) / (b - a + FEW_LINES)
    c, few = np.maximum(chars, 1), chars + FEW_CHARS
    return np.stack([np.log1p(chars), np.log1p(count), np.log1p(np.diff(lfirst)), np.log1p(mean), np.log1p(sd), logit(letters / c),
                     logit(upper / (letters + FEW_CHARS)), logit(digits / few), logit(marks / few), logit(stops / c), logit(symbols / few),
                     logit(bars / few), logit(wide / np.maximum(letters, 1)), logit(distinct), logit(top), logit(adjacent / some),
                     logit(lines_again), logit(pairs)], axis=1)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every row."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            for i, j, d, o in slices(data, offs):
                x = statistics(d, o)
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], ["doc_id", "x"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def fit(train: DataFrame, pooled: float = SHRINK_POOLED, sphere: float = SHRINK_SPHERE) -> dict | None:
    """Discriminant from (x, y) rows, y 0 or 1: count, sum and sum of products per class, added up by Spark."""
    import pyarrow as pa
    d = len(FEATURES)

    def add(batches):
        total = {}
        for b in batches:
            y = b.column(1).to_numpy()
            x = np.asarray(b.column(0).flatten()).reshape(-1, d)
            for k in np.unique(y):
                z = x[y == k]
                total[k] = total.get(k, 0) + np.concatenate([[len(z)], z.sum(0), (z.T @ z).reshape(-1)])
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v))), pa.array(v)], ["y", "at", "v"])

    rows = train.where("y in (0, 1)").select("x", F.col("y").cast("int").alias("y")).mapInArrow(add, "y int, at long, v double")
    got = rows.groupBy("y", "at").agg(F.sum("v").alias("v")).orderBy("y", "at").toPandas()
    parts = {int(y): g["v"].to_numpy() for y, g in got.groupby("y")}
    if len(parts) < 2:
        return None
    stats = {}
    for y, v in parts.items():
        n, mean = v[0], v[1:1 + d] / v[0]
        stats[y] = (n, mean, v[1 + d:].reshape(d, d) / n - np.outer(mean, mean))
    total = sum(s[0] for s in stats.values())
    together = sum(s[0] * s[2] for s in stats.values()) / total
    model = {}
    for y, (n, mean, cov) in stats.items():
        cov = (1 - pooled) * cov + pooled * together
        cov = (1 - sphere) * cov + sphere * np.trace(cov) / d * np.eye(d) + LEAST_VARIANCE * np.eye(d)
        chol = np.linalg.cholesky(cov)
        model[y] = {"mean": mean, "chol": chol, "const": np.log(n / total) - np.log(np.diag(chol)).sum()}
    return model


def log_densities(x: np.ndarray, part: dict) -> np.ndarray:
    z = np.linalg.solve(part["chol"], (x - part["mean"]).T)
    return part["const"] - 0.5 * (z * z).sum(0)


def score(rows: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of (doc_id, x) rows."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(FEATURES))
            p = np.full(len(x), 0.5)
            if model:
                p = 1 / (1 + np.exp(-np.clip(log_densities(x, model[1]) - log_densities(x, model[0]), -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents of four folds and score all."""
    x = written(features(documents(spark, sf_dir)), "quality-features")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("y"))
    model = fit(x.join(labels, "doc_id"))
    return score(x, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                                  F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
