"""Exact quantiles by rank refinement.

Spark's exact ``percentile``/``median`` keep a value→count map per group, and sorting moves every distinct value. Here
no value is moved: each double has an order-preserving 64-bit key, one long aggregate counts the keys' leading bits for
all columns at once (map-side combined, at most 2^21 buckets a column and sign), and the few buckets that hold a wanted
rank are counted again by their next bits. A bucket whose smallest and largest value agree is final, so values with few
digits are done after one or two scans; after three, all 64 bits are used up. Per scan, the driver gets two rows
(column, probability) at most. Linear interpolation between the two neighbouring ranks (numpy's default).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import col_

#: Bits that are left out of the key in each scan.
SHIFTS = (42, 21, 0)
MANTISSA = 1 << 52


def with_order_key(df: DataFrame, value: str = "value", key: str = "key") -> DataFrame:
    """``df`` with a long ``key`` that orders as the doubles of ``value`` do: the bits of the magnitude, negated for negative
    numbers (both zeros 0, NaN last). Distinct doubles have distinct keys."""
    v = F.col(value)
    a = F.abs(v)
    names = df.columns
    tiny = a < float.fromhex("0x1p-1022")
    # Few expressions, each used once or twice: a generated method of over 8,000 bytes is never compiled by the JVM.
    e = df.select("*", F.when((a < float("inf")) & ~tiny, F.least(F.floor(F.log2(a)).cast("double"), F.lit(1023.0))).alias("_e"))
    m = e.select(*names, "_e", (a / F.pow(F.lit(2.0), F.col("_e"))).alias("_m"))
    # floor(log2) may be off by one beside a power of two: then the mantissa lies just below 1 or from 2 on.
    part = F.when(F.col("_m") < 1, (F.col("_m") - 1) * 2).when(F.col("_m") >= 2, F.col("_m") / 2).otherwise(F.col("_m") - 1)
    half = float.fromhex("0x1p537")
    bits = (F.when(F.col("_m").isNotNull(), (F.col("_e") + 1023).cast("long") * MANTISSA + (part * float(MANTISSA)).cast("long"))
            .when(F.isnan(v), F.lit(2047 * MANTISSA + 1)).when(a == float("inf"), F.lit(2047 * MANTISSA))
            .otherwise((a * half * half).cast("long")))
    keyed = m.select(*names, bits.alias(key))
    return keyed.select(*names, (F.col(key) * F.when(v < 0, -1).otherwise(1)).alias(key))


def _ranks(counts: DataFrame, group: list[str], wanted) -> DataFrame:
    """Rows of ``counts`` (group.., b, n, lo, hi) that hold a wanted rank: (group.., p, side, frac, left, b, n, lo, hi, total)."""
    w = W.partitionBy(*group)
    run = counts.select("*", F.sum("n").over(w.orderBy("b").rowsBetween(W.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(w).alias("total"))
    hit = run.select(*group, "b", "n", "lo", "hi", "cum", "total", F.inline(wanted)) if isinstance(wanted, Column) else run.join(wanted, group)
    return (hit.where((F.col("cum") - F.col("n") <= F.col("r")) & (F.col("r") < F.col("cum")))
            .withColumn("left", F.col("r") - F.col("cum") + F.col("n")))


def quantile_table(df: DataFrame, cols, probs, counts: dict | None = None) -> dict:
    """``{(column, p): value}``; columns without values are absent. ``counts``, if given, gets the non-null rows per column.

    At most three scans of ``cols``, whatever their number and that of the probabilities (p = 0 and 1 are the extremes)."""
    spark = df.sparkSession
    cols, probs = list(dict.fromkeys(cols)), list(dict.fromkeys(float(p) for p in probs))
    if not cols or not probs:
        return {}
    at = [f"c{i}" for i in range(len(cols))]
    casted = df.select(*[col_(c).cast("double").alias(a) for c, a in zip(cols, at)])
    long = casted.unpivot([], at, "column", "value").where(F.col("value").isNotNull())
    keyed = with_order_key(long)
    h = lambda p: (F.col("total") - 1) * F.lit(p)
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(side).alias("side"), (h(p) - F.floor(h(p))).alias("frac"), f(h(p)).cast("long").alias("r"))
                       for p in probs for side, f in (("lo", F.floor), ("hi", F.ceil))])

    def counted(rows, group, shift):
        return (rows.withColumn("b", F.shiftright("key", shift)).groupBy(*group, "b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))

    open_ = _ranks(counted(keyed, ["column"], SHIFTS[0]), ["column"], wanted).collect()
    found = {}
    for shift, before in zip(SHIFTS[1:] + (None,), SHIFTS):
        rest, spans = [], {}
        for r in open_:
            if counts is not None:
                counts[cols[int(r["column"][1:])]] = r["total"] if before == SHIFTS[0] else counts[cols[int(r["column"][1:])]]
            if shift is None or r["lo"] == r["hi"]:
                found[(r["column"], r["p"], r["side"])] = (r["lo"], r["frac"])
            else:
                rest.append((r["column"], r["b"], r["p"], r["side"], r["frac"], r["left"]))
                spans.setdefault(r["column"], {})[r["b"]] = (r["lo"], r["hi"])
        if not rest:
            break
        ranks = spark.createDataFrame(rest, "column string, top long, p double, side string, frac double, r long")
        top = F.shiftright("key", before).alias("top")
        # The smallest and largest value of each open bucket pick its values, so that no other value is given a key again.
        within = [F.when(reduce(or_, (F.col(a).between(F.lit(lo), F.lit(hi)) for lo, hi in spans[a].values())), F.col(a)).alias(a) for a in spans]
        values = casted.select(*within).unpivot([], list(spans), "column", "value").where(F.col("value").isNotNull())
        inside = with_order_key(values).select("*", top)
        open_ = _ranks(counted(inside, ["column", "top"], shift), ["column", "top"], F.broadcast(ranks)).collect()
    out = {}
    for (c, p, side), (v, frac) in found.items():
        if side == "lo":
            hi = found[(c, p, "hi")][0]
            out[(cols[int(c[1:])], p)] = v if hi == v else v + frac * (hi - v)
    return out


def exact_quantiles(df: DataFrame, cols, probs) -> DataFrame:
    """``(column, p, value)`` for every column and probability; columns with no values are absent."""
    rows = [(c, p, v) for (c, p), v in sorted(quantile_table(df, cols, probs).items())]
    return df.sparkSession.createDataFrame(rows, "column string, p double, value double")


def quantile_columns(df: DataFrame, cols, probs, names) -> DataFrame:
    """One row per column with one quantile column per probability (``names`` in order)."""
    q = quantile_table(df, cols, probs)
    rows = [(c, *(q[(c, float(p))] for p in probs)) for c in dict.fromkeys(cols) if (c, float(probs[0])) in q]
    return df.sparkSession.createDataFrame(rows, ", ".join(["column string", *(f"{n} double" for n in names)]))
