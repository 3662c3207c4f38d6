"""Column-expression helpers shared by the operators.

All of them build JVM-side Catalyst expressions (no Python UDFs), so they stay inside
whole-stage codegen and work the same on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# date/time text formats accepted by the datetime sniffers, tried in order.
DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")
DATETIME_SHAPE = r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"

# Plain number (optional sign, decimals, exponent) after trimming.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# "low - high" range text such as "2100 - 2850".
RANGE_PATTERN = r"^\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col_(c) -> Column:
    """A column by its exact name: dots and back-ticks are part of it."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def parse_datetime_text(c) -> Column:
    """Text → timestamp using the fixed format list; anything else → NULL."""
    c = col_(c)
    # cheap shape guard first: failed format parses are expensive, and every accepted
    # format starts with digits-separator-digits-separator-digits
    return F.when(c.rlike(DATETIME_SHAPE),
                  F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in DATETIME_FORMATS])
                  .cast("timestamp_ntz"))


def parse_number_text(c) -> Column:
    """Plain numeric text → double, else NULL (regex guard: ``try_cast`` alone accepts '12d')."""
    t = F.trim(col_(c).cast("string"))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def parse_numeric_or_range(c) -> Column:
    """A plain number, or ``low - high`` → midpoint, else NULL."""
    t = F.trim(col_(c).cast("string"))
    lo = F.nullif(F.regexp_extract(t, RANGE_PATTERN, 1), F.lit("")).try_cast("double")
    hi = F.nullif(F.regexp_extract(t, RANGE_PATTERN, 2), F.lit("")).try_cast("double")
    return F.coalesce(parse_number_text(t), (lo + hi) / 2.0)


def hash_unit(*cols, seed: int = 42) -> Column:
    """Deterministic pseudo-random number in [0, 1) from the key columns and a seed.

    First 32 bits of ``md5(seed|k1|k2...)``; DuckDB computes the same value with
    ``('0x' || substr(md5(...), 1, 8))::UBIGINT / 4294967296``, which makes every
    split, fold, resample and permutation reproducible in SQL."""
    key = F.concat_ws("|", F.lit(str(seed)), *[col_(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_int(*cols, seed: int = 42) -> Column:
    key = F.concat_ws("|", F.lit(str(seed)), *[col_(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hash_60(*cols, seed: int = 42) -> Column:
    """60 bits of the same hash as a long (in SQL ``('0x' || substr(md5(...), 1, 15))::BIGINT``), for draws among many rows."""
    key = F.concat_ws("|", F.lit(str(seed)), *[col_(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def safe_corr(x, y) -> Column:
    """Pearson r on pairwise-complete rows; NULL where undefined (constant column).

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode on a constant input, so it is
    rebuilt from ``covar_pop`` and population deviations with ``try_divide``."""
    x, y = col_(x).cast("double"), col_(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def skewness_unbiased(c) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``skew``); NULL below 3 rows or zero variance."""
    c = col_(c).cast("double")
    n = F.count(col_(c)).cast("double")
    return F.when((n >= 3) & (F.var_pop(col_(c)) > 0), F.skewness(col_(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_unbiased(c) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurt``); NULL below 4 rows."""
    c = col_(c).cast("double")
    n = F.count(col_(c)).cast("double")
    return F.when((n >= 4) & (F.var_pop(col_(c)) > 0),
                  (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col_(c)) + 6))


def r(c, digits: int = 6) -> Column:
    """Round a double for stable comparison across engines (SQL half-away rounding)."""
    return F.round(col_(c).cast("double"), digits)


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_integral_type(dt) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_time_type(dt) -> bool:
    return isinstance(dt, TIME_TYPES)
