"""Table sources: Parquet and CSV scans with NaN normalised to NULL.

NaN poisons Spark's ``avg``/``max``/``percentile`` and is counted by ``count``, while
the pipeline treats it as missing, so every float column is passed through
``nanvl(x, NULL)`` at ingest. The projection is lazy: Catalyst still prunes columns
and pushes filters into the Parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.functions.exprs import col_

SUPPORTED_SUFFIXES = (".csv", ".parquet", ".json")


def nan_to_null(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(col_(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(col_(f.name))
    return df.select(*cols)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables (``lineitem``, ``orders`` ...) as a DataFrame."""
    return nan_to_null(spark.read.parquet(table_path(sf_dir, name)))


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Scan a dataset by suffix. CSV gets a header and inferred types unless a
    schema is given (recommended at scale: inference costs an extra pass)."""
    lower = path.lower().rstrip("/")
    if not lower.endswith(SUPPORTED_SUFFIXES):
        raise ValueError(f"unsupported file type: {path}")
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    if lower.endswith(".csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    elif lower.endswith(".json"):
        df = spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    return nan_to_null(df)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
