"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where
the result is SQL-expressible, the equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from tabflow.sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict = {}

PLAN_MODULES = ("profile_q", "quality_q", "eda_q", "target_q", "clean_q", "features_q", "split_q",
                "metrics_q", "models_q", "neighbors_q", "leaderboard_q", "forecast_q", "runs_q", "stream_q")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL (None → rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def load_all() -> tuple[dict, dict]:
    for m in PLAN_MODULES:
        try:
            importlib.import_module(f"tabflow.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"tabflow.plans.{m}":
                raise
    return QUERIES, ORACLE
