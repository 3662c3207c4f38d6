"""Driver contract: entry runs, every oracle belongs to a registered query, names are unique."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_smoke(spark):
    mod = _entry()
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert {"column", "issue_type", "severity"} <= set(df.columns)


def test_registry_shapes():
    mod = _entry()
    q, o = mod.queries(), mod.oracle_sql()
    assert len(q) > 150
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())


def test_some_queries_run_on_smallest_tables(spark):
    mod = _entry()
    q = mod.queries()
    for name in ("numeric_stats", "split_random", "m_roc_auc", "fc_seasonal_naive", "stream_score"):
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0
