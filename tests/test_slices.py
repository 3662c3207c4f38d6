"""Equi-depth slices of entities: sizes, order and positions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabflow.functions.ordering import entity_positions, order_slices
from tabflow.operators import clean as C
from tabflow.operators.eda import decomposition_strength

SCHEMA = "id int, e string, ts timestamp_ntz, v double"


def rows(n=3000, seed=4):
    """Entity "hot" has a third of all rows within one hour of two years; None and others are spread."""
    rng = random.Random(seed)
    base = dt.datetime(2023, 3, 25)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append((i, "hot", base + dt.timedelta(days=200, seconds=3600 * rng.random()), rng.random()))
        else:
            ts = None if rng.random() < 0.02 else base + dt.timedelta(seconds=rng.random() * 730 * 86400)
            out.append((i, rng.choice([None, "a", "b", "c"]), ts, None if rng.random() < 0.3 else rng.random()))
    out += [(n + i, "tied", base, float(i)) for i in range(400)]  # equal times: the id cuts them
    rng.shuffle(out)
    return out


def key(t):
    return tuple((x is not None, x) for x in t)


@pytest.mark.parametrize("order", [["ts", "id"], ["v", "id"], ["id"]])
def test_a_hot_hour_is_many_slices_of_bounded_size_in_order(spark, order):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = order_slices(df, ["e"], order, 100).collect()
    by = {}
    for r in got:
        by.setdefault((r["e"], r["_chunk"]), []).append(tuple(r[c] for c in order))
    assert max(map(len, by.values())) < 200
    assert sum(e == "hot" for e, _ in by) >= 5
    for e in {e for e, _ in by}:
        parts = [sorted(by[x], key=key) for x in sorted(by, key=lambda x: (str(x[0]), x[1])) if x[0] == e]
        for a, b in zip(parts, parts[1:]):
            assert key(a[-1]) <= key(b[0])


def test_positions_equal_a_plain_sort(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["id"]: (r["pos"], r["n"]) for r in entity_positions(df, ["e"], ["ts", "id"], count_col="n", slice_rows=90).collect()}
    for e in {r[1] for r in data}:
        mine = sorted((r for r in data if r[1] == e), key=lambda r: key((r[2], r[0])))
        assert [got[r[0]] for r in mine] == [(k, len(mine)) for k in range(len(mine))]
    whole = {r["id"]: r["pos"] for r in entity_positions(df, [], ["ts", "id"], slice_rows=90).collect()}
    assert [r[0] for r in sorted(data, key=lambda r: key((r[2], r[0])))] == sorted(whole, key=whole.get)


def test_small_entities_and_text_orders_are_one_slice(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert order_slices(df, ["e"], ["ts"]).select("_chunk").distinct().collect() == [(0,)]
    named = df.withColumn("s", F.col("id").cast("string"))
    assert order_slices(named, ["e"], ["s"], 100).select("_chunk").distinct().collect() == [(0,)]
    assert order_slices(df.where("false"), ["e"], ["ts"], 10).count() == 0


def test_numbers_of_all_sizes_are_cut(spark):
    vals = [0.0, -1.5, 1e300, -1e300, 5e-324, 2.0 ** 62] + [float(i) for i in range(500)]
    df = spark.createDataFrame([(i, x, int(max(-2 ** 63, min(2 ** 63 - 1, x)))) for i, x in enumerate(vals)], "id int, x double, n long")
    for c in ("x", "n"):
        got = order_slices(df, [], [c, "id"], 50).collect()
        sizes = {}
        for r in got:
            sizes[r["_chunk"]] = sizes.get(r["_chunk"], 0) + 1
        assert max(sizes.values()) < 100
        order = sorted(got, key=lambda r: (r[c], r["id"]))
        assert [r["_chunk"] for r in order] == sorted(r["_chunk"] for r in got)


def test_fill_violations_and_decomposition_do_not_depend_on_the_slices(spark):
    df = spark.createDataFrame(rows(900), SCHEMA)
    fill = lambda n: sorted((tuple(r) for r in C.fill_forward_backward(df, ["v"], ["ts", "id"], ["e"], n).collect()), key=key)
    assert fill(20) == fill(10_000)
    for ent in (["e"], []):
        assert C.time_order_violations(df, "ts", "id", ent, 25).collect() == C.time_order_violations(df, "ts", "id", ent).collect()
    daily = spark.createDataFrame([("ab"[i % 2], dt.date(2020, 1, 1) + dt.timedelta(days=i), float((i * 37) % 11 + i % 7)) for i in range(400)], "e string, ds date, y double")
    for ent in ("e", None):
        a, b = (sorted(map(tuple, decomposition_strength(daily, "ds", "y", ent, slice_rows=n).collect())) for n in (30, 10_000))
        assert a == b


@pytest.mark.parametrize("order", [["ts", "id"], ["n", "id"], ["ts", "e", "id"], ["v", "id"]])
def test_chronological_split_equals_a_plain_sort_and_sorts_nothing(spark, order):
    from tabflow.operators.split import split_chronological
    data = [(i, e, ts, v, (i * 7919) % 50 - 25 if i % 9 else None) for i, e, ts, v in rows(600)]
    df = spark.createDataFrame(data, SCHEMA + ", n long")
    at = [["id", "e", "ts", "v", "n"].index(c) for c in order]
    for frac in (0.0, 0.3, 0.8, 1.0):
        out = split_chronological(df, order[0], order[1:], frac)
        got = {r["id"] for r in out.where("split = 'train'").collect()}
        want = sorted(data, key=lambda r: key([r[j] for j in at]))[:int(len(data) * frac)]
        assert got == {r[0] for r in want}
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()
