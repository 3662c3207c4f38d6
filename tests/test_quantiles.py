"""Rank refinement: the order key, quantiles against numpy, and no exchange of values."""

import math
import random
import struct

import numpy as np
import pytest

from tabflow.functions import quantiles as Q


def test_order_key_is_the_doubles_bit_order(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, math.inf, -math.inf, 5e-324, 1.7976931348623157e308, float.fromhex("0x1p-1022")]
    for e in range(-1074, 1024, 7):
        x = math.ldexp(1.0, e)
        xs += [x, np.nextafter(x, 0), np.nextafter(x, math.inf)]
    xs += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(2000)]
    xs = [s * float(x) for x in xs if x == x for s in (1, -1)]
    df = spark.createDataFrame([(x,) for x in xs], "value double")
    for r in Q.with_order_key(df).collect():
        bits = struct.unpack("q", struct.pack("d", abs(r.value)))[0]
        assert r.key == (bits if r.value > 0 else -bits)
    nan = Q.with_order_key(spark.createDataFrame([(math.nan,), (math.inf,)], "value double")).collect()
    assert nan[0].key > nan[1].key


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns(rng):
    n = 3000
    return {
        "few values": [rng.choice([1.0, 2.0, 2.5]) for _ in range(n)],
        "a.b`c": [rng.gauss(0, 1) for _ in range(n)],
        "close": [1.0 + k * 2.0 ** -52 for k in rng.sample(range(1 << 20), n)],
        "scales": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "hot": [7.25 if k % 3 else rng.random() for k in range(n)],
        "one": [None] * (n - 1) + [-3.5],
        "two": [None] * (n - 2) + [1.0, 2.0],
        "none": [None] * n,
    }


def test_quantiles_equal_numpy(spark):
    data = columns(random.Random(2))
    names = list(data)
    schema = ", ".join("`" + n.replace("`", "``") + "` double" for n in names)
    df = spark.createDataFrame(list(zip(*data.values())), schema)
    counts = {}
    got = Q.quantile_table(df, names, PROBS, counts)
    for c, xs in data.items():
        xs = [x for x in xs if x is not None]
        assert counts.get(c, 0) == len(xs)
        for p in PROBS:
            if not xs:
                assert (c, p) not in got
            else:
                want = np.quantile(np.array(xs), p)
                assert got[(c, p)] == pytest.approx(want, rel=1e-12, abs=0)
    assert Q.quantile_table(df.where("false"), names, PROBS) == {}
    wide = {r["column"]: r for r in Q.quantile_columns(df, names, [0.5, 0.25], ["m", "q"]).collect()}
    assert set(wide) == set(names) - {"none"} and wide["two"]["m"] == 1.5 and wide["two"]["q"] == 1.25


def test_values_with_few_digits_need_one_scan_and_none_more_than_three(spark, monkeypatch):
    scans = []
    real = Q._ranks
    monkeypatch.setattr(Q, "_ranks", lambda *a: scans.append(a[0]) or real(*a))
    df = spark.range(100_000).selectExpr("cast(id % 50 as double) as q", "cast(id * 37 % 99991 as double) / 100 as price",
                                         "1 + id * pow(2.0, -50) as close")
    Q.quantile_table(df, ["q"], [0.25, 0.5, 0.75])
    assert len(scans) == 1
    scans.clear()
    Q.quantile_table(df, ["q", "price"], [0.25, 0.5, 0.75])
    assert len(scans) == 2
    scans.clear()
    assert Q.quantile_table(df, ["q", "price", "close"], [0.5])[("close", 0.5)] == 1 + 49_999.5 * 2.0 ** -50
    assert len(scans) <= 3
    # Only counts per bucket are shuffled, never a value: the exchange's columns are column, bucket and aggregates.
    plan = scans[0]._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("b#" in line and "value" not in line for line in moved)
