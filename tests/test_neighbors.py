"""Exact k-NN (M10) against brute force, with salting forced by tiny buckets."""

import numpy as np
from pyspark.sql import functions as F

from tabflow.operators import models as M
from tabflow.operators import neighbors as N


def _brute(ref, qry, k):
    out = {}
    for qi, qv in qry:
        d = [(float(sum((a - b) * (a - b) for a, b in zip(qv, rv))), ri) for ri, rv in ref]
        out[qi] = [ri for _, ri in sorted(d)[:k]]
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id bigint, v array<double>")


def _search(spark, ref, qry, k=5, **kw):
    idx = N.build_index(_frame(spark, ref), "id", F.col("v"), k=k, n_pivots=kw.get("n_pivots"),
                        bucket_rows=kw.get("bucket_rows", N.BUCKET_ROWS))
    nb = N.knn_search(idx, _frame(spark, qry), "id", F.col("v"), k=k,
                      bucket_queries=kw.get("bucket_queries", N.BUCKET_QUERIES))
    got = {}
    for r in nb.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["rid"])
    return got


def test_matches_brute_force_with_salting(spark):
    rng = np.random.default_rng(7)
    ref = [(i, rng.normal(size=4).round(2)) for i in range(120)]
    ref += [(200 + i, ref[i][1]) for i in range(10)]  # exact duplicates → distance ties
    qry = [(1000 + i, rng.normal(size=4).round(2)) for i in range(40)] + [(2000, ref[3][1])]
    want = _brute(ref, qry, 5)
    assert _search(spark, ref, qry, n_pivots=6, bucket_rows=7, bucket_queries=3) == want
    assert _search(spark, ref, qry) == want


def test_hot_cluster_and_small_reference(spark):
    rng = np.random.default_rng(11)
    hot = [(i, rng.normal(scale=0.01, size=3)) for i in range(90)]  # most rows in one tight cluster
    far = [(100 + i, rng.normal(loc=5, size=3)) for i in range(10)]
    qry = [(500 + i, rng.normal(scale=0.02, size=3)) for i in range(30)] + [(600, np.array([5.0, 5.0, 5.0]))]
    ref = hot + far
    assert _search(spark, ref, qry, k=3, n_pivots=4, bucket_rows=5, bucket_queries=4) == _brute(ref, qry, 3)
    tiny = ref[:3]  # fewer reference rows than k: all of them, nearest first
    assert _search(spark, tiny, qry[:5], k=5) == _brute(tiny, qry[:5], 5)


def test_vote_ties_go_to_smallest_class(spark):
    nb = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 1, 3)], "qid int, rid int, y int")
    got = {r["qid"]: (r["prediction"], r["confidence"]) for r in N.knn_vote(nb, "y").collect()}
    assert got == {1: (1, 0.5), 2: (3, 1.0)}


def test_knn_candidate_both_tasks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    rows = [(int(i), float(a), float(b), int(a + b > 0), float(2 * a - b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int, t double")
    tr, te = df.where("id < 60"), df.where("id >= 60")
    clf = M.fit_predict(M.REGISTRY[("classification", "k_nearest_neighbors")], tr, te, ["a", "b"], "y",
                        "classification")
    acc = clf.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert clf.count() == 20 and acc >= 0.8 and "prob_pos" in clf.columns
    reg = M.fit_predict(M.REGISTRY[("regression", "k_nearest_neighbors")], tr, te, ["a", "b"], "t", "regression")
    # brute force on train-standardised features
    xa, ta = x[:60], np.array([r[4] for r in rows])
    mu, sd = xa.mean(axis=0), xa.std(axis=0)
    want = {}
    for i in range(60, 80):
        d = (((xa - mu) / sd - (x[i] - mu) / sd) ** 2).sum(axis=1)
        want[round(ta[i], 9)] = ta[np.lexsort((np.arange(60), d))[:5]].mean()
    got = {round(r["label"], 9): r["prediction"] for r in reg.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 1e-9 for key in want)


def test_equal_vectors_are_one_place(spark):
    rng = np.random.default_rng(5)
    spots = rng.integers(0, 4, size=(400, 2)).astype(float)
    ref = [(i, spots[i]) for i in range(400)]
    qry = [(1000 + i, rng.integers(0, 5, size=2).astype(float)) for i in range(30)]
    idx = N.build_index(_frame(spark, ref), "id", F.col("v"), k=2)
    assert idx.ref.count() == 16 and idx.ref.selectExpr("max(size(_rows))").first()[0] == 2
    for k in (2, 7, 30):  # more than the index keeps, and more than some places or all pivots hold
        nb = N.knn_search(idx, _frame(spark, qry), "id", F.col("v"), k=k).orderBy("qid", "rank").collect()
        got = {}
        for r in nb:
            got.setdefault(r["qid"], []).append(r["rid"])
        assert got == _brute(ref, qry, k)


def test_search_writes_no_distance_per_pivot(spark):
    rng = np.random.default_rng(6)
    ref = [(i, rng.normal(size=3)) for i in range(900)]
    idx = N.build_index(_frame(spark, ref), "id", F.col("v"))
    assert len(idx.pivots) == 30
    plan = N.knn_search(idx, _frame(spark, ref[:50]), "id", F.col("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_pd#" not in plan and "map<" not in plan


def test_query_meets_a_bucket_once_however_many_cells(spark, monkeypatch):
    """In 64 dimensions nearly all cells are within reach; a query is sent once per bucket of cells, not once per cell."""
    rng = np.random.default_rng(8)
    ref = [(i, v) for i, v in enumerate(rng.normal(size=(900, 64)))]
    qry = [(1000 + i, v) for i, v in enumerate(rng.normal(size=(60, 64)))]
    sent, scored = [], N._scored_top_k

    def counted(qrows, *args, **kw):
        sent.append(qrows.count())
        return scored(qrows, *args, **kw)

    monkeypatch.setattr(N, "_scored_top_k", counted)
    assert _search(spark, ref, qry, n_pivots=200) == _brute(ref, qry, 5)
    assert sum(sent) < 60 * 200 / 4


def test_screen_keeps_near_ties_far_from_the_origin(spark):
    """Distances far smaller than the vectors, equal and nearly equal ones: the order is that of the sums by coordinate."""
    rng = np.random.default_rng(9)
    grid = rng.integers(0, 3, size=(300, 6)) + 1e6
    ref = [(i, v) for i, v in enumerate(grid)] + [(300 + i, grid[i] + rng.normal(scale=1e-9, size=6)) for i in range(100)]
    qry = [(1000 + i, rng.integers(0, 3, size=6) + 1e6 + rng.normal(scale=1e-9, size=6)) for i in range(40)]
    for kw in ({}, {"n_pivots": 9, "bucket_rows": 11, "bucket_queries": 4}):
        assert _search(spark, ref, qry, k=7, **kw) == _brute(ref, qry, 7)


def test_query_ids_repeat_or_are_null_and_vectors_miss_coordinates(spark):
    rng = np.random.default_rng(10)
    vecs = rng.normal(size=(200, 5)).round(1)
    vecs[[3, 50, 51]] = np.nan
    ref = spark.createDataFrame([(f"r{i:03d}", [float(x) for x in v]) for i, v in enumerate(vecs)], "id string, v array<float>")
    asked = [(i, rng.normal(size=5).astype(np.float32)) for i in (1, 2, 2, 3, None)] + [(4, np.full(5, np.nan, dtype=np.float32))]
    asked.append(asked[0])
    qry = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in asked], "id bigint, v array<float>")
    idx = N.build_index(ref, "id", F.col("v"), n_pivots=20, bucket_rows=40)
    got = {}
    for r in N.knn_search(idx, qry, "id", F.col("v")).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["rid"], r["distance"]))
    vecs, want = vecs.astype(np.float32).astype(np.float64), {}
    for i in {1, 2, 3, None}:
        pairs = []
        for _, v in (a for a in asked if a[0] == i):
            d2 = np.add.accumulate((v.astype(np.float64) - vecs) ** 2, axis=1)[:, -1]
            pairs += [(d, f"r{j:03d}") for j, d in enumerate(d2) if np.isfinite(d)]
        want[i] = [(rid, float(np.sqrt(d))) for d, rid in sorted(pairs)[:5]]
    assert got == want  # a vector with a missing coordinate has no neighbours and is nobody's


def test_cells_are_packed_into_buckets():
    rng = np.random.default_rng(12)
    pivots, sizes = rng.normal(size=(50, 8)), rng.integers(0, 30, size=50)
    sizes[7] = 1000
    first, parts = N._pack(pivots, sizes, 100)
    assert parts[7] == 10 and (np.delete(parts, 7) == 1).all()
    own = set(range(first[7], first[7] + 10))
    held = {}
    for c in range(50):
        if c != 7:
            assert first[c] not in own
            held[first[c]] = held.get(first[c], 0) + sizes[c]
    assert max(held.values()) <= 100 and len(held) < 20
    assert sorted(own | held.keys()) == list(range(len(own) + len(held)))
