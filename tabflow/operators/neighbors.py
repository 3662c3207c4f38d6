"""Exact k nearest neighbours (M10) without pairing every query with every reference row.

Places. Reference rows with equal vectors are one place with its ``k`` smallest ids; only places are searched (the best ``k``
rows lie among the best ``k`` places by distance and smallest id), their rows are put back at the end.

Index. ``P`` pivots (the places with the smallest seeded hash) cut the places
into cells: every place belongs to its nearest pivot and remembers that distance. A cell knows
its radius (largest member–pivot distance). Neighbouring cells are packed into buckets of at
most ``bucket_rows`` places; a larger cell is dealt over buckets of its own, so a cell holding a
third of all rows is still spread over tasks.

Search, for a query q with distances ``pd[c]`` to every pivot:

* bound ``τ0`` = k-th smallest ``pd`` — pivots are reference rows, so k rows lie within it;
* round A: q meets the bucket of its home cell (nearest pivot), this cell first → best k there → ``τA``;
* round B: ``τ = min(τ0, τA)``; q meets every other bucket that has a cell with
  ``pd[c] − radius[c] ≤ τ``, once, however many such cells it has.

The queries meeting one bucket are salted into groups of at most ``bucket_queries``. In a group a
query passes over the cells with ``pd[c] − radius[c] > τ`` and members with
``|pd[c] − d(r, pivot c)| > τ``, where ``τ`` shrinks to the k-th best distance found so far.

Every pruned row lies (by the triangle inequality) farther than k rows already found, so the
answer is exact; bounds carry a relative tolerance of 1e-9 so rounding never prunes a true
neighbour. Top-k is taken per (query, bucket) first and then per query, so no group holds
a query's whole candidate list. Equal distances break on the reference id.

Distances are Euclidean, in double precision, summed coordinate by coordinate. In high
dimension few cells can be passed over, and most pairs have to be looked at: they are screened by a
matrix product relative to the cell's pivot, ``|q|² + |r|² − 2 q·r``, less the most that rounding
can add to it; only pairs that pass are summed coordinate by coordinate, and only these sums count.
Pivot distances are taken in slices inside Arrow-batched pandas UDFs (the P × d pivots, size-checked, are one
broadcast) that return the home cell and the buckets within reach, never P distances; the query × reference block of
one (bucket, query group) is scored with numpy inside
``cogroup().applyInArrow`` (the groups are bounded by the salting, and only each query's best k
leave a group). Cell assignment, salting, joins and the top-k merges are DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import hash_int
from tabflow.session import ensure_checkpoint_dir

# Fixed values.
DEFAULT_K = 5
SEED = 42
MAX_PIVOTS = 1024
MAX_PIVOT_VALUES = 4_000_000  # pivots × dimensions held in the broadcast pivot row (32 MB of doubles)
BUCKET_ROWS = 20_000
BUCKET_QUERIES = 20_000
TOL = 1e-9
MAX_UNROLLED_DIMS = 512
BLOCK_VALUES = 1 << 18  # distances per numpy block (2 MB), whatever the number of pivots or of rows in a bucket
TASKS_PER_CORE = 4  # (bucket, query group) blocks wanted per core where the sets are smaller than the bounds above
MIN_QUERIES = 256   # but no query group is made smaller than this for it


def sq_dist(a, b, dims: int | None = None) -> Column:
    """Squared Euclidean distance of two equally long ``array<double>`` columns, summed in
    coordinate order. With a known, moderate ``dims`` the sum is written out term by term so
    it runs inside whole-stage codegen; otherwise a higher-order function (interpreted)."""
    if dims is not None and 0 < dims <= MAX_UNROLLED_DIMS:
        a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
        total = None
        for i in range(dims):
            t = (a[i] - b[i]) * (a[i] - b[i])
            total = t if total is None else total + t
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def vector_of(cols) -> Column:
    """``array<double>`` from numeric columns, nulls as 0 (the model-matrix rule, F11)."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])


def _as_vectors(df: DataFrame, col: str) -> DataFrame:
    """``col`` as ``array<double>``; ``array<float>`` stays as it is written and sent, half as large, and becomes double in the blocks."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
        return df
    return df.withColumn(col, F.col(col).cast("array<double>"))


def _rounding(dims: int) -> float:
    """Most by which ``|a|² + |b|² − 2 a·b``, summed in any order, can miss the distance summed coordinate by coordinate,
    as a share of ``(|a| + |b|)²``; taken several times over."""
    return 4.0 * (dims + 8) * float(np.finfo(np.float64).eps)


def _home_of(spark, pivots: np.ndarray, k: int):
    """Vector column → (home cell, distance to its pivot, bound τ0: the k-th smallest pivot distance, infinite with fewer pivots).

    The pivots (P × d, size-checked) travel as one broadcast; slices of a batch are numpy blocks of at most
    ``BLOCK_VALUES`` distances. A matrix product finds the pivot, its distance is summed like ``sq_dist``; τ0 is rounded up."""
    sent, block, slack = spark.sparkContext.broadcast((pivots, pivots.mean(axis=0))), BLOCK_VALUES, _rounding(pivots.shape[1])

    @F.pandas_udf("home int, dist double, tau double")
    def home(v: pd.Series) -> pd.DataFrame:
        (pv, mid), n = sent.value, len(v)
        p = pv - mid
        p2 = (p * p).sum(axis=1)
        at, dist, tau = np.zeros(n, dtype=np.int32), np.zeros(n), np.full(n, np.inf)
        step = max(1, block // len(pv))
        for s in range(0, n, step):
            x = np.stack(v.iloc[s:s + step].to_numpy()).astype(np.float64)
            if x.shape[1] != pv.shape[1]:
                raise ValueError("vectors differ in length")
            c = x - mid
            c2 = (c * c).sum(axis=1)
            near = c2[:, None] + p2[None, :] - 2.0 * (c @ p.T)
            at[s:s + step] = best = near.argmin(axis=1)
            acc = np.zeros(len(x))
            for j in range(pv.shape[1]):
                diff = x[:, j] - pv[best, j]
                acc += diff * diff
            dist[s:s + step] = np.sqrt(acc)
            if len(pv) >= k:
                kth = np.partition(near, k - 1, axis=1)[:, k - 1] + slack * (np.sqrt(c2) + math.sqrt(p2.max())) ** 2
                tau[s:s + step] = np.where(np.isfinite(kth), np.sqrt(np.maximum(kth, 0.0)), np.inf)
        return pd.DataFrame({"home": at, "dist": dist, "tau": tau})
    return home


def _wanted_blocks(spark) -> int:
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def _pack(pivots: np.ndarray, sizes: np.ndarray, most: int):
    """First bucket and number of buckets of every cell. Cells are halved across two far pivots until the places of a part
    fit one bucket; a single cell that does not fit gets buckets of its own."""
    first, parts, free = np.zeros(len(pivots), dtype=np.int32), np.ones(len(pivots), dtype=np.int32), 0
    todo = [np.arange(len(pivots))]
    while todo:
        cells = todo.pop()
        held = int(sizes[cells].sum())
        if len(cells) == 1 or held <= most:
            first[cells], parts[cells] = free, max(1, math.ceil(held / most))
            free += int(parts[cells[0]])
            continue
        x = pivots[cells] - pivots[cells].mean(axis=0)
        far = x[(x * x).sum(axis=1).argmax()]
        other = x[((x - far) ** 2).sum(axis=1).argmax()]
        along = np.argsort(x @ (other - far), kind="stable")
        cut = int((np.cumsum(sizes[cells[along]]) * 2 <= held).sum())
        cut = min(max(cut, 1), len(cells) - 1)
        todo += [cells[along[cut:]], cells[along[:cut]]]
    return first, parts


def _buckets_of(spark, first: np.ndarray, parts: np.ndarray):
    """Home cell → the buckets of this cell."""
    sent = spark.sparkContext.broadcast((first, parts))

    @F.pandas_udf("array<int>")
    def buckets(home: pd.Series) -> pd.Series:
        f, n = sent.value
        return pd.Series([np.arange(f[c], f[c] + n[c], dtype=np.int32) for c in home.to_numpy()], dtype=object)
    return buckets


def _reach(spark, pivots: np.ndarray, radius: np.ndarray, first: np.ndarray, parts: np.ndarray):
    """(vector, home cell, bound τ) → the buckets, other than the home cell's, with a cell that the bound cannot exclude."""
    order = np.argsort(first, kind="stable")  # cells of one bucket stand together
    starts = np.flatnonzero(np.r_[True, np.diff(first[order]) > 0])
    sent = spark.sparkContext.broadcast((pivots, pivots.mean(axis=0), radius, order, starts, first, parts))
    block, tol, slack = BLOCK_VALUES, TOL, _rounding(pivots.shape[1])

    @F.pandas_udf("array<int>")
    def reach(v: pd.Series, home: pd.Series, tau: pd.Series) -> pd.Series:
        pv, mid, rad, cells, begins, f, n = sent.value
        p = (pv - mid)[cells]
        p2, rad = (p * p).sum(axis=1), rad[cells]
        group_first, group_parts = f[cells[begins]], n[cells[begins]]
        out = []
        step = max(1, block // len(pv))
        for s in range(0, len(v), step):
            c = np.stack(v.iloc[s:s + step].to_numpy()).astype(np.float64) - mid
            c2 = (c * c).sum(axis=1)
            low = c2[:, None] + p2[None, :] - 2.0 * (c @ p.T) - (slack * (np.sqrt(c2) + math.sqrt(p2.max())) ** 2)[:, None]
            low = np.sqrt(np.maximum(low, 0.0))
            t = tau.iloc[s:s + step].to_numpy(dtype=np.float64)
            far = low * (1 - tol) - rad[None, :] > (t * (1 + tol) + tol)[:, None]  # not far: within reach, or not known
            ok = np.logical_or.reduceat(~far & (rad > -np.inf)[None, :], begins, axis=1)
            ok &= group_first[None, :] != f[home.iloc[s:s + step].to_numpy()][:, None]
            rows, groups = np.nonzero(ok)
            many = group_parts[groups]
            within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            found = (np.repeat(group_first[groups], many) + within).astype(np.int32)
            per_row = np.bincount(rows, weights=many, minlength=len(c)).astype(np.int64)
            out += np.split(found, np.cumsum(per_row)[:-1])
        return pd.Series(out, dtype=object)
    return reach


@dataclass
class NeighborIndex:
    ref: DataFrame    # one row per place: _place, _rid (smallest id), _vec, _cell, _dc, _bucket, _rows (checkpointed)
    pivots: np.ndarray
    radius: np.ndarray  # per cell (-inf: empty)
    first: np.ndarray   # per cell: its first bucket
    parts: np.ndarray   # and its number of buckets (1: one bucket, maybe with other cells)
    payload: tuple
    dims: int
    k: int            # ids kept per place
    again: object     # k → index that keeps k ids per place


def build_index(ref: DataFrame, id_col: str, vec: Column, payload=(), n_pivots: int | None = None,
                k: int = DEFAULT_K, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> NeighborIndex:
    """Pivot index over the reference rows (``id_col`` must be unique)."""
    spark = ref.sparkSession
    payload = tuple(payload)
    ensure_checkpoint_dir(spark)
    r = _as_vectors(ref.select(F.col(id_col).alias("_rid"), vec.alias("_vec"), *payload), "_vec")
    # The k smallest ids of a vector: the rank filter is applied before the exchange as well, so that a vector held by a third
    # of all rows sends k rows per task.
    few = r.withColumn("_r", F.row_number().over(W.partitionBy("_vec").orderBy("_rid"))).where(F.col("_r") <= k)
    places = few.groupBy("_vec").agg(F.sort_array(F.collect_list(F.struct("_rid", *payload))).alias("_rows")) \
        .select(F.col("_rows")[0]["_rid"].alias("_rid"), "_vec", "_rows").checkpoint(eager=True) \
        .withColumn("_place", F.monotonically_increasing_id())  # ids may repeat, places do not
    st = places.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vec")).alias("d")).first()
    n, d = st["n"], st["d"] or 0
    if n == 0:
        raise ValueError("empty reference set")
    p = n_pivots or min(MAX_PIVOTS, max(k, math.ceil(math.sqrt(n))))
    p = max(1, min(p, n))
    if p * d > MAX_PIVOT_VALUES:
        p = max(1, MAX_PIVOT_VALUES // max(d, 1))
    piv = (places.select("_rid", "_vec", hash_int("_rid", seed=seed).alias("_h"))
           .orderBy("_h", "_rid").limit(p).collect())  # bounded top-P, P × d ≤ MAX_PIVOT_VALUES
    pivots = np.array([list(row["_vec"]) for row in sorted(piv, key=lambda row: (row["_h"], row["_rid"]))],
                      dtype=np.float64)
    if np.isfinite(pivots).all(axis=1).any():
        pivots = pivots[np.isfinite(pivots).all(axis=1)]  # nothing is near a vector with a missing coordinate
    home = _home_of(spark, pivots, 1)
    assigned = places.withColumn("_h", home("_vec")).select("_place", "_rid", "_vec", "_rows", F.col("_h.home").alias("_cell"), F.col("_h.dist").alias("_dc"))
    assigned = assigned.checkpoint(eager=True)  # cell ids are reused by every later join
    radius, sizes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    within = F.nanvl("_dc", F.lit(None).cast("double"))  # a vector with a missing coordinate is near nothing
    for row in assigned.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max(within).alias("rad")).collect():  # ≤ P rows
        sizes[row["_cell"]] = row["n"]
        radius[row["_cell"]] = row["rad"] if row["rad"] is not None else -np.inf
    # Small sets are cut finer, so that all cores have a part; results do not depend on the cut.
    most = min(bucket_rows, math.ceil(n / (2 * math.sqrt(_wanted_blocks(spark)))))
    first, parts = _pack(pivots, sizes, most)
    of_cell = lambda x: F.element_at(F.lit(x.tolist()), F.col("_cell") + 1)
    indexed = assigned.withColumn("_bucket", (of_cell(first) + F.pmod(F.xxhash64("_place"), of_cell(parts))).cast("int"))
    return NeighborIndex(indexed, pivots, radius, first, parts, payload, d, k,
                         lambda more: build_index(ref, id_col, vec, payload, n_pivots, more, bucket_rows, seed))


def _bucket_groups(qrows: DataFrame, ref: DataFrame, bucket_queries: int):
    """Key query rows ``(_bucket, _q, _qid, _qvec, _cell, _tau)`` and reference rows by (bucket, query group).

    The queries of a bucket are split into ``m`` groups by their count, and the bucket's
    reference rows are replicated to those ``m`` groups (salting: no group holds more than
    ``bucket_rows`` reference rows or about ``bucket_queries`` queries; fewer, where all cores would not have a part)."""
    qcount = qrows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_nq"))  # one row per bucket
    asked = qcount.agg(F.sum("_nq")).first()[0] or 0
    size = min(bucket_queries, max(MIN_QUERIES, math.ceil(asked / _wanted_blocks(qrows.sparkSession))))
    qcount = qcount.select("_bucket", F.greatest(F.lit(1), F.ceil(F.col("_nq") / F.lit(size))).cast("int").alias("_m"))
    q = (qrows.join(F.broadcast(qcount), "_bucket")
         .withColumn("_qs", F.pmod(F.xxhash64("_q"), F.col("_m")).cast("int")).drop("_m"))
    r = (ref.join(F.broadcast(qcount), "_bucket")
         .withColumn("_qs", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m"))
    return q, r


def _block_top_k(spark, pivots: np.ndarray, k: int, out_cols):
    """Per (bucket, query group): each query's best k among the bucket's reference rows (ties → smaller reference id).

    Cell by cell (a query's home cell before all others), blocks of queries × members are screened by a matrix product
    against the k-th best distance so far; what passes is summed coordinate by coordinate (the order the SQL oracle uses)."""
    sent, block, tol, slack = spark.sparkContext.broadcast(pivots), BLOCK_VALUES, TOL, _rounding(pivots.shape[1])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda t, c: t[c].combine_chunks()
        if left.num_rows == 0 or right.num_rows == 0:
            none = pa.array([], pa.int64())
            return pa.table({"_q": column(left, "_q").take(none), "_qid": column(left, "_qid").take(none), "_rid": column(right, "_rid").take(none),
                             "_place": column(right, "_place").take(none), "_d2": pa.array([], pa.float64())}).select(out_cols)
        pv = sent.value
        dims = pv.shape[1]

        def vectors(t, c):
            return column(t, c).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(t.num_rows, dims)

        Q, R = vectors(left, "_qvec"), vectors(right, "_vec")
        cell, dc = column(right, "_cell").to_numpy(), column(right, "_dc").to_numpy(zero_copy_only=False)
        order = np.lexsort((dc, cell))
        order = order[np.isfinite(R).all(axis=1)[order]]  # others are at no finite distance
        R, cell, dc = R[order], cell[order], dc[order]
        rid = pc.rank(column(right, "_rid"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()[order]
        home, tau = column(left, "_cell").to_numpy(), column(left, "_tau").to_numpy(zero_copy_only=False)
        lim = np.where(np.isnan(tau), np.inf, tau * (1 + tol) + tol) ** 2
        best, at = np.full((len(Q), k), np.inf), np.full((len(Q), k), -1)
        live = np.flatnonzero(np.isfinite(Q).all(axis=1))
        bounds = np.flatnonzero(np.r_[True, np.diff(cell) != 0, True]) if len(cell) else [0]

        def squared(qi, ri):
            out = np.zeros(len(qi))
            piece = max(1, block // max(dims, 1))
            for s in range(0, len(qi), piece):
                diff = Q[qi[s:s + piece]] - R[ri[s:s + piece]]
                diff *= diff
                for j in range(dims):
                    out[s:s + piece] += diff[:, j]
            return out

        def meet(qi, x, pd_, a, members, half):
            """Queries ``qi`` (relative to the pivot: ``x``, at distances ``pd_``) and reference rows from ``a`` on (``members``)."""
            most = np.minimum(lim[qi], best[qi, k - 1])
            err = slack * (pd_ + math.sqrt(2.0 * half.max())) ** 2
            bar = (pd_ * pd_ - most - err) / 2
            g = x @ members.T
            g -= half
            pos = np.flatnonzero(~(g < bar[:, None]))
            width = len(half)
            if width > k and len(pos) > 4 * k * len(qi):  # more than can be among the best: below the k-th of this block
                part = np.partition(g, (width - k, width - 1), axis=1)
                kth = np.where(np.isfinite(part[:, -1]), part[:, width - k], -np.inf) - err
                pos = np.flatnonzero(~(g < np.fmax(bar, kth)[:, None]))
            if not len(pos):
                return
            i, r = pos // width, a + pos % width
            d2 = squared(qi[i], r)
            keep = np.isfinite(d2) & (d2 <= most[i])
            i, r, d2 = i[keep], r[keep], d2[keep]
            u = np.unique(i)
            had = at[qi[u]]
            i = np.r_[np.repeat(u, k)[(had >= 0).ravel()], i]
            r, d2 = np.r_[had[had >= 0], r], np.r_[best[qi[u]][had >= 0], d2]
            o = np.lexsort((rid[r], d2, i))
            i, r, d2 = i[o], r[o], d2[o]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            top = nth < k
            best[qi[i[top]], nth[top]], at[qi[i[top]], nth[top]] = d2[top], r[top]

        for own in (True, False):
            for a, b in zip(bounds[:-1], bounds[1:]):
                c = cell[a]
                asked = live[(home[live] == c) == own]
                if not len(asked):
                    continue
                members = R[a:b] - pv[c]
                half = (members * members).sum(axis=1) / 2
                slab = max(1, block // max(dims, 1))
                for s in range(0, len(asked), slab):
                    qi = asked[s:s + slab]
                    x = Q[qi] - pv[c]
                    pd_ = np.sqrt((x * x).sum(axis=1))
                    t = np.sqrt(np.minimum(lim[qi], best[qi, k - 1])) + tol * (1 + pd_)
                    near = np.flatnonzero(~((pd_ - dc[b - 1] > t) | (dc[a] - pd_ > t)))
                    near = near[np.argsort(pd_[near], kind="stable")]
                    step = max(1, block // (b - a))
                    for z in range(0, len(near), step):
                        y = near[z:z + step]
                        t = np.sqrt(np.minimum(lim[qi[y]], best[qi[y], k - 1])) + tol * (1 + pd_[y])
                        lo, hi = np.searchsorted(dc[a:b], np.fmin.reduce(pd_[y] - t)), np.searchsorted(dc[a:b], np.fmax.reduce(pd_[y] + t), side="right")
                        if hi > lo:
                            meet(qi[y], x[y], pd_[y], a + lo, members[lo:hi], half[lo:hi])

        q, nth = np.nonzero(at >= 0)
        r = pa.array(order[at[q, nth]])
        q = pa.array(q)
        return pa.table({"_q": column(left, "_q").take(q), "_qid": column(left, "_qid").take(q), "_rid": column(right, "_rid").take(r),
                         "_place": column(right, "_place").take(r), "_d2": pa.array(best[at >= 0])}).select(out_cols)
    return run


def _scored_top_k(qrows: DataFrame, ref: DataFrame, pivots: np.ndarray, k: int, bucket_queries: int) -> DataFrame:
    q, r = _bucket_groups(qrows, ref, bucket_queries)
    q = q.select("_bucket", "_qs", "_q", "_qid", "_qvec", "_cell", "_tau")
    r = r.select("_bucket", "_qs", "_rid", "_place", "_vec", "_cell", "_dc")
    out_cols = ["_q", "_qid", "_rid", "_place", "_d2"]
    fields = {f.name: f.dataType.simpleString() for f in (*q.schema.fields, *r.schema.fields)}
    schema = ", ".join(f"{c} {'double' if c == '_d2' else fields[c]}" for c in out_cols)
    keys = ["_bucket", "_qs"]
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(_block_top_k(ref.sparkSession, pivots, k, out_cols), schema)


def _top_k(pairs: DataFrame, k: int, keys) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("_d2", "_rid")
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def knn_search(index: NeighborIndex, queries: DataFrame, id_col: str, vec: Column, k: int = DEFAULT_K,
               bucket_queries: int = BUCKET_QUERIES) -> DataFrame:
    """Exact k nearest reference rows of every query row.

    Returns ``(qid, rank, rid, distance, payload...)``; rank 1 is nearest."""
    if k > index.k:
        index = index.again(k)
    payload, spark = list(index.payload), queries.sparkSession
    home, buckets = _home_of(spark, index.pivots, k), _buckets_of(spark, index.first, index.parts)
    reach = _reach(spark, index.pivots, index.radius, index.first, index.parts)
    q = _as_vectors(queries.select(F.col(id_col).alias("_qid"), vec.alias("_qvec")), "_qvec").withColumn("_h", home("_qvec"))
    # Written once: both rounds and their counts per bucket read it. Ids may repeat or be null, row numbers do not.
    q = q.select("_qid", "_qvec", F.col("_h.home").alias("_cell"), F.col("_h.tau").alias("_tau")) \
        .checkpoint(eager=True).withColumn("_q", F.monotonically_increasing_id())

    # Round A: the bucket of the home cell, bounded by τ0.
    at_home = q.withColumn("_bucket", F.explode(buckets("_cell")))
    a1 = _scored_top_k(at_home, index.ref, index.pivots, k, bucket_queries)
    a2 = _top_k(a1, k, ["_q"]).checkpoint(eager=True)
    tau_a = a2.groupBy("_q").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("_d2"))).alias("_taua"))

    # Round B: the other buckets with a cell that the bound cannot exclude.
    qb = q.join(tau_a, "_q", "left").withColumn("_tau", F.least("_tau", "_taua")).drop("_taua") \
        .withColumn("_b", reach("_qvec", "_cell", "_tau")).checkpoint(eager=True)
    b1 = _scored_top_k(qb.withColumn("_bucket", F.explode("_b")).drop("_b"), index.ref, index.pivots, k, bucket_queries)
    near = _top_k(a2.unionByName(b1), k, ["_qid"])

    # From places to rows.
    rows = (near.join(index.ref.select("_place", "_rows"), "_place").select("_qid", "_d2", F.explode(F.slice("_rows", 1, k)).alias("_row"))
            .select("_qid", "_d2", "_row.*"))
    w = W.partitionBy("_qid").orderBy("_d2", "_rid")
    return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("_qid").alias("qid"), "rank", F.col("_rid").alias("rid"),
                    F.sqrt("_d2").alias("distance"), *payload))


def knn_vote(neighbors: DataFrame, label_col: str, classes=None) -> DataFrame:
    """Majority class of each query's neighbours (ties → smallest class) with its share;
    with ``classes`` also the per-class shares as ``probability`` in that order."""
    votes = neighbors.groupBy("qid", label_col).agg(F.count(F.lit(1)).alias("_n"))
    tot = F.sum("_n")
    aggs = [F.min_by(F.col(label_col), F.struct(-F.col("_n"), F.col(label_col))).alias("prediction"),
            (F.max("_n") / tot).alias("confidence")]
    if classes is not None:
        aggs.append(F.array(*[F.coalesce(F.sum(F.when(F.col(label_col) == F.lit(c), F.col("_n"))), F.lit(0)) / tot
                              for c in classes]).alias("probability"))
    return votes.groupBy("qid").agg(*aggs)


def knn_mean(neighbors: DataFrame, target_col: str) -> DataFrame:
    """Mean target of each query's neighbours (k-NN regression, uniform weights)."""
    return neighbors.groupBy("qid").agg(F.avg(F.col(target_col).cast("double")).alias("prediction"))
