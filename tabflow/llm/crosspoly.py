"""Near-duplicate vectors by cross-polytope hashing, multiprobe buckets and verified pairs.

A vector is rotated by three rounds of random signs and the fast Hadamard transform; its hash is the signed axis
nearest to the result. A table joins ``HASHES`` such hashes into a bucket. Every vector lies in its own bucket of
each table and is probed in the ``PROBES`` neighbouring buckets whose axes are next nearest, so a pair meets where
one vector's own bucket is among the other's buckets. Every pair that meets is verified by its cosine in double
precision.

Equal vectors of a label are one class, and only one vector per class is hashed. A bucket is cut into blocks of at
most ``BLOCK`` members by hash, and each pair of blocks is one matrix product; its task gives, per vector, the links
counted and the component inside the block, never the pairs. A pair that meets in several buckets is counted in the
first alone, which every block can tell from the two vectors' codes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows with a null label
and rows with a null id link with nothing; vectors of different lengths never link; a repeated row links with its
copies; rows that share an id but not a vector share one node. An empty table gives no rows. Only the three named
columns are read, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.common import col, components, written

THRESHOLD = 0.93
TABLES, HASHES, PROBES = 6, 2, 3
BLOCK = 512
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """[n, tables, 1 + probes] bucket codes of unit rows: the own bucket first, then the probed ones."""
    n, dim = x.shape
    d = 1 << max(dim - 1, 0).bit_length() if dim > 1 else 2
    pad = np.zeros((n, d))
    pad[:, :dim] = x
    out = np.empty((n, tables, 1 + probes), np.int64)
    rng = np.random.default_rng([seed, d])
    ranks = min(probes + 1, d)
    for t in range(tables):
        axis, value = [], []
        for _ in range(hashes):
            y = pad
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :ranks]
            axis.append(top + d * (np.take_along_axis(y, top, 1) < 0))
            value.append(np.take_along_axis(size, top, 1))
        base = 2 * d
        own = np.zeros(n, np.int64)
        for a in axis:
            own = own * base + a[:, 0]
        out[:, t, 0] = own
        # Neighbouring buckets: one axis replaced by a later choice; the smallest loss first.
        loss = np.concatenate([v[:, :1] - v[:, 1:] for v in value], axis=1)
        other = np.concatenate([own[:, None] + (a[:, 1:] - a[:, :1]) * base ** (hashes - 1 - k) for k, a in enumerate(axis)], axis=1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(other, pick, 1)
        out[:, t, 1:1 + found.shape[1]] = found
        out[:, t, 1 + found.shape[1]:] = own[:, None]
    return out


def met(own_a, all_a, own_b, all_b):
    """Per pair and table: (b's own bucket is among a's, a's own bucket is among b's)."""
    return (all_a == own_b[:, :, None]).any(2), (all_b == own_a[:, :, None]).any(2)


def block_links(xa, ca, xb, cb, table: int, bucket: int, same: bool, threshold: float):
    """Index pairs (i, j) of the verified pairs of two blocks whose first meeting place is this bucket, and of all
    verified pairs of the bucket."""
    sim = xa @ xb.T
    if same:
        sim[np.tril_indices(len(xa))] = -2
    i, j = np.nonzero(sim >= threshold)
    if len(i) == 0:
        return i, j, i, j
    here_a, here_b = ca[i, table, 0] == bucket, cb[j, table, 0] == bucket
    meet = here_a | here_b  # one of the two must be at home here
    i, j = i[meet], j[meet]
    x, y = met(ca[i][:, :, 0], ca[i], cb[j][:, :, 0], cb[j])
    earlier = (x | y)[:, :table].any(1)
    place_b, place_a = cb[j, table, 0], ca[i, table, 0]
    x, y = x[:, table], y[:, table]
    first = np.where(x & y, np.minimum(place_a, place_b), np.where(x, place_b, place_a))
    once = ~earlier & (first == bucket)
    return i[once], j[once], i, j


def local_roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest id each vector can reach over the pairs (i, j) of this block."""
    root = ids.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            break
        root = new
    return root


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
                 block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    import pyarrow as pa
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vec_col).cast("array<double>").alias("v"),
                          col(label_col).cast("string").alias("label"))
    fine = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    key = F.when(F.col("fine"), F.sha2(F.concat_ws("|", F.length("label").cast("string"), "label", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))
    rows = written(rows.withColumn("key", key), "vectors")
    classes = written(rows.where("fine").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"),
                                                            F.first("label").alias("label"), F.first("v").alias("v")), "vector-classes")

    def hashed(batches):
        for b in batches:
            reps, labels, sizes = (b.column(k) for k in range(3))
            vs = b.column(3)
            lens = np.diff(np.asarray(vs.offsets))
            flat = np.asarray(vs.flatten())
            at = np.concatenate([[0], np.cumsum(lens)])
            for dim in np.unique(lens):
                pick = np.flatnonzero(lens == dim)
                for lo in range(0, len(pick), 2048):
                    p = pick[lo:lo + 2048]
                    x = flat[at[p][:, None] + np.arange(dim)]
                    x = x / np.abs(x).max(1, keepdims=True)
                    x = x / np.sqrt((x * x).sum(1, keepdims=True))
                    c = codes(x, tables, hashes, probes, seed)
                    take = pa.array(p)
                    n = len(p)

                    def lists(a):
                        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.size // n, dtype=np.int32)), pa.array(a.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([reps.take(take), labels.take(take), sizes.take(take), pa.array(np.full(n, dim, np.int32)),
                                                      lists(x), lists(c.reshape(n, -1))], ["rep", "label", "size", "dim", "x", "codes"])

    width = 1 + probes
    coded = written(classes.select("rep", "label", "size", "v").mapInArrow(
        hashed, "rep long, label string, size long, dim int, x array<double>, codes array<long>"), "vector-codes")
    places = coded.select("rep", "label", "dim", F.posexplode("codes").alias("k", "bucket")).select(
        "rep", "label", "dim", F.floor(F.col("k") / width).cast("int").alias("t"), "bucket",
        (F.col("k") % width == 0).alias("home")).groupBy("rep", "label", "dim", "t", "bucket").agg(F.max("home").alias("home"))
    # A bucket is worth a visit if it holds two vectors and one is at home; its size sets its number of blocks.
    full = (places.groupBy("label", "dim", "t", "bucket").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("any"))
            .where("m > 1 and any").select("label", "dim", "t", "bucket", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    on = ["label", "dim", "t", "bucket"]
    parts = places.join(full, on).withColumn("mine", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int"))
    # Block pair (i, j), i <= j: a member of block b belongs to (b, j) for j >= b and to (i, b) for i < b.
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *on, F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine", "rep")
    work = parts.join(coded.select("rep", "size", "x", "codes", F.col("dim").alias("d2"), F.col("label").alias("l2")), "rep").where("d2 = dim and l2 = label")
    n_parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    work = work.select(*on, "bi", "bj", "mine", "rep", "size", "x", "codes").repartition(n_parts, *on, "bi", "bj").sortWithinPartitions(*on, "bi", "bj", "mine", "rep")

    def link(batches):
        def matrix(col, per):
            return np.asarray(col.flatten()).reshape(-1, per) if per else np.zeros((0, 0))

        def solve(t):
            if t.num_rows < 2:
                return None
            t = t.combine_chunks()
            mine = t["mine"].to_numpy()
            ids, size = t["rep"].to_numpy(), t["size"].to_numpy()
            x = matrix(t["x"].combine_chunks(), t["dim"][0].as_py())
            c = matrix(t["codes"].combine_chunks(), tables * width).reshape(-1, tables, width)
            bi, bj = t["bi"][0].as_py(), t["bj"][0].as_py()
            table, bucket = t["t"][0].as_py(), t["bucket"][0].as_py()
            a, b = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
            i, j, ai, aj = block_links(x[a], c[a], x[b], c[b], table, bucket, bi == bj, threshold)
            if len(ai) == 0:
                return None
            i, j, ai, aj = a[i], b[j], a[ai], b[aj]
            links = np.bincount(i, weights=size[j], minlength=len(ids)) + np.bincount(j, weights=size[i], minlength=len(ids))
            root = local_roots(ids, ai, aj)
            keep = (links > 0) | (root != ids)
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep].astype(np.int64)), pa.array(root[keep])],
                                              ["rep", "links", "root"])

        held, key = [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            cols = [t[c].combine_chunks() for c in (*on, "bi", "bj")]
            keys = list(zip(*(c.to_pylist() for c in cols)))
            start = 0
            for r in range(1, len(keys) + 1):
                if r == len(keys) or keys[r] != keys[start]:
                    if key != keys[start]:
                        if held and (out := solve(pa.concat_tables(held))) is not None:
                            yield out
                        held, key = [], keys[start]
                    held.append(t.slice(start, r - start))
                    start = r
        if held and (out := solve(pa.concat_tables(held))) is not None:
            yield out

    found = written(work.mapInArrow(link, "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = (classes.select("key", "rep", "size").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    good = rows.where("fine").select("key", "id").join(per_class, "key").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    bad = rows.where("not fine").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_crosspoly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links of all embeddings within a label at cosine 0.93."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Exact at any recall below 1 only where no pair is missed; the check pairs every row with every other of its label.
OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.y) AS component_id, e.vec_id = min(r.y) AS kept
FROM embeddings e JOIN r ON r.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id GROUP BY e.vec_id
"""
