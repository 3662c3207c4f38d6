"""Vector codes: a product quantiser with exact integer rounds over Hilbert-sorted flat blocks.

Components become integers floor(4096 x), vectors are cut into parts, each part position has a codebook. The parts of one
position are sorted along a Hilbert curve and cut into flat blocks; a block stores its points, the min/max box around
them and their sum. In every round the distances from a block's box to the codebook entries (nearest and farthest
possible) leave a shortlist: an entry whose nearest distance exceeds the smallest farthest distance can be nobody's
nearest. A block with one entry left counts with its stored sum, without its points; the others run a small exact
integer kernel over their shortlist only. All arithmetic is in integers (64-bit where no product can overflow, else
Python's), so results do not depend on the order of rows, blocks or tasks.

Every round is one pass over the written blocks; it returns sums per (part, entry, component), added by Spark as 32-bit
limbs, so what reaches the driver is the codebooks' size. Equal points (a third of all vectors may be one) share a curve
key; ranges are cut on (part, key, hash of the row), so such a group is spread over tasks.

Defined results: a vector that is null or holds a null, NaN or infinite component is dropped; shorter vectors are filled
with zeros to the longest, which is filled to a multiple of the parts; null ids are kept and come last; of rows that
share an id the smaller vector comes first; fewer rows than entries give smaller codebooks; a sum of errors beyond a
long is null; an empty table gives no rows. Columns besides the three named ones are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.functions.ordering import join_on
from tabflow.llm.common import checked_broadcast, col, written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
BLOCK = 256
#: Points of one part position that a task sorts and turns into blocks.
RANGE_POINTS = 1 << 20
KEY_BITS = 64


def to_ints(v: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * v) exactly; ``wide``: as Python integers."""
    if not wide:
        return np.floor(v * float(SCALE)).astype(np.int64)
    # From 2**52 on a double is an integer, and the product need not be a double.
    flat = [int(x) * SCALE if abs(x) >= 1 << 52 else math.floor(x * SCALE) for x in v.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(v.shape)


def pack(a: np.ndarray, wide: bool) -> bytes:
    return ",".join(map(str, a.ravel().tolist())).encode() if wide else np.ascontiguousarray(a, "<i8").tobytes()


def unpack(b: bytes, d: int, wide: bool) -> np.ndarray:
    if not wide:
        return np.frombuffer(b, "<i8").reshape(-1, d)
    flat = [int(x) for x in b.decode().split(",")]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(-1, d)


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of points (n, d) of ``bits``-bit coordinates, as bytes (n, ceil(bits d / 8)) that sort."""
    x = x.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the rotations and reflections of each cell, from large to small
        low = np.uint64((1 << b) - 1)
        for i in range(d):
            hi = (x[i] >> np.uint64(b)) & one
            swap = np.where(hi == 1, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hi == 1, low, swap)
            x[i] ^= swap
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> np.uint64(b)) & one == 1, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    rows = [((x[i] >> np.uint64(b)) & one).astype(np.uint8) for b in range(bits - 1, -1, -1) for i in range(d)]
    return np.packbits(np.stack(rows, axis=1), axis=1)


def shortlist(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Boolean (blocks, entries): the entries that may be nearest to a point of the box [lo, hi]."""
    lo, hi, c = lo[:, None, :], hi[:, None, :], book[None]
    near = np.maximum(np.maximum(lo - c, c - hi), 0)
    far = np.maximum(abs(c - lo), abs(hi - c))
    near, far = (near * near).sum(axis=2), (far * far).sum(axis=2)
    return near <= far.min(axis=1)[:, None]


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of few entries, ties to the lower index."""
    diff = points[:, None, :] - book[None]
    dist = (diff * diff).sum(axis=2)
    at = dist.argmin(axis=1)
    return at, dist[np.arange(len(points)), at]


def blocks_of(rows: DataFrame, d: int, parts: int, low: float, high: float, n: int, wide: bool) -> DataFrame:
    """The flat blocks (part, n, rows, points, lo, hi, sum) of all parts of ``rows`` (at, v), along the curve."""
    import pyarrow as pa
    bits = max(1, min(8, KEY_BITS // d))
    cells, span = 1 << bits, (high - low) or 1.0

    def cut(batches):
        for b in batches:
            v = np.zeros((b.num_rows, parts * d))
            lists = b.column(1)
            size = np.asarray(lists.value_lengths())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(size) - size
            v[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(start, size)] = flat
            for p in range(parts):
                x = v[:, p * d:(p + 1) * d]
                cell = np.clip(np.floor((x / span - low / span) * cells), 0, cells - 1)
                key, ints = hilbert_keys(cell, bits), to_ints(x, wide)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, np.int32)), pa.array([k.tobytes() for k in key], pa.binary()), b.column(0),
                     pa.array([pack(i, wide) for i in ints], pa.binary())], ["part", "key", "at", "c"])

    def gather(batches):
        for b in batches:
            part, at = b.column(0).to_numpy(), b.column(2).to_numpy()
            c = b.column(3).to_pylist()
            edge = np.append(np.flatnonzero(np.diff(part)) + 1, len(part)).tolist()
            out, i = [], 0
            for e in edge:
                while i < e:
                    j = min(i + BLOCK, e)
                    pts = unpack((b"," if wide else b"").join(c[i:j]), d, wide)
                    out.append((int(part[i]), j - i, at[i:j].astype("<i8").tobytes(), pack(pts, wide), pack(pts.min(axis=0), wide),
                                pack(pts.max(axis=0), wide), pack(pts.sum(axis=0), wide)))
                    i = j
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 5))],
                                                 ["part", "n", "rows", "points", "lo", "hi", "sum"])

    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-n * parts // RANGE_POINTS))
    order = ["part", "key", F.xxhash64("at")]
    sorted_parts = (rows.select("at", "v").mapInArrow(cut, "part int, key binary, at long, c binary")
                    .repartitionByRange(ranges, *order).sortWithinPartitions(*order))
    return sorted_parts.mapInArrow(gather, "part int, n int, rows binary, points binary, lo binary, hi binary, sum binary")


def by_part(batch, d: int, wide: bool):
    """(part, indices, boxes) of the blocks of a batch."""
    part = batch.column("part").to_numpy()
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        lo, hi, total = (unpack((b"," if wide else b"").join(batch.column(c).take(at_index(at)).to_pylist()), d, wide) for c in ("lo", "hi", "sum"))
        yield int(p), at, lo, hi, total


def at_index(at: np.ndarray):
    import pyarrow as pa
    return pa.array(at)


def round_sums(blocks: DataFrame, books: list, d: int, wide: bool) -> list:
    """Per part the (counts, sums) of the points nearest to every entry."""
    import pyarrow as pa
    entries = len(books[0])

    def run(batches):
        acc = np.zeros((len(books), entries, d + 1), object if wide else np.int64)
        for b in batches:
            size = b.column("n").to_numpy()
            for p, at, lo, hi, total in by_part(b, d, wide):
                short = shortlist(lo, hi, books[p])
                sole = short.sum(axis=1) == 1
                if sole.any():  # whole blocks: no point is looked at
                    e = short[sole].argmax(axis=1)
                    np.add.at(acc[p], e, np.concatenate([total[sole], size[at[sole]].astype(acc.dtype)[:, None]], axis=1))
                for i in np.flatnonzero(~sole):
                    few = np.flatnonzero(short[i])
                    pts = unpack(b.column("points")[int(at[i])].as_py(), d, wide)
                    e = few[nearest(pts, books[p][few])[0]]
                    np.add.at(acc[p, :, :d], e, pts)
                    acc[p, :, d] += np.bincount(e, minlength=entries)
        rows = [(p, e, j, k, (int(x) >> (32 * k)) if k == top - 1 else (int(x) >> (32 * k)) & 0xFFFFFFFF)
                for (p, e, j), x in np.ndenumerate(acc) if x != 0 for top in [abs(int(x)).bit_length() // 32 + 1] for k in range(top)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] * 4 + [pa.int64()])],
                                             ["part", "entry", "at", "limb", "value"])

    limbs = blocks.mapInArrow(run, "part int, entry int, at int, limb int, value long")
    out = np.zeros((len(books), entries, d + 1), object)
    for r in limbs.groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect():  # the codebooks' size
        out[r["part"], r["entry"], r["at"]] += r["value"] << (32 * r["limb"])
    return out


def assigned(blocks: DataFrame, books: list, d: int, wide: bool) -> DataFrame:
    """(at, part, entry, error) of every point under ``books``; an error beyond a long is null."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for p, at, lo, hi, _ in by_part(b, d, wide):
                short = shortlist(lo, hi, books[p])
                for i, s in zip(at.tolist(), short):
                    few = np.flatnonzero(s)
                    e, err = nearest(unpack(b.column("points")[i].as_py(), d, wide), books[p][few])
                    rows = np.frombuffer(b.column("rows")[i].as_py(), "<i8")
                    err = [x if x < 1 << 63 else None for x in err.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), p, np.int32)),
                                                      pa.array(few[e].astype(np.int32)), pa.array(err, pa.int64())], ["at", "part", "entry", "error"])

    return blocks.mapInArrow(run, "at long, part int, entry int, error long")


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    if not 1 <= entries <= 256 or not 1 <= parts <= 8:
        raise ValueError("1 to 256 entries and 1 to 8 parts")
    spark, v = vectors.sparkSession, col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    rows = vectors.where(v.isNotNull() & finite).select(F.monotonically_increasing_id().alias("at"), col(id_col).cast("long").alias("vec_id"),
                                                        col(label_col).alias("label"), v.alias("v"))
    rows = written(rows, "pq-rows")
    n, longest, low, high = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not n:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    low, high = low or 0.0, high or 0.0
    low, high = min(low, 0.0), max(high, 0.0)
    d = max(1, -(-longest // parts))
    # No squared distance of a part reaches 2**62 below this bound.
    wide = max(-low, high) * SCALE + 1 >= math.sqrt((1 << 62) / (4 * d))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((len(first), parts * d))
    for i, r in enumerate(first):
        start[i, :len(r["v"])] = r["v"]
    ints = to_ints(start, wide)
    books = [ints[:, p * d:(p + 1) * d].copy() for p in range(parts)]
    blocks = written(blocks_of(rows, d, parts, low, high, n, wide), "pq-blocks")
    for _ in range(rounds):
        sums = round_sums(blocks, books, d, wide)
        for p in range(parts):
            for e in np.flatnonzero(sums[p, :, d] > 0):
                books[p][e] = [int(s) // int(sums[p, e, d]) for s in sums[p, e, :d]]
    text = ",".join(str(int(x)) for book in books for x in book.ravel())
    digest = hashlib.sha256(text.encode()).hexdigest()

    place = F.expr(f"shiftleft(cast(entry as bigint), 8 * ({parts - 1} - part))")
    codes = assigned(blocks, books, d, wide).groupBy("at").agg(
        F.lower(F.lpad(F.hex(F.sum(place)), 2 * parts, "0")).alias("code"),
        F.when(F.count("error") == parts, F.try_sum("error")).alias("error"))
    out = written(rows.select("at", "vec_id", "label").join(codes, "at").drop("at"), "pq-codes")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error")
    per_label = checked_broadcast(written(out.groupBy("label").agg(total), "pq-labels"))
    return join_on(out, per_label, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_hilbertpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 8 parts, 16 entries, 6 rounds."""
    return quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    out = ["""WITH k AS MATERIALIZED (SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(e) // 8) AS part, (i - 1) % (len(e) // 8) AS j, CAST(floor(4096 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS c
  FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM k)),
b0 AS MATERIALIZED (SELECT part, entry, j, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 16) USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM
  (SELECT vec_id, x.part, entry, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{r} b ON b.part = x.part AND b.j = x.j GROUP BY ALL) GROUP BY ALL)""")
        if r < ROUNDS:
            out.append(f"""n{r} AS (SELECT part, entry, j, CAST(sum(c) AS BIGINT) AS s, count(*) AS m FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, j, CASE WHEN m IS NULL THEN c ELSE (s - ((s % m) + m) % m) // m END AS c FROM b{r} LEFT JOIN n{r} USING (part, entry, j))""")
    return ",\n".join(out) + f"""
, v AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, j)) FROM b{ROUNDS}) AS codebooks_sha256 FROM v JOIN k USING (vec_id)
"""


OP13_SQL = _sql()
