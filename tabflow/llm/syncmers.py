"""Document fingerprints from closed syncmers, matched by position.

A k-mer of code points is an anchor if the smallest of its s-mers (by hash) is its first or its last one: a property
of the k-mer alone, so an edit moves no anchor that it does not touch, and every text of some length has anchors in
each window of ``K - S`` characters. A fingerprint keeps one in ``SHARE`` anchors (those whose hashes are below a fixed
bound), but the ``ANCHORS`` with the smallest hashes at least, and where each first occurs; so anchors grow with the
text. Short texts have few anchors of K characters: below the lengths of ``LEVELS`` a fingerprint also has the anchors
of shorter k-mers, and two fingerprints are compared at the shortest k that both have (the lengths of the texts alone
decide). The likeness is the length of the longest run of common anchors that come in the same order in both, over the
number of anchors compared (all of either below the bound up to which both are complete).

Defined results: a text without anchors (of less than two characters, or null, which is the empty text) has one hash of the whole
text as its fingerprint, and is like another only if that is equal; equal texts have equal fingerprints and likeness
1; rows that share an id are ordered by a hash of their text, null ids come last; a single row is its own next; an
empty table gives no rows. Columns besides the two named ones are not read, whatever they are called.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.common import col, documents
from tabflow.llm.textvec import mix, powers, rolling

K, S = 20, 10
ANCHORS, SHARE = 48, 5
#: (k, s, code points below which a text has this level); every text has the first.
LEVELS = ((K, S, 1 << 62), (8, 4, 192), (4, 2, 48), (2, 1, 16))
BOUND = (1 << 32) // SHARE
WHOLE = 255
SLICE_CHARS = 1 << 20


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    offs = np.cumsum([0] + [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offs


def anchors(codes: np.ndarray, offs: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of every row, in order; positions count from the slice's start."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pre = rolling(codes)
    _, inv = powers(n + 1)
    small = mix((pre[s:] - pre[:-s]) * inv[:n - s + 1])
    w = k - s + 1
    low, have = small, 1
    while 2 * have <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[:len(low) - (w - have)], low[w - have:])
    count = n - k + 1
    edge = (small[:count] == low[:count]) | (small[w - 1:w - 1 + count] == low[:count])
    ends = np.repeat(offs[1:], np.diff(offs))[:count]
    at = np.flatnonzero(edge & (np.arange(k, k + count) <= ends))
    return at, mix((pre[at + k] - pre[at]) * inv[at] + np.uint64(k))


def packed(hashes: np.ndarray, places: np.ndarray) -> bytes:
    """Count, hashes in order of place, and the steps between places at 7 bits a byte (the last byte has the top bit)."""
    step = np.diff(places, prepend=0).astype(np.int64)
    size = 1 + sum((step >> (7 * j) > 0).astype(np.int64) for j in range(1, 5))
    j = np.arange(5)
    parts = (step[:, None] >> (7 * j)) & 127 | np.where(j == size[:, None] - 1, 128, 0)
    return len(hashes).to_bytes(4, "big") + hashes.astype(">u4").tobytes() + parts[j < size[:, None]].astype(np.uint8).tobytes()


def unpacked(print_: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{level: (hashes, places)} of a fingerprint."""
    out, at = {}, 0
    raw = np.frombuffer(print_, np.uint8)
    while at < len(print_) and print_[at] != WHOLE:
        level, n = print_[at], int.from_bytes(print_[at + 1:at + 5], "big")
        at += 5
        hashes = np.frombuffer(print_, ">u4", n, at).astype(np.int64)
        at += 4 * n
        rest = raw[at:at + 5 * n].astype(np.int64)
        last = np.flatnonzero(rest >= 128)[:n]
        first = np.concatenate([[0], last[:-1] + 1])
        rest = rest[:last[-1] + 1]
        rest = (rest & 127) << (7 * (np.arange(len(rest)) - np.repeat(first, last - first + 1)))
        out[level] = hashes, np.cumsum(np.add.reduceat(rest, first))
        at += int(last[-1]) + 1
    return out


def fingerprints(texts: list[str], m: int = ANCHORS) -> list[bytes]:
    """Per text and level its number, and the anchors (upper half of the hash, place) by place."""
    out = [b""] * len(texts)
    for level, (k, s, below) in enumerate(LEVELS):
        some = [i for i, t in enumerate(texts) if k <= len(t) < below]
        codes, offs = codes_of([texts[i] for i in some])
        at, h = anchors(codes, offs, k, s)
        cut = np.searchsorted(at, offs)
        for r, i in enumerate(some):
            a, b = cut[r], cut[r + 1]
            if b > a:
                seen, where = np.unique(h[a:b] >> np.uint64(32), return_index=True)
                keep = max(m, int(np.searchsorted(seen, BOUND)))
                order = np.argsort(where[:keep])
                out[i] += bytes([level]) + packed(seen[order], at[a:b][where[order]] - offs[r])
    return [p or bytes([WHOLE]) + hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=4).digest() for p, t in zip(out, texts)]


def complete_to(hashes: np.ndarray, m: int) -> int:
    """The hash up to which a fingerprint has all anchors of its text."""
    return 1 << 32 if len(hashes) < m else max(BOUND - 1, int(hashes.max()))


def likeness(a: bytes, b: bytes, m: int = ANCHORS) -> float:
    """0 to 1; symmetric."""
    if a == b:
        return 1.0
    x, y = unpacked(a), unpacked(b)
    levels = x.keys() & y.keys()
    if not levels:
        return 0.0
    (hx, px), (hy, py) = x[max(levels)], y[max(levels)]
    upto = min(complete_to(hx, m), complete_to(hy, m))
    px, hx, py, hy = px[hx <= upto], hx[hx <= upto], py[hy <= upto], hy[hy <= upto]
    _, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(ix):
        return 0.0
    tails = []  # longest strictly increasing run of places in b, in the order of a
    for p in py[iy[np.argsort(px[ix])]].tolist():
        i = bisect.bisect_left(tails, p)
        tails[i:i + 1] = [p]
    return len(tails) / (len(hx) + len(hy) - len(ix))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, halo, doc_id, text) dealt by id range, each range followed by the first row of the next one.

    Ranges are cut at quantiles of the ids; only the cuts and the largest id per range (one row a range) reach the
    driver, and only one row a range is dealt twice."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ", ".join(f"{i / (2 * parts)!r}D" for i in range(1, 2 * parts))
    cuts = rows.select(F.expr(f"percentile_approx(doc_id, array({at}), 20000)")).first()[0] or []
    cuts = sorted(set(cuts))
    listed = f"array({', '.join(f'{c}L' for c in cuts)})" if cuts else "CAST(array() AS array<bigint>)"
    bucket = F.expr(f"CASE WHEN doc_id IS NULL THEN -1 ELSE size(filter({listed}, c -> c <= doc_id)) END").cast("int")
    rows = rows.withColumn("bucket", bucket)
    tops = sorted(rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect(), key=lambda r: -r["bucket"])  # one row per range
    after = {r["bucket"]: tops[i - 1]["bucket"] for i, r in enumerate(tops)}  # the range that a range's first row follows
    if not tops:
        return rows.select("bucket", F.lit(0).alias("halo"), "doc_id", "text", F.xxhash64("text").alias("tie"))
    first = F.create_map(*(x for r in tops for x in (F.lit(r["bucket"]), F.lit(r["top"]).cast("long"))))
    goes = F.create_map(*(F.lit(x) for k in after.items() for x in k))
    is_top = first[F.col("bucket")].eqNullSafe(F.col("doc_id"))
    to = F.array_compact(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("halo")),
                                 F.when(is_top, F.struct(goes[F.col("bucket")].alias("bucket"), F.lit(1).alias("halo")))))
    return rows.withColumn("to", F.explode(to)).select("to.bucket", "to.halo", "doc_id", "text", F.xxhash64("text").alias("tie"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third of code points replaced by the start of the
    next document's), with both likenesses; the next document is the one before in id order, cyclically."""
    import pyarrow as pa
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def solve(ids, texts):
        """Rows of all texts but the last, which is only the last one's next."""
        edited = []
        for t, nxt in zip(texts, texts[1:]):
            q = len(t) // 3
            edited.append(t[:len(t) - q] + nxt[:q])
        own, changed = fingerprints(texts), fingerprints(edited)
        cols = [ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                [base64.b64encode(f).decode() for f in own[:-1]], [base64.b64encode(f).decode() for f in changed],
                [likeness(a, b) for a, b in zip(own, changed)], [likeness(a, b) for a, b in zip(own, own[1:])]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches):
        ids, texts, size, now, done = [], [], 0, None, False
        for b in batches:
            for bucket, halo, i, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                if bucket != now:
                    if len(texts) > 1:
                        yield solve(ids, texts)
                    ids, texts, size, now, done = [], [], 0, bucket, False
                if done:  # of several rows with the range's largest id, the first is the next document
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                done = bool(halo)
                if size > SLICE_CHARS and len(texts) > 1:
                    yield solve(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
                    size = len(texts[0])
        if len(texts) > 1:
            yield solve(ids, texts)

    rows = with_next(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "bucket").sortWithinPartitions(F.col("bucket"), F.col("halo"), F.col("doc_id").desc_nulls_last(), F.col("tie"))
            .select("bucket", "halo", "doc_id", "text")
            .mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                             "near_edited double, near_next double"))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(documents(spark, sf_dir))
