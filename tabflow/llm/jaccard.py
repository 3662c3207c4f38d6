"""Exact Jaccard self-join on word shingles with vertical partitioning.

Every document is the set of its distinct k-word shingles (64-bit hashes). The global n-gram order is the order of
the hashes; it is cut into ``FRAGMENTS`` equal ranges. Documents with equal sets form a class and only one set per
class is joined. Four steps, each without any pair of documents that only share a frequent passage:

1. *Screen.* In the lowest fragments alone, n-grams that one class has for itself are counted. A class with more
   such n-grams than a partner at the threshold could miss has no partner and leaves. (Exact: only impossible
   classes leave, whatever the sample of the order holds.)
2. *Frequencies.* For the classes left, n-grams of one class only are dropped and the rest ranked rarest first;
   again a class with too many n-grams of its own leaves.
3. *Candidates.* Two sets at the threshold share one of their first ``n - need + 1`` n-grams in that ranking. In
   each such bucket the classes are first compared with one pivot, the class with the least share of n-grams of its
   own (in a group of near copies: the least edited), and the links found are merged into components. Then only
   classes of different components are compared, if their shared n-grams could suffice and the parity sketches of
   the two sets differ in no more bits than the sets may. A group of near copies so costs its size, not its square,
   and no link between different components is missed.
4. *Counts.* The overlap of a candidate pair is counted separately in each fragment and summed per pair.

Defined results: texts without words (and nulls) have an empty set and link with nothing; every row is a node of
its own, so repeated rows link and rows that share an id but not a text need not; a row with a null id is returned
with a null component and links with nothing; an empty table gives no rows. Only the id and text columns are read, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.llm.common import checked_broadcast, col, components, documents, written
from tabflow.llm.textvec import mix, shingle_sets, slices, utf8

K_WORDS = 5
#: Threshold as a fraction: 100 * |intersection| >= 75 * |union|.
NUM, DEN = 75, 100
#: Cuts of the global order, and how many of the lowest ones the screen reads.
FRAGMENTS, SCREEN = 16, 5
#: Fragments in which overlaps are counted, as a power of two.
COUNT_BITS = 2
#: 64-bit words of a set's parity sketch: bit i tells whether an odd number of its n-grams fall on i, so two sketches
#: differ in at most as many bits as the sets differ in n-grams.
SKETCH = 16


def class_hash(tokens: np.ndarray) -> np.int64:
    """Order-free 64-bit identity of a set from two independent sums over its members and its size."""
    one = mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    two = mix(tokens + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    both = np.array([one, two, np.uint64(len(tokens))], np.uint64)
    return mix(mix(mix(both[:1]) + both[1:2]) + both[2:])[0].astype(np.int64)


def set_rows(docs: DataFrame, k: int, want: str) -> DataFrame:
    """``meta``: (doc_id, n, cls); ``low``: (cls, toks of the screened fragments); ``full``: (cls, n, toks, sketch)."""
    import pyarrow as pa
    limit = np.uint64((SCREEN << 64) // FRAGMENTS)
    top = np.uint64(64 - (64 * SKETCH - 1).bit_length())

    def run(batches):
        for b in batches:
            ids = b.column(0)
            data, offs = utf8(b.column(1))
            for i, j, d, o in slices(data, offs):
                sets = shingle_sets(d, o, k)
                n = pa.array([len(s) for s in sets], pa.int64())
                cls = pa.array(np.array([class_hash(s) for s in sets], np.int64))
                if want == "meta":
                    yield pa.RecordBatch.from_arrays([ids[i:j], n, cls], ["doc_id", "n", "cls"])
                    continue
                if want == "low":
                    sets = [s[:np.searchsorted(s, limit)] for s in sets]
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                if want == "low":
                    yield pa.RecordBatch.from_arrays([cls, toks], ["cls", "toks"])
                    continue
                bits = np.array([np.packbits(np.bincount((t >> top).astype(np.int64), minlength=64 * SKETCH) & 1) for t in sets]).reshape(-1)
                marks = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH)
                sketch = pa.ListArray.from_arrays(marks, pa.array(bits.view(np.int64) if len(bits) else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([cls, n, toks, sketch], ["cls", "n", "toks", "sketch"])

    out = {"meta": "doc_id long, n long, cls long", "low": "cls long, toks array<long>",
           "full": "cls long, n long, toks array<long>, sketch array<long>"}[want]
    return docs.mapInArrow(run, out)


def need(n, num: int, den: int):
    """Least overlap of a set of ``n`` with any partner: ceil(n * num / den)."""
    return F.floor((n * num + (den - 1)) / den).cast("long")


def verified(cand: DataFrame, segs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the candidates (a, na, b, nb) that reach the threshold: overlaps per fragment, summed per pair."""
    left = segs.select(F.col("cls").alias("a"), "frag", F.col("seg").alias("seg_a"))
    right = segs.select(F.col("cls").alias("b"), "frag", F.col("seg").alias("seg_b"))
    part = (cand.join(left, "a").join(right, ["b", "frag"])
            .select("a", "b", "na", "nb", F.size(F.array_intersect("seg_a", "seg_b")).cast("long").alias("part")))
    pairs = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return pairs.where(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b")


def class_links(docs: DataFrame, meta: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, root) for every class with a link: the smallest class it can reach."""
    classes = meta.where("doc_id is not null and n > 0").groupBy("cls").agg(F.max("n").alias("n"), F.min("doc_id").alias("rep"))
    named = docs.where("doc_id is not null")
    low = set_rows(named, k, "low").select("cls", F.explode("toks").alias("tok"))
    own = low.groupBy("tok").agg(F.min("cls").alias("cls"), F.max("cls").alias("other")).where("cls = other")
    own = own.groupBy("cls").agg(F.count(F.lit(1)).alias("own"))
    left = classes.join(own, "cls", "left").where(F.coalesce("own", F.lit(0)) <= F.col("n") - need(F.col("n"), num, den))
    left = written(left.select("cls", "rep"), "jaccard-left")

    reps = checked_broadcast(left.select(F.col("rep").alias("doc_id")))
    full = written(set_rows(named.join(reps, "doc_id", "left_semi"), k, "full"), "jaccard-sets")
    toks = full.select("cls", "n", F.explode("toks").alias("tok"))
    freq = toks.groupBy("tok").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("df"))
    shared = toks.join(freq.where("lo < hi").select("tok", "df"), "tok")
    by_class = Window.partitionBy("cls")
    ranked = (shared.withColumn("s", F.count(F.lit(1)).over(by_class))
              .withColumn("rank", F.row_number().over(by_class.orderBy("df", "tok")))
              .withColumn("need", need(F.col("n"), num, den)).where("s >= need"))
    ranked = written(ranked.select("cls", "n", "s", "tok", (F.col("rank") <= F.col("s") - F.col("need") + 1).alias("first")),
                     "jaccard-ranked")
    segs = written(ranked.groupBy("cls", F.shiftrightunsigned("tok", 64 - COUNT_BITS).alias("frag"))
                   .agg(F.collect_set("tok").alias("seg")), "jaccard-segments")
    prefix = written(ranked.where("first").select("cls", "n", "s", "tok").distinct(), "jaccard-prefix")
    sketches = full.select("cls", *(F.col("sketch")[i].alias(f"k{i}") for i in range(SKETCH))).dropDuplicates(["cls"])

    def pairs(df):
        """(a, na, b, nb), a < b, of rows (cls, n, o, no)."""
        up = F.col("cls") < F.col("o")
        return df.select(F.least("cls", "o").alias("a"), F.when(up, F.col("n")).otherwise(F.col("no")).alias("na"),
                         F.greatest("cls", "o").alias("b"), F.when(up, F.col("no")).otherwise(F.col("n")).alias("nb")).distinct()

    def could_link(s1, n1, s2, n2):
        """All shared n-grams of the poorer of two rows would reach the threshold."""
        most = F.least(s1, s2)
        return most * den >= (F.col(n1) + F.col(n2) - most) * num

    # Turn 1: every class of a bucket against the bucket's pivot.
    hub = prefix.groupBy("tok").agg(F.count(F.lit(1)).alias("m"), F.max_by(F.struct("cls", "n", "s"), F.struct(F.col("s") / F.col("n"), "cls")).alias("hub")).where("m > 1")
    hub = hub.select("tok", F.col("hub.cls").alias("o"), F.col("hub.n").alias("no"), F.col("hub.s").alias("so"))
    both = prefix.join(hub, "tok")
    both = both.where((F.col("cls") != F.col("o")) & could_link("s", "n", "so", "no"))
    cand = written(pairs(both), "jaccard-candidates")
    links = written(verified(cand, segs, num, den), "jaccard-links")
    comp = components(links)

    # Turn 2: classes of different components in a bucket, filtered inside the join.
    p = prefix.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    open_ = p.groupBy("tok").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("n").alias("least")).where("r0 < r1").select("tok", "least")
    p = p.join(open_, "tok").where(F.floor(F.col("s") * (num + den) / num) - F.col("n") >= F.col("least"))
    p = written(p.drop("least").join(sketches, "cls"), "jaccard-open")
    other = p.select("tok", *(F.col(c).alias(f"o_{c}") for c in p.columns if c != "tok"))
    differ = sum((F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"o_k{i}"))) for i in range(SKETCH)), F.lit(0))
    n2 = F.col("n") + F.col("o_n")
    # overlap o: differ <= n + n' - 2 o and den * o >= num * (n + n' - o)
    both = p.join(other, "tok").where((F.col("cls") < F.col("o_cls")) & (F.col("root") != F.col("o_root")) & could_link("s", "n", "o_s", "o_n")
                                      & ((n2 - differ) * (num + den) >= n2 * (2 * num)))
    cand = pairs(both.select("cls", "n", F.col("o_cls").alias("o"), F.col("o_n").alias("no")))
    cand = written(cand.join(links, ["a", "b"], "left_anti"), "jaccard-candidates")
    more = written(verified(cand, segs, num, den), "jaccard-links")
    return comp if more.isEmpty() else components(links.union(more))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_WORDS,
                       num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    base = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    meta = written(set_rows(base, k, "meta"), "jaccard-meta")
    comp = class_links(base, meta, k, num, den)
    linked = meta.where("doc_id is not null and n > 0").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    linked = linked.withColumn("root", F.coalesce("root", "cls"))
    smallest = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    some = linked.join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = meta.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"),
                                                        F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    return some.unionByName(rest)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 5-word shingles and a similarity of 0.75 or more."""
    return jaccard_components(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""
