"""Removal of long repeated word spans by a sparse de Bruijn graph of word k-mers.

A window is ``length`` consecutive words. A word goes if it lies in a window whose words also start in a document with a
smaller id; windows are judged on the input.

1. *Nodes and edges.* The node of a window is the k-mer with the smallest hash in it (``length // 3`` words). Runs of
   windows with the same node at the same place are an edge: the word sequence from the first word of the run to the last
   (``length`` to ``2 length - k`` words). Equal windows have equal nodes, so a window can only repeat if its node does;
   edges are about one in eighteen words, and the only rows that are shuffled for all documents are (node, id).
2. *Compaction.* Edges of repeated nodes join the table of repeated edges, which holds the place of each edge's first
   occurrence. Consecutive edges of a document that repeat along one source document at one offset are a nonbranching
   path and compact to one span.
3. *Branches.* Where an edge is the first of its kind but its node also starts another first edge, two documents part
   ways inside the edge. Only there single windows are emitted and joined in the same way. That suffices: of all
   occurrences of a window the one with the smallest id never lies in an edge that repeats an earlier one.
4. *Verification.* For every span the words at its own place and at its source coordinates are read again and compared by
   SHA-256; a span that differs is not removed.

Edges and windows are keyed by two 64-bit hashes. Every key is aggregated on the map side; the joins back have one row a key on
the other side, so that adaptive execution can split a hot key. Only the lists of places per document are broadcast, and
only up to a measured size; beyond it they are shuffled with the texts.

Defined results: a null text has no words; decisions are taken per (id, text), so repeated rows fare alike; rows with one
id but different texts are not smaller than each other; a null id counts as the largest long; an empty table gives no
rows. All columns of the input are kept, whatever they are called; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window as W

from tabflow.llm.common import col, documents, free_name, sized_broadcast, written
from tabflow.llm.textvec import mix, rolling, row_bounds, slices, span_hash, utf8, words

LENGTH = 50
SECOND = np.uint64(0xD6E8FEB86659FD93)
LAST = (1 << 63) - 1


def slice_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(index of every row's first word, two prefix hashes of the words) of a slice of texts."""
    s, e = words(data, offs)
    h = span_hash(rolling(data), s, e)
    return row_bounds(s, offs), [rolling(h), rolling(mix(h ^ SECOND))]


def edges_of(first: np.ndarray, pre: list[np.ndarray], length: int, k: int) -> tuple:
    """(row, first window, last window, node, two hashes) of the edges of a slice; windows count within the row."""
    n = len(pre[0]) - 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at = np.arange(n - k + 1)
    least = node = span_hash(pre[0], at, at + k)
    span = length - k + 1
    step = 1
    while step * 2 <= span:  # minima over 2, 4, 8... k-mers, then over the rest by an overlap
        take = least[step:] < least[:-step]
        least, at = np.where(take, least[step:], least[:-step]), np.where(take, at[step:], at[:-step])
        step *= 2
    if span > step:
        off = span - step
        at = np.where(least[off:] < least[:-off], at[off:], at[:-off])
    row = np.searchsorted(first, np.arange(len(at)), "right") - 1
    whole = np.flatnonzero(np.arange(len(at)) + length <= first[row + 1])
    if not len(whole):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    cut = np.flatnonzero((np.diff(at[whole]) != 0) | (np.diff(whole) != 1)) + 1
    p, q = whole[np.append(0, cut)], whole[np.append(cut, len(whole)) - 1]
    r = row[p]
    return (r, p - first[r], q - first[r], node[at[p]].view(np.int64), *(span_hash(h, p, q + length).view(np.int64) for h in pre))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ord, th, text): the order and the text's hash tell documents apart."""
    text = col(text_col).cast("string")
    return docs.where(text.isNotNull()).select(F.coalesce(col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))


def edge_rows(texts: DataFrame, length: int, k: int) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(2))
            for i, _, part, po in slices(data, offs):
                first, pre = slice_words(part, po)
                r, p, q, *keys = edges_of(first, pre, length, k)
                if len(r):
                    own = pa.array(r + i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(p.astype(np.int32)),
                                                      pa.array(q.astype(np.int32)), *map(pa.array, keys)], ["ord", "th", "p", "q", "node", "h1", "h2"])

    return texts.mapInArrow(run, "ord long, th long, p int, q int, node long, h1 long, h2 long")


def window_rows(texts: DataFrame, length: int) -> DataFrame:
    """(ord, th, p, h1, h2) of the windows in ``ranges`` (first, last, first, last...) of every text."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(2))
            lists = b.column(3)
            size = np.asarray(lists.value_lengths()) // 2
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            start = np.append(0, np.cumsum(size))
            for i, j, part, po in slices(data, offs):
                first, pre = slice_words(part, po)
                lo, hi = flat[start[i]:start[j], 0].astype(np.int64), flat[start[i]:start[j], 1].astype(np.int64)
                row = np.repeat(np.arange(j - i), size[i:j])
                m = hi - lo + 1
                r = np.repeat(row, m)
                p = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
                g = first[r] + p
                if len(r):
                    own = pa.array(r + i)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(own), b.column(1).take(own), pa.array(p.astype(np.int32)),
                         *(pa.array(span_hash(h, g, g + length).view(np.int64)) for h in pre)], ["ord", "th", "p", "h1", "h2"])

    return texts.mapInArrow(run, "ord long, th long, p int, h1 long, h2 long")


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (ord, th, p, h1, h2, ...) with ``src``, the place (ord, th, p) of the first row with the same hashes, where that
    has a smaller ord; otherwise null."""
    met = rows.groupBy("h1", "h2").agg(F.min(F.struct("ord", "th", "p")).alias("src"), F.max("ord").alias("top")).where("src.ord < top")
    met = written(met.drop("top"), "span-firsts").hint("merge")  # grows with the corpus: never broadcast
    src = F.when(F.col("src.ord") < F.col("ord"), F.col("src"))
    return rows.join(met, ["h1", "h2"], "left").withColumn("src", src)


def of_shared_nodes(edges: DataFrame) -> DataFrame:
    """The edges whose node occurs under two ids."""
    nodes = edges.groupBy("node").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("node")
    return edges.join(written(nodes, "span-nodes").hint("merge"), "node", "left_semi")


def with_lists(texts: DataFrame, places: DataFrame, name: str, how: str) -> DataFrame:
    """``texts`` with the list ``name`` of ``places`` (ord, th, name), by broadcast where that is small."""
    places = written(places, f"span-{name}")
    return texts.join(sized_broadcast(places, F.size(name) * 4 + 48), ["ord", "th"], how)


def flat_list(a: str, b: str):
    """The distinct pairs (a, b) of a group in order, as one flat list."""
    return F.flatten(F.transform(F.array_sort(F.collect_set(F.struct(F.col(a).alias("a"), F.col(b).alias("b")))), lambda x: F.array(x["a"], x["b"])))


def paths(found: DataFrame, length: int) -> DataFrame:
    """(ord, th, start, end, src_ord, src_th, src_start): runs of ``found`` (ord, th, p, q, src) along one source and offset."""
    at = found.select("ord", "th", "p", (F.col("q") + length).alias("e"), F.col("src.ord").alias("so"), F.col("src.th").alias("st"),
                      (F.col("src.p") - F.col("p")).alias("off")).distinct()
    w = W.partitionBy("ord", "th", "so", "st", "off").orderBy("p", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("p") <= reach, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    keys = ["ord", "th", "so", "st", "off"]
    return (at.withColumn("run", run).groupBy(*keys, "run").agg(F.min("p").alias("start"), F.max("e").alias("end"))
            .select("ord", "th", "start", "end", F.col("so").alias("src_ord"), F.col("st").alias("src_th"), (F.col("start") + F.col("off")).alias("src_start")))


def digests(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(ord, th, start, end, digest): SHA-256 of the words of every asked span (ord, th, start, end), joined by one space."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for o, t, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                w = text.as_buffer().to_pybytes().split()
                out = [(o, t, s, e, hashlib.sha256(b" ".join(w[s:e])).digest()) for s, e in zip(spans[::2], spans[1::2])]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                                 ["ord", "th", "start", "end", "digest"])

    lists = asked.groupBy("ord", "th").agg(flat_list("start", "end").alias("asked"))
    rows = with_lists(texts, lists, "asked", "inner").select("ord", "th", "text", "asked")
    return rows.mapInArrow(run, "ord long, th long, start int, end int, digest binary")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(ord, th, start, end, src_ord, src_th, src_start): all verified spans of words that repeat a document with a smaller
    id, in words; ord is the id (null: the largest long), th the ``xxhash64`` of the text."""
    if length < 3:
        raise ValueError("length must be 3 or more")
    texts = keyed(docs, id_col, text_col)
    edges = written(edge_rows(texts, length, length // 3), "span-edges")
    marked = written(repeats(of_shared_nodes(edges)), "span-marked")
    # Branches: first edges whose node starts another document's first edge.
    open_ = of_shared_nodes(marked.where("src is null").select("ord", "th", "p", "q", "node"))
    ranges = open_.groupBy("ord", "th").agg(flat_list("p", "q").alias("ranges"))
    single = window_rows(with_lists(texts, ranges, "ranges", "inner").select("ord", "th", "text", "ranges"), length)
    single = repeats(written(single, "span-windows")).where("src is not null")
    found = marked.where("src is not null").select("ord", "th", "p", "q", "src").union(single.select("ord", "th", "p", F.col("p").alias("q"), "src"))
    spans = written(paths(found, length), "span-paths")

    source = spans.select(F.col("src_ord").alias("ord"), F.col("src_th").alias("th"), F.col("src_start").alias("start"),
                          (F.col("src_start") + F.col("end") - F.col("start")).alias("end"))
    seen = written(digests(texts, spans.select("ord", "th", "start", "end").union(source).distinct()).distinct(), "span-digests")
    own = seen.withColumnRenamed("digest", "d1")
    theirs = seen.select(F.col("ord").alias("src_ord"), F.col("th").alias("src_th"), F.col("start").alias("src_start"), F.col("end").alias("src_end"),
                         F.col("digest").alias("d2"))
    both = (spans.join(own, ["ord", "th", "start", "end"]).withColumn("src_end", F.col("src_start") + F.col("end") - F.col("start"))
            .join(theirs, ["src_ord", "src_th", "src_start", "src_end"]))
    return both.where("d1 = d2").select(*spans.columns)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept_text`` (the kept words joined by one space; null text: empty), ``n_words`` and ``n_removed``."""
    import pyarrow as pa
    spans = written(repeated_spans(docs, id_col, text_col, length), "span-verified")
    names = list(docs.columns)
    added = []
    for c in ("kept_text", "n_words", "n_removed"):
        added.append(free_name(c, names + added))
    # Inside, columns go by number: any name may be taken, and Python functions know no names with dots.
    text, inner = col(text_col).cast("string"), [f"c{i}" for i in range(len(names))]
    rows = docs.select(*(col(c).alias(i) for c, i in zip(names, inner)), F.coalesce(col(id_col).cast("long"), F.lit(LAST)).alias("ord"),
                       F.xxhash64(text).alias("th"), text.alias("text"))
    gone = spans.groupBy("ord", "th").agg(flat_list("start", "end").alias("gone"))
    rows = with_lists(rows, gone, "gone", "left").select(*inner, "text", "gone")

    def run(batches):
        for b in batches:
            kept, total, removed = [], [], []
            for t, spans in zip(b.column(len(names)), b.column(len(names) + 1).to_pylist()):
                w = t.as_buffer().to_pybytes().split() if t.is_valid else []
                total.append(len(w))
                if spans:
                    left, end = [], 0
                    for s, e in zip(spans[::2], spans[1::2]):  # sorted by start
                        if s > end:
                            left += w[end:s]
                        end = max(end, e)
                    w = left + w[end:]
                removed.append(total[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()),
                                              pa.array(removed, pa.int64())], [*inner, "kept_text", "n_words", "n_removed"])

    schema = StructType([StructField(i, f.dataType, True) for i, f in zip(inner, docs.schema.fields)])
    for c, t in (("kept_text", "string"), ("n_words", "long"), ("n_removed", "long")):
        schema = schema.add(c, t)
    return rows.mapInArrow(run, schema).toDF(*names, *added)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 50 words that start in a document with a smaller id."""
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i,
       unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h FROM d WHERE len(ws) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
r AS (SELECT DISTINCT doc_id, i FROM g JOIN f USING (h) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM d),
c AS (SELECT t.doc_id, j, word, max(r.i) OVER (PARTITION BY t.doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.j)
SELECT d.doc_id, count(c.j) AS n_words, count(c.j) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""
