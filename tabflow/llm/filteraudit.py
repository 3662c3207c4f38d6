"""Filter interaction audit: what every filter removes, repeats and costs under every order of the filters.

Each document has a failure mask (one bit a filter). Only the documents per (part, mask) are counted by Spark, with
their weights (documents, good ones, toxic ones); what follows depends on the masks alone:

* the mask matrix holds 0 where a filter fails and infinity elsewhere, the position matrix holds, per order, the
  inverse permutation (at which step a filter comes); their min-plus product is the removal step of every mask under
  every order (``removal_steps``);
* a weighted scatter over (order, removal step) gives what each step removes; a filter at step s is redundant for the
  weights whose mask fails it and whose removal step is smaller.

The filters of ``TEXT_FILTERS`` are the usual document rules. ``repeats`` (equal to the text of a smaller id) is decided
by aggregation alone: equal texts are merged by a 128-bit hash, per (hash, part, labels, id) first, so that a text in a
third of all rows costs one row a task and is never joined.

Defined results: a null text is the empty text, a null part the empty string; a null id is larger than every id and no
smaller than another null, so of equal texts the rows without an id repeat if any row has one; repeated rows (same id,
same text) do not repeat each other; a document is good or toxic if any label row of its id says so, null labels and
ids of labels say nothing; an empty table gives no rows. Columns besides the named ones are not read, whatever they
are called; texts of any length are read whole.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabflow.llm.common import col, documents, written

#: Fixed values of the audited rules.
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_UPPER_PCT = 3
SYMBOLS = "[#$%&*|]"
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_fails(text: Column) -> list[Column]:
    """Failure conditions A to D of a text, as booleans that are never null."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.char_length(text).cast("long")
    upper = chars - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < MIN_WORDS, distinct.cast("long") * 100 < n.cast("long") * MIN_DISTINCT_PCT,
            upper * 100 > chars * MAX_UPPER_PCT, text.rlike(SYMBOLS)]


def removal_steps(fails: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Min-plus product of ``fails`` (masks x filters, true where a filter fails) and ``positions`` (orders x filters,
    the step of each filter): masks x orders, the step that removes the mask (filters + 1: none does)."""
    far = positions.shape[1] + 1
    cost = np.where(fails, 0, far)
    return np.minimum((cost[:, None, :] + positions[None, :, :]).min(axis=2), far)


def mask_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents and labelled documents per part and failure mask (bit i: filter i)."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_fails(text))]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    facts = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"),
                        mask.alias("mask"), F.unhex(F.md5(text)).alias("key"))
    # Rows that share id, part and text are one row with a count; everything below works on these narrow rows.
    facts = written(facts.groupBy("key", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-facts")
    named = labels.where(col(id_col).isNotNull()).groupBy(col(id_col).cast("long").alias("id")).agg(
        F.max(F.coalesce(col("quality") == 1, F.lit(False))).alias("g"), F.max(F.coalesce(col("toxic") == 1, F.lit(False))).alias("t"))
    no = F.lit(False)
    with_id = facts.where("id is not null").join(named, "id", "left")
    without = facts.where("id is null").withColumns({"g": no, "t": no})
    rows = with_id.select("key", "id", "part", "mask", "n", F.coalesce("g", no).alias("g"), F.coalesce("t", no).alias("t")).union(
        without.select("key", "id", "part", "mask", "n", "g", "t"))
    # Per text and cell: all rows, and how many of them have the cell's smallest id.
    cells = rows.groupBy("key", "mask", "part", "g", "t").agg(
        F.sum("n").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"),
        F.min_by("n", F.struct(F.col("id").isNull(), "id")).alias("at"))
    first = F.min("least").over(W.partitionBy("key"))
    cells = cells.withColumn("first", first)
    # Rows with the smallest id of their text stay; if no row has an id, all of them do.
    stay = F.when(F.col("first.none"), F.col("n")).when(F.col("least") == F.col("first"), F.col("at")).otherwise(0)
    cells = cells.withColumn("stay", stay.cast("long"))
    e = 1 << len(bits)
    parts = F.inline(F.array(F.struct(F.col("mask").alias("m"), F.col("stay").alias("c")),
                             F.struct(F.col("mask").bitwiseOR(F.lit(e)).alias("m"), (F.col("n") - F.col("stay")).alias("c"))))
    cells = cells.select("part", "g", "t", parts).where("c > 0")
    return cells.groupBy("part", F.col("m").alias("mask")).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("g"), F.col("c")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("t"), F.col("c")).otherwise(0)).alias("toxic"))


def audit(weights: DataFrame, filters: str, orders: list[str] | None = None) -> DataFrame:
    """(part, filter_order, step, counts) of every part of ``weights`` (part, mask, n, good, toxic), order and step.

    A part has at most 2^filters masks, so a part is one small group; parts are spread over tasks."""
    import pyarrow as pa
    k = len(filters)
    orders = orders or ["".join(p) for p in itertools.permutations(filters)]
    order_idx = np.array([[filters.index(c) for c in o] for o in orders])  # orders x steps: the filter at each step
    positions = np.argsort(order_idx, axis=1) + 1                            # its inverse: the step of each filter
    masks = np.arange(1 << k)
    fails = ((masks[:, None] >> np.arange(k)) & 1).astype(bool)
    steps = removal_steps(fails, positions)
    types = [pa.field("part", pa.string()), pa.field("filter_order", pa.string()), pa.field("step", pa.int32()),
             *(pa.field(f, pa.int64()) for f in FIELDS)]

    def run(batches):
        for b in batches:
            part, mask, n, good, toxic = (c.to_pylist() for c in b.columns)
            for i in range(b.num_rows):
                w = np.zeros((1 << k, 3), np.int64)
                w[mask[i]] = np.stack([n[i], good[i], toxic[i]], axis=1)
                lost = np.zeros((len(orders), k + 2, 3), np.int64)
                np.add.at(lost, (np.arange(len(orders))[None, :], steps), w[:, None, :])
                lost = lost[:, 1:k + 1]
                removed = lost[:, :, 0]
                # earlier[order, filter]: failing documents that an earlier step removed.
                earlier = ((steps[:, :, None] < positions[None]) & fails[:, None, :]).transpose(1, 2, 0) @ w[:, 0]
                share = np.zeros(k, np.int64)
                np.add.at(share, order_idx, removed)
                at = np.arange(len(orders))[:, None]
                cols = [w[:, 0].sum() - np.cumsum(removed, axis=1), removed, earlier[at, order_idx], w[1 << order_idx, 0],
                        lost[:, :, 1], lost[:, :, 2], share[order_idx]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[i]] * (len(orders) * k), pa.string()), pa.array(np.repeat(orders, k).tolist(), pa.string()),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))),
                     *(pa.array(np.ascontiguousarray(c, np.int64).ravel()) for c in cols)], schema=pa.schema(types))

    fields = [F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("w")]
    grouped = weights.groupBy("part").agg(*fields)
    grouped = grouped.select("part", *(F.col(f"w.{c}").alias(c) for c in ("mask", "n", "good", "toxic")))
    out = grouped.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIELDS))
    return out


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters in all 120 orders, per language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(written(mask_weights(documents(spark, sf_dir), labels), "audit-weights"), "ABCDE")


OP11_SQL = r"""
WITH b AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM b),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS g, bool_or(coalesce(toxic = 1, false)) AS x FROM labels GROUP BY doc_id),
f AS MATERIALIZED (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(g, false) AS g, coalesce(x, false) AS x
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
s(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT s1.c || s2.c || s3.c || s4.c || s5.c AS filter_order FROM s s1, s s2, s s3, s s4, s s5
      WHERE len(list_distinct([s1.c, s2.c, s3.c, s4.c, s5.c])) = 5),
p AS (SELECT f.*, filter_order, least(CASE WHEN a THEN strpos(filter_order, 'A') END, CASE WHEN b THEN strpos(filter_order, 'B') END,
        CASE WHEN c THEN strpos(filter_order, 'C') END, CASE WHEN d THEN strpos(filter_order, 'D') END,
        CASE WHEN e THEN strpos(filter_order, 'E') END) AS r FROM f, o),
q AS (SELECT p.*, step, filter_order[step] AS letter, CASE filter_order[step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS bad
      FROM p, (SELECT unnest(range(1, 6)) AS step)),
z AS (SELECT part, filter_order, step, letter, count(*) FILTER (WHERE r IS NULL OR r > step) AS kept, count(*) FILTER (WHERE r = step) AS removed,
        count(*) FILTER (WHERE bad AND r < step) AS redundant, count(*) FILTER (WHERE bad AND a::INT + b::INT + c::INT + d::INT + e::INT = 1) AS unique_fails,
        count(*) FILTER (WHERE r = step AND g) AS good_lost, count(*) FILTER (WHERE r = step AND x) AS toxic_lost FROM q GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM z
"""
