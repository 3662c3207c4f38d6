"""Mixing sources to target weights by hierarchical budgets.

The documents form a tree (domain, language, source). The token budget of a node is split among its children by
their weights; a child that cannot use its share (all its tokens, ``max_epochs`` times) gets what it has, and the
rest goes to its siblings by weight before anything is left to the parent's siblings. All amounts are whole tokens:
shares are rounded down and single tokens go to the largest remainders, then by name.

Each leaf takes whole epochs of its documents while its budget lasts, and of the next epoch a token prefix: the
documents in an order seeded by epoch and id, the last one cut (or taken whole, ``boundary="whole"``) where the
budget ends. The prefix is found from token sums per range of the order, so no leaf, however large, is sorted in one
task: only the range that holds the cut is.

Defined results: null levels are values of their own; documents without tokens (null or empty texts) are not
selected, as they cannot use budget; repeated rows count and are selected each by itself; a leaf of weight 0 gets
nothing; a budget above the whole capacity takes everything; an empty table gives no rows. Columns other than the
id, text and levels are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.llm.common import checked_broadcast, col, documents, free_name, told_apart, written
from tabflow.llm.packing import word_count

SEED = "mix-1"
MAX_WEIGHT = 10_000
#: Documents per order range that may be sorted in one task.
RANGE_DOCS = 20_000
KEY_BITS = 60


def weight_of(value, table: dict) -> F.Column:
    """Weight of a level's value: as listed, else 1."""
    out = F.lit(1)
    for k, w in table.items():
        out = F.when(value.eqNullSafe(F.lit(k)), F.lit(int(w))).otherwise(out)
    return out.cast("long")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``share`` to rows (parent.., name, cap, w, budget): whole-token water filling among siblings."""
    fam = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = fam.orderBy(F.col("cap") / F.col("w"), F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    x = children.where("w > 0")
    x = (x.withColumn("_b", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("_w", F.sum("w").over(fam) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("_full", F.col("cap").cast("decimal(19,0)") * F.col("_w").cast("decimal(10,0)")
                     <= F.col("w").cast("decimal(10,0)") * F.col("_b").cast("decimal(19,0)")))
    x = (x.withColumn("_b", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(fam))
         .withColumn("_w", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(fam)))
    x = (x.withColumn("_base", F.when(~F.col("_full"), F.expr("w * _b div _w")))
         .withColumn("_rest", F.when(~F.col("_full"), F.expr("w * _b % _w"))))
    x = (x.withColumn("_over", F.col("_b") - F.sum("_base").over(fam))
         .withColumn("_rank", F.row_number().over(Window.partitionBy(*(parent or [F.lit(0)]), "_full").orderBy(
             F.col("_rest").desc(), F.col(name).asc_nulls_first()))))
    share = F.when(F.col("_full"), F.col("cap")).otherwise(F.col("_base") + F.when(F.col("_rank") <= F.col("_over"), 1).otherwise(0))
    return x.withColumn("share", share).drop("_b", "_w", "_full", "_base", "_rest", "_over", "_rank")


def budgets(leaves: DataFrame, levels: list[str], weights: dict, budget: int, max_epochs: int) -> DataFrame:
    """(levels.., have, share): tokens of each leaf and its budget. ``leaves`` has one row per leaf with ``have``."""
    out = None
    for d in range(1, len(levels) + 1):
        path = levels[:d]
        kids = leaves.groupBy(*path).agg((F.sum("have") * max_epochs).alias("cap"), F.sum("have").alias("have"))
        kids = kids.withColumn("w", weight_of(F.col(path[-1]), weights.get(path[-1], {})))
        if out is None:
            kids = kids.withColumn("budget", F.lit(int(budget)).cast("long"))
        else:
            up = out.select(*(F.col(c).alias(f"_{c}") for c in path[:-1]), F.col("share").alias("budget"))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path[:-1]]
            cond = same[0]
            for s in same[1:]:
                cond = cond & s
            kids = kids.join(up, cond).drop(*(f"_{c}" for c in path[:-1]))
        out = fill(kids, path[:-1], path[-1])
    return out.select(*levels, "have", "share")


def _shares(rows: DataFrame, names: list[str], levels: list[str], weights: dict, fraction: tuple[int, int], max_epochs: int) -> tuple[DataFrame, int]:
    """(names.., whole, rest) of the leaves of ``rows`` that get anything: whole epochs, and tokens of the next one; and the most
    documents that a leaf has."""
    for table in weights.values():
        if any(not 0 <= int(w) <= MAX_WEIGHT for w in table.values()):
            raise ValueError(f"weights must lie between 0 and {MAX_WEIGHT}")
    leaves = written(rows.groupBy(*names).agg(F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("docs")), "mix-leaves")
    total = leaves.agg(F.sum("have"), F.max("docs")).first()
    share = budgets(leaves, names, {n: weights.get(c, {}) for c, n in zip(levels, names)}, (total[0] or 0) * fraction[0] // fraction[1], max_epochs)
    share = share.where("share > 0").select(*names, F.expr("share div have").alias("whole"), F.expr("share % have").alias("rest"))
    return checked_broadcast(written(share, "mix-budgets")), int(total[1] or 0)


def _order_key(seed: str, whole, doc_id) -> F.Column:
    """The place of a document in the order of an epoch, 60 bits."""
    text = F.concat(F.lit(seed + ":"), whole.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _to_leaf(df: DataFrame, other: DataFrame, names: list[str], extra=()) -> DataFrame:
    """``df`` with the further columns of ``other``, a table of leaves."""
    cond = F.lit(True)
    for n in names:
        cond = cond & df[n].eqNullSafe(other[n])
    for e in extra:
        cond = cond & (df[e] == other[e])
    return df.join(other, cond).select(*(df[c] for c in df.columns), *(other[c] for c in other.columns if c not in names and c not in extra))


def _cut_epoch(placed: DataFrame, names: list[str], most: int, seed: str) -> DataFrame:
    """Documents of ``placed`` in reach of the ``rest`` of their leaf: an order key per document, and the token sums of its range
    of the order (``in_range``) and of those before it (``before``)."""
    bits = max(0, (most // RANGE_DOCS).bit_length())
    part = placed.where("rest > 0").withColumn("key", _order_key(seed, F.col("whole"), F.col("doc_id")))
    part = part.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    sums = part.groupBy(*names, "range").agg(F.sum("n_tokens").alias("in_range"))
    before = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = checked_broadcast(written(sums.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0))), "mix-ranges"))
    return _to_leaf(part, sums, names, ["range"]).where("before < rest")


def _room(part: DataFrame, names: list[str]) -> DataFrame:
    """Documents of ranges, with the tokens that are ``left`` for each; those without any are left out."""
    run = Window.partitionBy(*names, "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return part.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(run), F.lit(0))).where("left > 0")


def mix_sources(docs: DataFrame, levels: list[str], weights: dict, fraction: tuple[int, int] = (6, 10), max_epochs: int = 4,
                seed: str = SEED, boundary: str = "cut", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, levels.., epoch, n_tokens, taken): what each epoch takes of each document (its first ``taken`` words).

    ``weights``: {level: {value: whole weight}}, unlisted values weigh 1. ``fraction`` of all tokens is the budget."""
    if boundary not in ("cut", "whole"):
        raise ValueError("boundary must be cut or whole")
    names = [f"level{i}" for i in range(len(levels))]
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), *(col(c).cast("string").alias(n) for c, n in zip(levels, names)),
                       word_count(col(text_col).cast("string")).alias("n_tokens"))
    rows = written(rows.where("n_tokens > 0"), "mix-tokens")
    share, most = _shares(rows, names, levels, weights, fraction, max_epochs)
    placed = _to_leaf(rows, share, names)
    full = placed.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, whole - 1)"))).select(
        "doc_id", *names, "epoch", "n_tokens", F.col("n_tokens").alias("taken"))

    # The epoch that is cut: whole ranges of its order before the cut, and of the range with the cut what has room.
    part = _cut_epoch(placed, names, most, seed)
    inside = part.where("before + in_range <= rest").withColumn("taken", F.col("n_tokens"))
    cut = _room(part.where("before + in_range > rest"), names)
    cut = cut.withColumn("taken", F.least("left", "n_tokens") if boundary == "cut" else F.col("n_tokens"))
    cols = ["doc_id", *names, F.col("whole").alias("epoch"), "n_tokens", "taken"]
    chosen = full.unionByName(inside.select(*cols)).unionByName(cut.drop("left").select(*cols))
    taken = ["doc_id", "epoch", "n_tokens", "taken"]
    return chosen.select("doc_id", *(F.col(n).alias(free_name(c, taken)) for c, n in zip(levels, names)), *taken[1:])


def select_documents(docs: DataFrame, levels: list[str], weights: dict, fraction: tuple[int, int], seed: str = SEED,
                     id_col: str = "doc_id", text_col: str = "text", max_epochs: int = 1) -> DataFrame:
    """The rows of ``docs``, whole, each as often as epochs of its leaf take it (``levels`` may be columns made for the purpose).

    Rows that share an id but not the text are documents of their own; of rows that share both, those of one leaf are taken
    together. A row's epochs follow from the place in the order where its leaf's last epoch ends, so no ids are joined."""
    rows, row, _ = told_apart(docs, id_col, text_col)
    names = [f"level{i}" for i in range(len(levels))]
    tokens = rows.select(col(row).alias("doc_id"), *(col(c).cast("string").alias(n) for c, n in zip(levels, names)),
                         word_count(col(text_col).cast("string")).alias("n_tokens"))
    tokens = written(tokens.where("n_tokens > 0"), "mix-tokens")
    share, most = _shares(tokens, names, levels, weights, fraction, max_epochs)
    last = _room(_cut_epoch(_to_leaf(tokens, share, names), names, most, seed).where("before + in_range >= rest"), names)
    last = written(last.groupBy(*names).agg(F.max(F.struct("key", "doc_id")).alias("last")), "mix-ends")
    cond = F.lit(True)
    for n in names:
        cond = cond & share[n].eqNullSafe(last[n])
    ends = share.join(checked_broadcast(last), cond, "left").select(*(share[n] for n in names), "whole", "last.key", "last.doc_id")
    inner = {n: free_name(f"_mix_{n}", rows.columns) for n in [*names, "whole", "key", "doc_id", "epochs"]}
    ends = checked_broadcast(written(ends.toDF(*(inner[n] for n in ends.columns)), "mix-epochs"))
    whole, key, end_id = (F.col(inner[n]) for n in ("whole", "key", "doc_id"))
    cond = F.lit(True)
    for c, n in zip(levels, names):
        cond = cond & F.col(inner[n]).eqNullSafe(col(c).cast("string"))
    own = _order_key(seed, whole, col(row))
    once_more = F.coalesce((own < key) | ((own == key) & (col(row) <= end_id)), F.lit(False))
    out = rows.where(col(text_col).cast("string").rlike(r"[^ \t-\r]")).join(ends, cond)
    out = out.withColumn(inner["epochs"], whole + once_more.cast("long"))
    out = out.where(F.col(inner["epochs"]) > 0).withColumn(inner["epochs"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(inner["epochs"]))))
    return out.select(*(col(c) for c in docs.columns))


#: Weights of the query: groups of sources, languages within a group, sources evenly within a language.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}}


def domain_of(source) -> F.Column:
    """The group of a source: its trailing number modulo 3 (d0 without one)."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.when(digits == "", F.lit(0)).otherwise(digits.cast("int")) % 3).cast("string"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the target weights, six tenths of all words, at most four epochs of a source."""
    docs = documents(spark, sf_dir)
    return mix_sources(docs.withColumn("domain", domain_of(F.col("source"))), ["domain", "lang", "source"], WEIGHTS)


def _fill_sql(made: str, kids: str, parent: str, name: str) -> str:
    """CTEs that water-fill ``kids`` (parent.., name, cap, have, w, budget) into ``made``, as ``fill`` does."""
    fam = f"PARTITION BY {parent}" if parent else ""
    cols = (parent + ", " if parent else "") + name
    return f"""
{made}1 AS (SELECT *, budget - coalesce(sum(cap) OVER b, 0) AS bb, sum(w) OVER ({fam}) - coalesce(sum(w) OVER b, 0) AS ww FROM {kids}
  WINDOW b AS ({fam} ORDER BY cap::DOUBLE / w, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{made}2 AS (SELECT * REPLACE (budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ({fam}) AS bb, sum(CASE WHEN f THEN 0 ELSE w END) OVER ({fam}) AS ww)
  FROM (SELECT *, cap * ww <= w * bb AS f FROM {made}1)),
{made}3 AS (SELECT *, CASE WHEN NOT f THEN (w * bb) // ww END AS base, CASE WHEN NOT f THEN (w * bb) % ww END AS rest FROM {made}2),
{made}4 AS (SELECT *, bb - sum(base) OVER ({fam}) AS extra,
  row_number() OVER (PARTITION BY {parent + ', ' if parent else ''}f ORDER BY rest DESC, {name} NULLS FIRST) AS rk FROM {made}3),
{made} AS (SELECT {cols}, have, (CASE WHEN f THEN cap ELSE base + CASE WHEN rk <= extra THEN 1 ELSE 0 END END)::BIGINT AS share FROM {made}4)"""


OP3_SQL = f"""
WITH rows_ AS (SELECT doc_id, 'd' || (CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 0
    ELSE regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1)::INT END % 3)::VARCHAR AS domain, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS n_tokens FROM documents),
r AS (SELECT * FROM rows_ WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS have FROM r GROUP BY ALL),
k1 AS (SELECT domain, sum(have) * 4 AS cap, sum(have) AS have, CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w,
  (SELECT coalesce(sum(have), 0) * 6 // 10 FROM leaf) AS budget FROM leaf GROUP BY ALL),
{_fill_sql("s1", "k1", "", "domain")},
k2 AS (SELECT l.domain, lang, sum(l.have) * 4 AS cap, sum(l.have) AS have,
  CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END AS w, any_value(s1.share) AS budget FROM leaf l JOIN s1 USING (domain) GROUP BY l.domain, lang),
{_fill_sql("s2", "k2", "domain", "lang")},
k3 AS (SELECT l.domain, l.lang, source, l.have * 4 AS cap, l.have, 1 AS w, s2.share AS budget
  FROM leaf l JOIN s2 ON l.domain = s2.domain AND l.lang IS NOT DISTINCT FROM s2.lang),
{_fill_sql("s3", "k3", "domain, lang", "source")},
p AS (SELECT r.*, share // have AS whole, share % have AS rest FROM r JOIN s3 ON r.domain = s3.domain
  AND r.lang IS NOT DISTINCT FROM s3.lang AND r.source IS NOT DISTINCT FROM s3.source WHERE share > 0),
o AS (SELECT *, rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY
  ('0x' || substr(md5('mix-1:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id NULLS FIRST, n_tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p WHERE rest > 0)
SELECT doc_id, domain, lang, source, unnest(range(whole::BIGINT)) AS epoch, n_tokens, n_tokens AS taken FROM p WHERE whole > 0
UNION ALL SELECT doc_id, domain, lang, source, whole::BIGINT, n_tokens, least(room, n_tokens)::BIGINT FROM o WHERE room > 0
"""
