"""Line deduplication by a deletion-neighbourhood join.

A line is dropped if an earlier line (by document id, then line number) of any document equals it or is within one
edit (a character replaced, inserted or left out). Lines shorter than ``MIN_CHARS`` code points are always kept.

Equal lines are merged first; each distinct line has the place of its first occurrence. Only a line's hash, its place and
its block hashes are shuffled; the few texts that are needed later are read again where they lie. For the distinct lines:

1. *Blocks left out.* Two lines within one edit agree outside one of ``s`` blocks of equal length. Every line gives
   the hashes of itself with each one block left out; a line that shares none of them with another distinct line has
   no partner. This runs with few blocks over all lines and again with many over those left.
2. *Characters left out.* The remaining lines emit all variants within the edit bound: the line with each one
   character left out, as 64-bit hashes with the position, and the whole line. Equal (hash, position) means a
   replaced character; a variant equal to another's whole line means an inserted one. In a group of equal variants
   every line is paired with the earliest only, and each whole line with the variants equal to it, so a group costs
   its size. No link that decides a line is lost: in a group any line but the earliest has an earlier partner.
3. Each pair's edit distance is verified on the texts, and the later line of a verified pair is dropped.

Defined results: a null text stays null, an empty one empty; a document may lose all its lines and then has the
empty text; decisions are taken per row, not per id. Rows that share an id and the text count as one document, so none
of them drops the other's lines; of different texts under one id the one with the smallest hash has the id's place and
the others come after all ids; rows without an id come last and are documents of their own, also if their texts are
equal (then one of them keeps its lines). An empty table gives no rows. All columns of the input are kept, whatever they are called; only
the text column changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.functions.ordering import global_row_index
from tabflow.llm.common import checked_broadcast, col, documents, free_name, told_apart, written
from tabflow.llm.textvec import mix, powers, rolling

MIN_CHARS = 16
COARSE, FINE = 4, 32
MASK = (1 << 64) - 1
LENGTH_SALT = 0x9FB21C651E98DF25


def line_rows(rows: DataFrame, row: str, text_col: str, min_chars: int) -> DataFrame:
    """(did, no, line) of every line long enough to be compared; did is the row's number."""
    return (rows.select(F.col(row).alias("did"), F.posexplode(F.split(col(text_col), "\n", -1)).alias("no", "line"))
            .where(F.char_length("line") >= min_chars))


def block_hashes(line: str, s: int) -> str:
    """SQL array of the hashes of ``line`` with one of ``s`` blocks left out, for its length and for one less (the
    partner of an inserted character); prefix and suffix are counted from the ends, so both lengths agree."""
    one = (f"transform(sequence(0, {s - 1}), i -> xxhash64(m, i, substring({line}, 1, CAST(floor(i * m / {s}) AS INT)), "
           f"right({line}, CAST(m - floor((i + 1) * m / {s}) AS INT))))")
    return f"flatten(transform(array(char_length({line}), char_length({line}) - 1), m -> {one}))"


def with_partner(lines: DataFrame) -> DataFrame:
    """The (lid) of the lines (lid, blocks) that share a block-left-out hash with another line."""
    keys = lines.select("lid", F.explode("blocks").alias("h"))
    met = written(keys.groupBy("h").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi"), "line-blocks")
    # The ends of a group are known; only groups of three and more need their middle members.
    ends = met.select(F.explode(F.array("lo", "hi")).alias("lid"))
    more = checked_broadcast(met.where("n > 2").select("h"))
    return written(ends.union(keys.join(more, "h", "left_semi").select("lid")).distinct(), "line-partners")


def variants(lines: DataFrame) -> DataFrame:
    """(h, pos, r): every line with one character left out at ``pos``, and whole at -1. Linear in the text."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            hs, ps, rs, held = [], [], [], 0
            for r, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
                n = len(c)
                pre = rolling(c)
                inv = powers(2)[1][1]
                left_out = pre[:-1] + (pre[-1] - pre[1:]) * inv
                size = np.full(n + 1, (n - 1) * LENGTH_SALT & MASK, np.uint64)
                size[n] = n * LENGTH_SALT & MASK
                hs.append(mix(np.append(left_out, pre[-1]) + size))
                ps.append(np.append(np.arange(n, dtype=np.int32), np.int32(-1)))
                rs.append(np.full(n + 1, r, np.int64))
                held += n + 1
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([h.view(np.int64) for h in hs], ps, rs)], ["h", "pos", "r"])
                    hs, ps, rs, held = [], [], [], 0
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([h.view(np.int64) for h in hs], ps, rs)], ["h", "pos", "r"])

    return lines.select("r", "line").mapInArrow(run, "h long, pos int, r long")


def near_lines(firsts: DataFrame, lines: DataFrame) -> DataFrame:
    """The (key) of the distinct lines (key, place, blocks) that have an earlier line within one edit; ``lines`` (place, line)
    has the texts."""
    some = firsts.select("key", "place", F.xxhash64("key").alias("lid"), "blocks")
    some = written(some.join(checked_broadcast(with_partner(some)), "lid", "left_semi").drop("blocks"), "lines-left")
    some = written(lines.join(checked_broadcast(some), "place"), "lines-texts")
    fine = some.select("lid", F.expr(block_hashes("line", FINE)).alias("blocks"))
    some = written(some.join(checked_broadcast(with_partner(fine)), "lid", "left_semi"), "lines-left")
    # r: the rank of a line's place among those left, so that the earliest of a group is a plain minimum of a long.
    some = written(global_row_index(some.select("key", "place", "line"), ["place", "key"], "r"), "lines-ranked")

    v = variants(some)
    out = v.where("pos >= 0")
    groups = written(out.groupBy("h", "pos").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi"), "line-variants")
    more = checked_broadcast(groups.where("n > 2").select("h", "pos", "lo"))
    replaced = groups.select("lo", "hi").union(out.join(more, ["h", "pos"]).where("r > lo").select("lo", F.col("r").alias("hi")))
    whole = checked_broadcast(v.where("pos < 0").select("h", F.col("r").alias("w")), rows=some.count())
    inserted = out.join(whole, "h").where("r <> w").select(F.least("r", "w").alias("lo"), F.greatest("r", "w").alias("hi"))
    pairs = written(replaced.union(inserted).distinct(), "line-pairs")
    lo, hi = (some.select(F.col("r").alias(k), F.col("line").alias(f"{k}_line"), F.col("place").alias(f"{k}_place"), F.col("key").alias(f"{k}_key"))
              for k in ("lo", "hi"))
    both = pairs.join(lo, "lo").join(hi, "hi").where("lo_place < hi_place")
    return both.where(F.levenshtein("lo_line", "hi_line", 1) >= 0).select(F.col("hi_key").alias("key")).distinct()


def dropped_lines(rows: DataFrame, row: str, text_col: str, min_chars: int, max_edits: int) -> DataFrame:
    """(did, drop): line numbers to drop per row number."""
    # A place is one decimal that sorts by row number, then line, so the aggregate below merges hot lines on the map side.
    place = (F.col("did").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("no")).cast("decimal(38,0)")
    keyed = line_rows(rows, row, text_col, min_chars).withColumn("key", F.unhex(F.md5("line"))).withColumn("place", place)
    blocks = [F.first(F.expr(block_hashes("line", COARSE))).alias("blocks")] if max_edits else []
    firsts = written(keyed.groupBy("key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), *blocks), "lines")
    known = firsts.select("key", "place", "n", F.lit(False).alias("dead"))
    if max_edits:
        dead = checked_broadcast(written(near_lines(firsts, keyed.select("place", "line")).withColumn("hit", F.lit(True)), "lines-dead"))
        known = known.join(dead, "key", "left").select("key", "place", "n", F.coalesce("hit", F.lit(False)).alias("dead"))
    known = checked_broadcast(written(known.where("n > 1 or dead").select("key", F.col("place").alias("first"), "dead"), "lines-known"))
    drops = keyed.select("key", "did", "no", "place").join(known, "key").where("dead or place > first")
    return written(drops.groupBy("did").agg(F.collect_set("no").alias("drop")), "line-drops")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                max_edits: int = 1) -> DataFrame:
    """``docs`` without the later copies and near copies of lines, and ``lines_dropped``."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    rows, row, again = told_apart(docs, id_col, text_col)
    drops = checked_broadcast(dropped_lines(rows, row, text_col, min_chars, max_edits))
    drop = free_name("__line_drop", rows.columns)
    gone, again = F.col(drop), F.col(again) & col(id_col).isNull()
    marked = rows.join(drops.select(F.col("did").alias(row), F.col("drop").alias(drop)), row, "left")
    text = col(text_col)
    # Of equal texts without an id all but one are later copies, line by line.
    parts = F.split(text, "\n", -1)
    copied = F.filter(parts, lambda x: F.char_length(x) < min_chars)
    kept = F.when(again, copied).otherwise(F.filter(parts, lambda _, i: ~F.array_contains(gone, i)))
    changed = again | gone.isNotNull()
    lost = F.when(again, F.size(parts) - F.size(copied)).otherwise(F.size(gone))
    count = free_name("lines_dropped", docs.columns)
    return marked.select(*(F.when(changed, F.array_join(kept, "\n")).otherwise(text).alias(c) if c == text_col else col(c) for c in docs.columns),
                         F.when(text.isNotNull() & changed, lost).otherwise(0).alias(count))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated and nearly repeated lines."""
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
d AS (SELECT line, min((doc_id, no)) AS place FROM l WHERE length(line) >= 16 GROUP BY line),
k AS (SELECT line, place, row_number() OVER (ORDER BY place) AS r FROM d),
v AS (SELECT r, i AS pos, md5(line[:i - 1] || line[i + 1:]) AS h FROM (SELECT r, line, unnest(range(1, length(line) + 1)) AS i FROM k)),
dead AS (SELECT r FROM (SELECT r, min(r) OVER (PARTITION BY h, pos) AS m FROM v) WHERE m < r
         UNION SELECT greatest(v.r, k.r) FROM v JOIN k ON v.h = md5(k.line)),
e AS (SELECT l.doc_id, l.no, l.line, coalesce((l.doc_id, l.no) > k.place OR k.r IN (SELECT r FROM dead), false) AS gone
      FROM l LEFT JOIN k ON k.line = l.line)
SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(e.line, chr(10) ORDER BY e.no) FILTER (WHERE NOT e.gone), '') END AS text,
       CAST(count(*) FILTER (WHERE e.gone) AS INTEGER) AS lines_dropped
FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id
"""
