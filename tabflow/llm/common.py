"""Helpers shared by the corpus operators: written intermediate tables, checked broadcasts, file access from
tasks and connected components.

Intermediate tables are Parquet files under the shared folder named by ``spark.checkpoint.dir``; a lost executor
costs the re-run of one stage, never of the whole lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.functions.ordering import global_row_index
from tabflow.session import scratch_path

#: Rows of long ids (16 MB of keys) up to which a semi-join side is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Bytes up to which a measured table is broadcast.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def col(name: str):
    """A column by its exact name (dots and back-ticks are part of it)."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (case does not count)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def process_cache(name: str, make):
    """A value kept for the life of this Python worker, across tasks (made by ``make()`` at first)."""
    import sys
    import types
    store = sys.modules.setdefault("_tabflow_llm_cache", types.ModuleType("_tabflow_llm_cache"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, short lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_IDS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``limit`` rows; otherwise leave the join to shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def sized_broadcast(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` (a written table) for broadcast if its rows, of ``row_bytes`` each, sum to at most ``limit`` bytes; otherwise
    leave the join to shuffle."""
    size = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df.hint("shuffle_hash")


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with a column ``row``, a long that only rows of the same id and text share, and ``again``, true for all but one
    of the rows that share it; and the names of the two (no column of ``docs`` is touched, whatever it is called).

    A row whose id is its own has it as its number. Of the texts under a repeated id the one with the smallest 64-bit
    hash has the id, the others and then the texts without an id are numbered beyond all ids (before them, below the
    smallest id, only if no longs are left there). Only rows with a repeated or null id are written, with a row number;
    all others pass as they are."""
    row, again, k_id, k_th, k_at, k_least = (free_name(x, docs.columns) for x in ("__row", "__again", "__did", "__th", "__at", "__least"))
    did, th = col(id_col).cast("long"), F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")), col(text_col).isNull())
    seen = written(docs.groupBy(did.alias("did")).agg(F.count(F.lit(1)).alias("n")).where("did is null or n > 1"), "row-ids")
    if seen.isEmpty():
        return docs.withColumns({row: did, again: F.lit(False)}), row, again
    marked = docs.withColumns({k_id: did, k_th: th})
    repeated = seen.where("did is not null").select(F.col("did").alias(k_id))
    parts, plain = [marked.where(F.col(k_id).isNull())], marked.where(F.col(k_id).isNotNull())
    if not repeated.isEmpty():
        repeated = checked_broadcast(repeated)
        parts.append(plain.join(repeated, k_id, "left_semi"))
        plain = plain.join(repeated, k_id, "left_anti")
    inner = marked.columns
    odd = parts[0] if len(parts) == 1 else parts[0].union(parts[1].select(*(col(c) for c in inner)))
    odd = written(odd.withColumn(k_at, F.monotonically_increasing_id()), "row-numbers")
    texts = odd.groupBy(F.col(k_id).alias("did"), F.col(k_th).alias("th")).agg(F.min(k_at).alias("least"))
    own = texts.where("did is not null").groupBy("did").agg(F.min("th").alias("own"))
    texts = texts.join(own, "did", "left").withColumn("z", F.when(F.col("did").isNull(), 2).when(F.col("th") == F.col("own"), 0).otherwise(1))
    texts = written(texts.select("did", "th", "least", "z"), "row-texts")
    extra = global_row_index(texts.where("z > 0"), ["z", "did", "th"], "g")
    ends = docs.agg(F.min(did), F.max(did)).first()
    low, high, count = ends[0] or 0, ends[1] if ends[1] is not None else -1, extra.count()
    start = high + 1 if high + count < 1 << 63 else low - count
    if start < -(1 << 63):
        raise ValueError("the ids leave no numbers free")
    known = texts.where("z = 0").select("did", "th", "least", F.col("did").alias("row"))
    if count:
        known = known.union(extra.select("did", "th", "least", (F.col("g") + F.lit(start).cast("long")).alias("row")))
    known = checked_broadcast(written(known, "row-known"))
    right = known.select(*(F.col(c).alias(free_name(f"{c}_k", odd.columns)) for c in ("did", "th", "least", "row")))
    r_id, r_th, r_least, r_row = (F.col(c) for c in right.columns)
    odd = odd.join(right, F.col(k_id).eqNullSafe(r_id) & (F.col(k_th) == r_th))
    names = [col(c) for c in docs.columns]
    out = plain.select(*names, F.col(k_id).alias(row), F.lit(False).alias(again)).union(
        odd.select(*names, r_row.alias(row), (F.col(k_at) != r_least).alias(again)))
    return out, row, again


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let the session hand at most ``rows`` rows to Python at once: ten thousand documents, the default, are tens of MB that
    the executor and its Python worker each hold several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, rows + 1):
        spark.conf.set(key, str(rows))


def splits_for(df_bytes: int, target: int, least: int = 1) -> int:
    return max(least, -(-int(df_bytes) // target))


# --- files written and read by tasks ---------------------------------------------------------------------------

def task_fs(uri: str):
    """(filesystem, path) for a folder URI, for use inside tasks: any scheme that pyarrow knows."""
    import pyarrow.fs as pafs
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if uri.startswith("/") else _colon(uri))


def _colon(uri: str) -> str:
    scheme, _, rest = uri.partition(":")
    return f"{scheme}://{rest}" if rest.startswith("/") else uri


def put_file(uri: str, name: str, chunks) -> int:
    """Write ``chunks`` to ``uri/name`` through a temporary name, so that a retried task replaces its own output."""
    import os
    fs, base = task_fs(uri)
    fs.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    size = 0
    with fs.open_output_stream(tmp) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    fs.move(tmp, os.path.join(base, name))
    return size


def list_files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(file name, bytes) of the finished files of a folder: names only, no contents."""
    import pyarrow.fs as pafs
    fs, base = task_fs(uri)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.base_name.endswith(suffix) and f.base_name[0] != ".")


# --- connected components --------------------------------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of ``edges`` the smallest node it can reach.

    Each round points every node at its smallest neighbour, shortens those paths by doubling until they are
    stars, and contracts the edges; the smallest node of a component always survives, so the last survivor is
    it. Every round removes all nodes that are not local minima, so rounds are logarithmic in practice. Each
    round's tables are written to the shared folder; only row counts come to the driver.
    """
    cur = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    cur = written(cur.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not cur.isEmpty():
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        star = written(star.select("node", F.least("node", "m").alias("to")), "star")
        while True:
            nxt = star.select(F.col("node").alias("to"), F.col("to").alias("far"))
            star2 = written(star.join(nxt, "to").select("node", F.col("far").alias("to"), (F.col("to") != F.col("far"))
                                                        .alias("moved")), "star")
            star = star2.select("node", "to")
            if star2.where("moved").isEmpty():
                break
        maps.append(star)
        left = star.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = star.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        cur = cur.join(left, "a").join(right, "b").where("ra <> rb")
        cur = written(cur.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not maps:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("to").alias("root"))
    for m in maps[1:]:
        m = m.select(F.col("node").alias("root"), F.col("to").alias("further"))
        out = out.join(m, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return written(out, "components")
