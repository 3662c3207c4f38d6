"""Global row positions without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row into one task.
``global_row_index`` instead range-partitions on the order keys, sorts inside each
partition, checkpoints (so positions survive executor loss and recomputation), counts
rows per partition (one small row per partition reaches the driver) and adds the
prefix offset of the partition to each row's local position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabflow.functions.exprs import col_
from tabflow.functions.quantiles import with_order_key
from tabflow.session import ensure_checkpoint_dir


def join_on(left: DataFrame, right: DataFrame, cols, how: str = "inner", extra=()) -> DataFrame:
    """Join on equal ``cols`` where NULL equals NULL; ``cols`` come out once, as the left side has them."""
    cols = list(cols)
    r = right.select(*[F.col(f"`{c}`").alias(f"_on_{c}") for c in cols],
                     *[F.col(f"`{c}`") for c in right.columns if c not in cols])
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[f"`{c}`"].eqNullSafe(r[f"`_on_{c}`"])
    return left.join(r, cond, how).drop(*[f"_on_{c}" for c in cols])


def global_row_index(df: DataFrame, order_cols, index_col: str = "idx", num_partitions: int | None = None,
                     checkpoint: bool = True) -> DataFrame:
    """Add a 0-based position in the total order given by ``order_cols`` (make them unique)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        ensure_checkpoint_dir(spark)
        ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("first")).collect()
    base, offset = [], 0
    for r in sorted(counts, key=lambda r: r["_pid"]):  # one row per partition
        base.append((r["_pid"], offset - r["first"]))
        offset += r["n"]
    if not base:
        return df.withColumn(index_col, F.lit(None).cast("bigint"))
    bases = spark.createDataFrame(base, "_pid int, _base bigint")
    return (ranged.join(F.broadcast(bases), "_pid")
            .withColumn(index_col, F.col("_mid") + F.col("_base"))
            .drop("_pid", "_mid", "_base"))


def running_totals(df: DataFrame, order_col: str, sum_cols, partition_cols=(), descending: bool = False,
                   num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_col`` order (per ``partition_cols``).

    Range-partitioned on the order key: each task sums its own slice, and slice offsets come
    from a running sum over the per-slice totals (one small row per slice and group)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = list(partition_cols)
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    ranged = df.repartitionByRange(n, o).withColumn("_pid", F.spark_partition_id())
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)  # fixes slice boundaries for both uses below
    w = W.partitionBy(*parts, "_pid").orderBy(o).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(w).alias(f"_run_{c}") for c in sum_cols])
    tot = ranged.groupBy(*parts, "_pid").agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    tw = W.partitionBy(*parts).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offs = tot.select(*parts, "_pid", *[F.coalesce(F.sum(f"_tot_{c}").over(tw), F.lit(0)).alias(f"_off_{c}")
                                        for c in sum_cols])
    out = join_on(local, offs, parts + ["_pid"])
    return out.select(*df.columns, *[(F.col(f"_run_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sum_cols])


#: Rows of one entity that a task ranks; slices hold less than twice as many.
SLICE_ROWS = 200_000
DIGIT_BITS = 12
BROADCAST_ROWS = 100_000


def order_key(dt, c):
    """Long that grows with a date, time or whole-number column, or None for other types."""
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        if isinstance(dt, T.TimestampType):
            return F.unix_micros(c)
        day = F.unix_date(c.cast("date")).cast("bigint")  # no zone comes in, so no gap either
        return ((day * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    return None


def order_slices(df: DataFrame, entity_cols, order_cols, slice_rows: int = SLICE_ROWS, slice_col: str = "_chunk") -> DataFrame:
    """``df`` with a slice number per row that grows along ``order_cols`` inside every entity, so that a hot entity is many
    groups of about ``slice_rows`` rows, however its rows are spread over time.

    Only entities with more rows than that are cut (found by one narrow count). Their order columns are read as digits of
    12 bits: rows are counted per first digit, digits with too many rows are counted by the next one, down to the last bit of
    the last numeric or time column; runs of counts make slices. The count tables hold at most 4096 rows per entity or digit
    that is cut, and are broadcast to the rows only up to a checked size. More than ``2 slice_rows`` rows share a slice only if
    their order columns agree, or differ only from a text column on."""
    ent = list(entity_cols)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    hot = df.groupBy(*[col_(c) for c in ent]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
    hot = hot.select(*[col_(c).alias(f"_e{i}") for i, c in enumerate(ent)], F.lit(True).alias("_hot")).checkpoint(eager=True)
    n_hot = hot.count()
    if not n_hot:
        return df.withColumn(slice_col, F.lit(0).cast("bigint"))
    e = [f"_e{i}" for i in range(len(ent))]
    keyed = df
    keys = []
    for i, c in enumerate(order_cols):
        dt = df.schema[c].dataType
        fraction = isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType))
        k = col_(c).cast("double") if fraction else order_key(dt, col_(c))
        if k is None:
            break
        keys.append(f"_k{i}")
        keyed = with_order_key(keyed.withColumn("_v", k), "_v", keys[-1]).drop("_v") if fraction else keyed.withColumn(keys[-1], k)
        if isinstance(dt, T.DecimalType):  # decimals that differ may be one double
            break
    keyed = keyed.select("*", *[col_(c).alias(x) for c, x in zip(ent, e)])

    def sized(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if t.count() <= BROADCAST_ROWS else t

    narrow = join_on(keyed.select(*e, *keys), sized(hot), e).drop("_hot")
    ends = narrow.agg(*[f(k) for k in keys for f in (F.min, F.max)]).first() if keys else ()
    digits = []
    for k, low, high in zip(keys, ends[::2], ends[1::2]):
        if low is None or low == high:
            continue
        cut = 0 if high - low < 1 << 62 else 2  # a difference must be a long: the lowest bits are a digit of their own then
        x = F.shiftright(F.col(k), cut) - F.lit(low >> cut)
        bits = ((high >> cut) - (low >> cut)).bit_length()
        for shift in range(max(0, bits - DIGIT_BITS), -1, -DIGIT_BITS):
            digits.append(F.coalesce(F.shiftright(x, shift).bitwiseAND((1 << DIGIT_BITS) - 1), F.lit(-1)).cast("int"))
            last = shift
        if last:
            digits.append(F.coalesce(x.bitwiseAND((1 << last) - 1), F.lit(-1)).cast("int"))
        if cut:
            digits.append(F.coalesce(F.col(k).bitwiseAND((1 << cut) - 1), F.lit(-1)).cast("int"))
    if not digits:
        return df.withColumn(slice_col, F.lit(0).cast("bigint"))
    names = [f"_d{i}" for i in range(len(digits))]
    narrow = narrow.select(*e, *[d.alias(x) for d, x in zip(digits, names)])
    leaves, over = [], None
    for level, _ in enumerate(names):
        rows = narrow if over is None else join_on(narrow, sized(over), e + names[:level])
        c = rows.groupBy(*e, *names[:level + 1]).agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True)
        wide = F.col("_n") > slice_rows
        if level == len(names) - 1:
            wide = F.lit(False)
        leaves.append(c.where(~wide))
        over = c.where(wide).drop("_n")
        if over.isEmpty():
            break
    used = names[:len(leaves)]
    total = None
    for level, t in enumerate(leaves):
        t = t.select(*e, *used[:level + 1], *[F.lit(None).cast("int").alias(x) for x in used[level + 1:]], "_n", F.lit(level).alias("_level"))
        total = t if total is None else total.union(t)
    before = F.sum("_n").over(W.partitionBy(*e).orderBy(*used).rowsBetween(W.unboundedPreceding, -1))
    total = total.select(*e, *used, "_level", F.floor(F.coalesce(before, F.lit(0)) / slice_rows).cast("bigint").alias("_s")).checkpoint(eager=True)
    out = keyed.select("*", *[d.alias(x) for d, x in zip(digits, used)])
    found = []
    for level in range(len(leaves)):
        part = total.where(F.col("_level") == level).select(*e, *used[:level + 1], F.col("_s").alias(f"_s{level}"))
        out = join_on(out, sized(part), e + used[:level + 1], "left")
        found.append(F.col(f"_s{level}"))
    return out.select(*[col_(c) for c in df.columns], F.coalesce(*found, F.lit(0)).cast("bigint").alias(slice_col))


def entity_positions(df: DataFrame, entity_cols, order_cols, chunk=None, pos_col: str = "pos",
                     count_col: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """0-based position of every row inside its entity, in ``order_cols`` order.

    A window partitioned by entity alone sends a hot entity (say a third of all rows) to
    one task. Here rows are ranked inside ``(entity, chunk)``, with the slices of ``order_slices`` or the given
    ``chunk`` (monotone in the order), and the chunk's offset comes from a running sum over
    the small per-chunk count table. ``count_col`` optionally adds the entity's row count.
    Rows with a NULL entity are an entity of their own; NULL order values come first."""
    entity_cols = list(entity_cols)
    d = order_slices(df, entity_cols, order_cols, slice_rows) if chunk is None else df.withColumn("_chunk", chunk)
    local = d.withColumn("_lpos", F.row_number().over(
        W.partitionBy(*entity_cols, "_chunk").orderBy(*order_cols)) - 1)
    counts = d.groupBy(*entity_cols, "_chunk").agg(F.count(F.lit(1)).alias("_cnt_"))
    ew = W.partitionBy(*entity_cols)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cnt_").over(
        ew.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    if count_col:
        offs = offs.withColumn(count_col, F.sum("_cnt_").over(ew))
    offs = offs.drop("_cnt_")
    return (join_on(local, offs, entity_cols + ["_chunk"])
            .withColumn(pos_col, (F.col("_off") + F.col("_lpos")).cast("bigint"))
            .drop("_chunk", "_lpos", "_off"))


def lag_by_position(df: DataFrame, entity_cols, value_col: str, k: int, out_col: str, pos_col: str = "pos") -> DataFrame:
    """Value of ``value_col`` k positions earlier in the same entity, by an equi-join on
    ``(entity, pos)`` (spreads a hot entity over all tasks, unlike a lag window)."""
    entity_cols = list(entity_cols)
    prev = df.select(*entity_cols, (F.col(pos_col) + k).alias(pos_col), F.col(value_col).alias(out_col))
    return join_on(df, prev, entity_cols + [pos_col], "left")


def with_halo(df: DataFrame, entity_cols, back: int, pos_col: str = "pos", slice_rows: int = 10_000) -> DataFrame:
    """Cut every entity into slices of ``slice_rows`` positions (``_slice``) and copy the last ``back`` rows of a
    slice into the next one (``_halo`` true), so that a window over ``(entity, _slice)`` sees the ``back`` rows before
    each row. A hot entity is many slices; the copies are dropped after the window with ``NOT _halo``."""
    size = max(slice_rows, back)
    own = F.floor(F.col(pos_col) / size)
    to = F.array(F.struct(own.alias("_slice"), F.lit(False).alias("_halo")))
    to = F.when(F.col(pos_col) % size >= size - back, F.concat(to, F.array(F.struct((own + 1).alias("_slice"), F.lit(True).alias("_halo"))))
                ).otherwise(to)
    return df.select("*", F.inline(to))
