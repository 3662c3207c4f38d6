"""Best-fit packing into bins of several permitted sequence lengths.

Documents become pieces of at most the largest permitted size (longer ones are cut into full pieces and a rest;
nothing is dropped). Pieces are dealt to shards by hash; a shard is packed in blocks of at most ``BLOCK_ITEMS``
pieces, so memory does not depend on how rows are spread. Inside a block, pieces go in decreasing length to the
open bin with the least room that still fits. All permitted sizes are optimised jointly: every permitted smallest
opening size is tried for the block, a new bin opens at the least-cost permitted size under that floor, every bin
is finally downsized to the smallest permitted size that holds its contents, and the cheapest outcome is kept.

Defined results: a null or empty text has length 1 (its end mark); ties in length go by id, then piece; repeated
rows are packed as often as they occur; a null id is kept and sorts first; an empty table gives no rows. Only the
id and the length (or text) column are read, whatever other columns are called.
"""

from __future__ import annotations

from itertools import chain, repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm.common import col, documents

SIZES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin besides its length: the fixed price of one more sequence.
BIN_COST = 32
BLOCK_ITEMS = 20_000
SCHEMA = ("doc_id long, piece int, start long, n_tokens int, bin_id string, bin_size int, bin_offset int, bin_used int")


def word_count(text):
    """Words of a text column (runs of anything but ASCII white space), 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def pack_block(lengths: list[int], sizes: list[int], bin_cost: int) -> list[tuple[int, int]]:
    """(bin, offset in bin) per item and the size per bin; ``lengths`` must be in decreasing order."""
    best = None
    for floor in sizes:
        if best is not None and floor > 2 * sum(lengths):
            continue
        room, used, where = {}, [], []  # room -> bins with exactly that room; a bit set finds the least room that fits
        bits = 0
        for n in lengths:
            fits = bits >> n
            if fits:
                r = (fits & -fits).bit_length() - 1 + n
                stack = room[r]
                b = stack.pop()
                if not stack:
                    bits &= ~(1 << r)
            else:
                b, r = len(used), next(s for s in sizes if s >= n and s >= floor)
                used.append(0)
            where.append((b, used[b]))
            used[b] += n
            r -= n
            if r:
                room.setdefault(r, []).append(b)
                bits |= 1 << r
        final = [next(s for s in sizes if s >= u) for u in used]
        cost = sum(final) + bin_cost * len(final)
        if best is None or cost < best[0]:
            best = (cost, where, final, used)
    return best[1:] if best else ([], [], [])


def pack(docs: DataFrame, sizes=SIZES, bin_cost: int = BIN_COST, id_col: str = "doc_id", text_col: str = "text",
         length_col: str | None = None, block_items: int = BLOCK_ITEMS, epochs_col: str | None = None) -> DataFrame:
    """One row per piece: its tokens [start, start + n_tokens) of the document and its place in a bin.

    ``bin_id`` is the id, piece and occurrence of the bin's first piece, so it is unique and repeatable. With ``epochs_col``, how
    often a document is used, a bin holds documents of equal epochs only; these are its last column and end its ``bin_id``."""
    import pandas as pd
    sizes = sorted(set(int(s) for s in sizes))
    if not sizes or sizes[0] < 1:
        raise ValueError("sizes must be positive")
    top = sizes[-1]
    n = col(length_col).cast("long") if length_col else word_count(col(text_col).cast("string")) + 1
    epochs = F.coalesce(col(epochs_col).cast("long"), F.lit(0)) if epochs_col else F.lit(1).cast("long")
    items = docs.select(col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).alias("n"), epochs.alias("epochs"))
    pieces = items.select("doc_id", F.posexplode(F.expr(f"sequence(0L, n - 1, {top}L)")).alias("piece", "start"), "n", "epochs").select(
        "doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(top)).cast("int").alias("n_tokens"),
        *(["epochs"] if epochs_col else []))
    schema = SCHEMA + (", epochs long" if epochs_col else "")
    total = items.count()
    shards = max(1, -(-total // (2 * block_items)))

    given = [f.split()[0] for f in schema.split(", ")]

    def apart(pdf):
        return [x.reset_index(drop=True) for _, x in pdf.groupby("epochs")] if epochs_col else [pdf] if len(pdf) else []

    def run(batches):
        held, size = [], 0

        def emit(rows):
            t = pd.concat(rows, ignore_index=True)
            for lo in range(0, len(t), block_items):
                part = t.iloc[lo:lo + block_items].reset_index(drop=True)
                part = part.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
                where, final, used = pack_block([int(x) for x in part["n_tokens"]], sizes, bin_cost)
                name = {}
                ids = part["doc_id"].tolist()
                names = []
                for k, (b, _) in enumerate(where):
                    if b not in name:
                        who = "" if pd.isna(ids[k]) else int(ids[k])
                        name[b] = f"{who}.{int(part['piece'].iat[k])}.{int(part['copy'].iat[k])}"
                        if epochs_col:
                            name[b] += f".{int(part['epochs'].iat[k])}"
                    names.append(name[b])
                yield part.assign(bin_id=names, bin_size=[final[b] for b, _ in where], bin_offset=[o for _, o in where],
                                  bin_used=[used[b] for b, _ in where])[given]

        last, copy, times = None, 0, None
        for pdf in chain.from_iterable(map(apart, batches)):
            if epochs_col and size and times != pdf["epochs"].iat[0]:
                yield from emit(held)
                held, size = [], 0
            times = pdf["epochs"].iat[0] if epochs_col else None
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            copies = []
            for key in zip(pdf["doc_id"].fillna(-1).tolist(), pdf["doc_id"].isna().tolist(), pdf["piece"].tolist(), repeat(times)):
                last, copy = (key, copy + 1) if key == last else (key, 0)
                copies.append(copy)
            pdf["copy"] = copies
            held.append(pdf)
            size += len(pdf)
            if size >= block_items:
                t = pd.concat(held, ignore_index=True)
                whole = len(t) - len(t) % block_items
                yield from emit([t.iloc[:whole]])
                held, size = [t.iloc[whole:]], len(t) - whole
        if size:
            yield from emit(held)

    # Rows that repeat an id are dealt apart by nothing but their id: blocks, not shards, bound the memory.
    return (pieces.repartition(shards, F.xxhash64("doc_id", "piece")).sortWithinPartitions(*(["epochs"] if epochs_col else []), "doc_id", "piece", "n_tokens")
            .mapInPandas(run, schema))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents (words and an end mark) into the production sequence lengths."""
    return pack(documents(spark, sf_dir))
