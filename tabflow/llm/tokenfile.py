"""Token-id files: an adaptive context-mixing range coder over ids, in independent, checksummed blocks.

A file holds the documents of one id range in id order: blocks of ids, then the table of its documents, then a
trailer with the place of that table. A block is coded by itself (all statistics start anew) and carries a CRC-32.

Inside a block the ids are cut into lanes of equal length, each with a range coder of its own, and all lanes take a
step together as one numpy operation, sharing the block's statistics:

* order 2 and order 1 predict one id each, from the id last seen after the two ids (or the one id) before, with a
  confidence that grows while the prediction holds;
* the two confidences, and whether the predictions agree, choose an adaptive mixture that splits the coding range
  between order 2, order 1 and order 0; every mixture learns from the outcomes of its own context;
* order 0 codes the ids that neither predicted, from adaptive frequencies.

The decoder repeats the same updates in the same order. Format (little-endian): ``TKM1``, u32 vocabulary size; per
block ``BLOK``, u32 ids, u32 lanes, u32 payload bytes, u32 CRC-32 of the payload; the payload holds u32 word counts
per lane and the lanes' 32-bit words; ``DOCS``, u32 documents, u32 bytes, u32 CRC-32, then deflated u8 validity,
i64 ids, u32 token counts; the trailer is the u64 offset of ``DOCS`` and ``TKM1``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from itertools import chain, compress, count, islice

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabflow.llm.common import col, documents, process_cache, put_file, shared_folder, task_fs, written

BLOCK_IDS, STEPS = 1 << 20, 256
T2_BITS, T1_BITS = 18, 16
CONF_BITS = 4
TOP_CONF = (1 << CONF_BITS) - 1
#: Ranges are split in 2**MIX_BITS parts between the orders and in 2**FREQ_BITS parts by order 0.
MIX_BITS, FREQ_BITS = 16, 24
END_ID = 2
VOCABULARY = 50_257
#: Distinct pieces a worker remembers between texts.
CACHE_PIECES = 1_500_000
#: Characters of text that are cut into pieces at once.
CHUNK_CHARS = 8 << 20
MAGIC = b"TKM1"
U32 = np.uint64(32)
LOW32 = np.uint64(0xFFFFFFFF)


class Model:
    """Statistics of one block, shared by its lanes; encoder and decoder call the same methods in the same order.

    An entry of orders 2 and 1 is one number: the predicted id, then its confidence in the lowest ``CONF_BITS``."""

    def __init__(self, lanes: int, vocabulary: int):
        kind = np.int32 if vocabulary << CONF_BITS <= 1 << 31 else np.int64
        self.order2, self.order1 = np.zeros(1 << T2_BITS, kind), np.zeros(1 << T1_BITS, kind)
        self.mixture = np.tile(np.array([1, 1, 2], np.int64), (512, 1))
        self.freq = np.ones(vocabulary, np.int64)
        self.missed, self.outcomes, self.step, self.next_build = [], [], 0, 0
        self.weigh()
        self.p1, self.mixed1, self.mixed2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def weigh(self):
        """Splits of the range per mixture context, in 2**-MIX_BITS: what order 2 gets, and orders 2 and 1 together; and
        the start and width of each event's part at ``context * 3 + event``."""
        total = self.mixture.sum(1)
        self.q0 = ((self.mixture[:, 0] << MIX_BITS) // total).astype(np.uint64)
        self.q1 = ((self.mixture[:, 0] + self.mixture[:, 1] << MIX_BITS) // total).astype(np.uint64)
        edges = np.stack([np.zeros_like(self.q0), self.q0, self.q1, np.full_like(self.q0, 1 << MIX_BITS)], 1)
        self.start, self.width = edges[:, :3].ravel(), np.diff(edges).ravel()

    def predict(self, m: int):
        if self.step >= self.next_build:
            if self.missed:  # one pass over the vocabulary for all steps since the last
                self.freq += 8 * np.bincount(np.concatenate(self.missed), minlength=len(self.freq))
            self.missed = []
            cum = np.concatenate([[0], np.cumsum(self.freq)])
            self.cum = ((cum << FREQ_BITS) // cum[-1]).astype(np.uint32)
            self.next_build, self.near = self.step + min(max(self.step, 1), 32), None
        if len(self.outcomes) == 4:
            seen = np.concatenate(self.outcomes)
            self.outcomes = []
            self.mixture += 24 * np.bincount(seen, minlength=1536).reshape(512, 3)
            while (big := self.mixture.sum(1) > (1 << MIX_BITS)).any():
                self.mixture[big] = (self.mixture[big] >> 1) + 1
            self.weigh()
        p1 = self.p1[:m]
        self.at2 = ((p1 * 0x2545F491 + self.mixed2[:m]) >> 7) & ((1 << T2_BITS) - 1)
        self.at1 = (self.mixed1[:m] >> 9) & ((1 << T1_BITS) - 1)
        self.e2, self.e1 = self.order2.take(self.at2), self.order1.take(self.at1)
        self.c2, self.c1 = self.e2 >> CONF_BITS, self.e1 >> CONF_BITS
        self.k2, self.k1 = self.e2 & TOP_CONF, self.e1 & TOP_CONF
        self.state = (self.k2 << CONF_BITS) + self.k1
        self.state += (self.c1 == self.c2) * self.state.dtype.type(256)
        self.state3 = self.state * 3

    def symbols(self, v):
        """The ids whose order-0 parts hold ``v``: by the upper 16 bits where these belong to one id, else by search."""
        low = FREQ_BITS - 16
        if self.near is None:
            self.near = np.cumsum(np.bincount((self.cum.astype(np.int64) + (1 << low) - 1) >> low, minlength=(1 << 16) + 1)) - 1
        part = (v >> np.uint32(low)).astype(np.int64)
        y = self.near.take(part)
        open_ = np.flatnonzero(self.near.take(part + 1) != y)
        if len(open_):
            order = np.sort((v[open_].astype(np.int64) << 32) | open_)
            y[order & 0xFFFFFFFF] = np.searchsorted(self.cum, (order >> 32).astype(np.uint32), "right") - 1
        return y

    def learn(self, x, at, hit2, hit1, miss):
        """``x``: the ids; ``at``: ``context * 3 + event`` of each; the hits of orders 2 and 1, and the ids without any."""
        m = len(x)
        self.outcomes.append(at)
        fresh = (x << CONF_BITS | 1).astype(self.e2.dtype)
        for entries, to, e, k, hit in ((self.order2, self.at2, self.e2, self.k2, hit2), (self.order1, self.at1, self.e1, self.k1, hit1)):
            entries[to] = np.where(hit, e + (k < TOP_CONF), np.where(k < 2, fresh, e - ((k + 1) >> 1)))
        if len(miss):
            self.missed.append(miss)
        self.p1[:m] = x
        self.mixed1, self.mixed2 = self.mixed2, self.mixed1
        np.multiply(x, 0x9E3779B1, out=self.mixed1[:m])
        self.step += 1


def lane_layout(n: int) -> tuple[int, np.ndarray]:
    """(lanes, start of each lane): lane lengths differ by one at most, the longer ones first."""
    lanes = -(-n // STEPS)
    base, more = divmod(n, lanes)
    size = np.full(lanes, base, np.int64)
    size[:more] += 1
    return lanes, np.concatenate([[0], np.cumsum(size)])


def _renormalise(low, rng):
    """Lanes whose range is short, cut to one upper word; (lanes, their upper words), shifted."""
    short = np.flatnonzero(rng < (np.uint64(1) << U32))
    if len(short) == 0:
        return short, None
    lo, ra = low[short], rng[short]
    word = lo >> U32
    split = (lo + (ra - np.uint64(1))) >> U32 != word
    ra = np.where(split, (np.uint64(1) << U32) - (lo & LOW32), ra)
    low[short] = (lo & LOW32) << U32
    rng[short] = ra << U32
    return short, word


def encode_block(ids: np.ndarray, vocabulary: int = VOCABULARY) -> bytes:
    n = len(ids)
    lanes, starts = lane_layout(n)
    model = Model(lanes, vocabulary)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    longest = int(starts[1])
    room = 2 * longest + 2
    words, first = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    end = first.copy()
    full = n - lanes * (longest - 1) if longest > 1 or n < lanes else lanes
    ids = ids.astype(np.int64)

    def push(low, rng, at=None):
        short, word = _renormalise(low, rng)
        if len(short):
            short = short if at is None else at[short]
            words[end[short]] = word
            end[short] += 1

    for t in range(longest):
        m = lanes if t < longest - 1 else full
        x = ids[starts[:m] + t]
        model.predict(m)
        hit2, hit1 = x == model.c2, x == model.c1
        at = model.state3 + np.where(hit2, 0, 2 - hit1)
        lo, ra = low[:m], rng[:m]
        ra >>= np.uint64(MIX_BITS)
        lo += ra * model.start.take(at)
        ra *= model.width.take(at)
        push(lo, ra)
        miss = np.flatnonzero(~(hit2 | hit1))
        y = x[miss]
        if len(miss):
            lo, ra = low[miss], rng[miss] >> np.uint64(FREQ_BITS)
            start = model.cum[y]
            lo += ra * start
            ra *= model.cum[y + 1] - start
            push(lo, ra, miss)
            low[miss], rng[miss] = lo, ra
        model.learn(x, at, hit2, hit1, y)
    for word in (low >> U32, low & LOW32):
        words[end] = word
        end += 1
    used = end - first
    words = words.reshape(lanes, room)
    payload = used.astype("<u4").tobytes() + words[np.arange(room) < used[:, None]].astype("<u4").tobytes()
    return struct.pack("<4sIIII", b"BLOK", n, lanes, len(payload), zlib.crc32(payload)) + payload


def decode_block(n: int, lanes: int, payload: bytes, vocabulary: int = VOCABULARY) -> np.ndarray:
    _, starts = lane_layout(n)
    counts = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(payload, "<u4", offset=4 * lanes).astype(np.uint64), np.zeros(2, np.uint64)])
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    code = (words[at] << U32) | words[at + 1]  # kept as its distance from low
    at = at + 2
    model = Model(lanes, vocabulary)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    longest = int(starts[1])
    full = n - lanes * (longest - 1) if longest > 1 or n < lanes else lanes
    out = np.empty(n, np.int64)

    def pull(low, rng, code, lane=None):
        short, _ = _renormalise(low, rng)
        if len(short):
            own = short if lane is None else lane[short]
            place = at[own]
            code[short] = (code[short] << U32) | words[place]
            at[own] = place + 1

    for t in range(longest):
        m = lanes if t < longest - 1 else full
        model.predict(m)
        lo, ra, co = low[:m], rng[:m], code[:m]
        ra >>= np.uint64(MIX_BITS)
        over2, over1 = co >= ra * model.q0.take(model.state), co >= ra * model.q1.take(model.state)
        event = model.state3 + over2 + over1
        step = ra * model.start.take(event)
        lo += step
        co -= step
        ra *= model.width.take(event)
        pull(lo, ra, co)
        x = np.where(over2, model.c1, model.c2).astype(np.int64)
        miss = np.flatnonzero(over1)
        y = miss
        if len(miss):
            lo, ra, co = low[miss], rng[miss] >> np.uint64(FREQ_BITS), code[miss]
            v = np.minimum(co // ra, np.uint64(int(model.cum[-1]) - 1)).astype(np.uint32)
            y = model.symbols(v)
            start = model.cum[y]
            step = ra * start
            lo += step
            co -= step
            ra *= model.cum[y + 1] - start
            pull(lo, ra, co, miss)
            low[miss], rng[miss], code[miss] = lo, ra, co
            x[miss] = y
        out[starts[:m] + t] = x
        model.learn(x, event, x == model.c2, x == model.c1, y)
    return out


# --- text to ids -----------------------------------------------------------------------------------------------

class Pieces:
    """Ids of texts by way of a bounded memory of their pieces.

    The byte-level pre-tokeniser always cuts before a single space between non-blanks, between a letter or digit and
    a following ``,`` or ``.``, and on both sides of a single line break between non-blanks; so a text's ids are
    those of its pieces between these cuts. Every new piece is encoded by the tokenizers library, many at a time,
    with a line break between them. A piece that is not preceded by a space is marked with a leading NUL; texts with
    a NUL of their own, and texts that hold one of the tokenizer's added tokens (``<|endoftext|>``), are encoded whole.
    ``special_as_text`` encodes the strings of special tokens as ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        added = sorted(t.content for t in self.tok.get_added_tokens_decoder().values() if t.content)
        self.whole = ["\0", *added]
        self.blanks = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
        self.narrow = sum(c < "\x80" for c in self.blanks)
        self.line = self.tok.encode("\n", add_special_tokens=False).ids
        self.odd = re.compile(r"[.,](?<![^\W_][.,])")
        self.blank = re.compile(r"\s")
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        self.clear()

    def clear(self):
        self.known = defaultdict(count().__next__)  # a piece looked up for the first time gets the next number
        self.start, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.n = self.used = 0

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        used = self.used + len(ids)
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        self.start[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.flat[self.used:used] = ids
        self.used = used

    def add(self, new: list[str]):
        """Keep the ids of ``new``, the pieces numbered from ``n`` on."""
        numbers = np.arange(self.n, self.n + len(new))
        if len(self.known) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.known)), np.resize(self.size, 2 * len(self.known))
        texts = [p[1:] if p[:1] == "\0" else " " + p for p in new]
        # Pieces with blanks inside (or nothing) could run into the line breaks: those go one by one.
        alone = []
        if "" in new or "\0" in new or self.blank.search("".join(new)):
            alone = [k for k, p in enumerate(new) if not p or p == "\0" or self.blank.search(p)]
        if alone:
            got = self.ids_of([texts[k] for k in alone])
            self.keep(numbers[alone], np.concatenate(got), np.array([len(g) for g in got], np.int64))
            skip = set(alone)
            texts = [t for k, t in enumerate(texts) if k not in skip]
            numbers = np.delete(numbers, alone)
        for lo in range(0, len(texts), 250):
            part = numbers[lo:lo + 250]
            ids = self.ids_of(["\n".join(texts[lo:lo + 250])])[0]
            ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids))
            sizes = np.diff(np.concatenate([[-1], ends])) - 1
            if len(self.line) == 1 and len(sizes) == len(part):
                self.keep(part, ids[ids != self.line[0]], sizes)
            else:  # another vocabulary may cut line breaks otherwise
                got = self.ids_of(texts[lo:lo + 250])
                self.keep(part, np.concatenate(got), np.array([len(g) for g in got], np.int64))
        self.n = len(self.known)

    def numbers(self, found) -> np.ndarray:
        """The number of every piece, those met for the first time encoded and kept."""
        try:
            order = np.fromiter(map(self.known.__getitem__, found), np.int64)
            if len(self.known) > self.n:
                self.add([*islice(reversed(self.known), len(self.known) - self.n)][::-1])
        except BaseException:
            self.clear()  # no number without its ids stays
            raise
        return order

    def plain(self, text: str) -> bool:
        """Single spaces and line breaks between non-blanks only, and no ``,`` or ``.`` but after a letter or digit."""
        if text[:1] in (" ", "\n", "") or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        # Other blanks (tabs, no-break spaces...) may join a line break or a space.
        for c in self.blanks[:self.narrow] if text.isascii() else self.blanks:
            if c in text:
                return False
        return not self.odd.search(text)

    def placed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all texts one after another, number of pieces per text).

        Plain texts are cut by Arrow, and each of their distinct pieces is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc
        plain = np.fromiter(map(self.plain, texts), bool, len(texts))
        others = [self.cut.split(t) for t in compress(texts, ~plain)]
        others = [["\0" + p[0], *(x[1:] for x in p[1:])] for p in others]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~plain] = [len(p) for p in others]
        order = self.numbers(chain.from_iterable(others))
        if not plain.any():
            return order, sizes
        cut = pa.array(["\0" + t for t in compress(texts, plain)], pa.large_string())
        for mark, marked in ((",", " \0,"), (".", " \0."), ("\n", " \0\n \0")):
            cut = pc.replace_substring(cut, mark, marked)
        cut = pc.split_pattern(cut, " ")
        sizes[plain] = np.diff(cut.offsets.to_numpy())
        cut = cut.flatten().dictionary_encode()
        own = self.numbers(cut.dictionary.to_numpy(zero_copy_only=False).tolist())[cut.indices.to_numpy()]
        if plain.all():
            return own, sizes
        out, where = np.empty(len(own) + len(order), np.int64), np.repeat(plain, sizes)
        out[where], out[~where] = own, order
        return out, sizes

    def encode(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text)."""
        if self.n > CACHE_PIECES:
            self.clear()
        whole = [k for k, t in enumerate(texts) if any(s in t for s in self.whole)]
        if whole:
            cut = [-1, *whole, len(texts)]
            runs = []
            for a, b in zip(cut, cut[1:]):
                if b > a + 1:
                    runs.append(self.encode(texts[a + 1:b], end_id))
                if b < len(texts):
                    got = self.ids_of([texts[b]])[0]
                    got = got if end_id is None else np.append(got, np.uint32(end_id))
                    runs.append((got, np.array([len(got)], np.int64)))
            return np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
        order, pieces = self.placed(texts)
        runs, ends = [], np.concatenate([[0], np.cumsum(pieces)])
        for lo in range(0, len(texts), 256):  # the places of few ids at once
            last = ends[lo:lo + 257]
            own = order[last[0]:last[-1]]
            size = self.size[own]
            at = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(self.start[own] - at[:-1], size) + np.arange(at[-1])]
            stop = at[last[1:] - last[0]]
            lens = np.diff(np.concatenate([[0], stop]))
            if end_id is not None:
                ids, lens = np.insert(ids, stop, end_id), lens + 1
            runs.append((ids, lens))
        if not runs:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])


# --- files -----------------------------------------------------------------------------------------------------

def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", vocabulary: int = VOCABULARY, files: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Encode every whole text and write the ids in ascending id order; (file, part, n_docs, n_ids), computed.

    Null texts are empty; null ids come first; rows that share an id are ordered by a hash of their text."""
    import pyarrow as pa
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches):
        pieces = process_cache(f"pieces:{special_as_text}:{tokenizer_path}", lambda: Pieces(tokenizer_path, special_as_text))
        ids, lens, total = [], [], [0]

        def blocks():
            yield MAGIC + struct.pack("<I", vocabulary)
            at, held, wait = 8, [], 0
            for b in batches:
                texts, names = b.column(1).to_pylist(), b.column(0).to_pylist()
                cuts, size = [0], 0
                for k, t in enumerate(texts):
                    size += len(t)
                    if size >= CHUNK_CHARS or k == len(texts) - 1:
                        cuts.append(k + 1)
                        size = 0
                for lo, hi in zip(cuts, cuts[1:]):
                    got, sizes = pieces.encode(texts[lo:hi], end_id)
                    ids.append(np.array([-1 if x is None else x for x in names[lo:hi]], np.int64))
                    lens.append(np.stack([sizes, [x is not None for x in names[lo:hi]]]))
                    held.append(got)
                    wait += len(got)
                    total[0] += len(got)
                    if wait >= BLOCK_IDS:
                        flat = np.concatenate(held)
                        whole = len(flat) - len(flat) % BLOCK_IDS
                        for k in range(0, whole, BLOCK_IDS):
                            out = encode_block(flat[k:k + BLOCK_IDS], vocabulary)
                            at += len(out)
                            yield out
                        held, wait = [flat[whole:]], len(flat) - whole
            if wait:
                out = encode_block(np.concatenate(held), vocabulary)
                at += len(out)
                yield out
            size = np.concatenate(lens, axis=1) if lens else np.zeros((2, 0), np.int64)
            body = zlib.compress(size[1].astype(np.uint8).tobytes() + np.concatenate(ids or [np.zeros(0, np.int64)]).astype("<i8").tobytes()
                                 + size[0].astype("<u4").tobytes())
            yield struct.pack("<4sIII", b"DOCS", size.shape[1], len(body), zlib.crc32(body)) + body + struct.pack("<Q", at) + MAGIC

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.tkm"
        put_file(folder, name, blocks())
        yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "n_docs": [sum(x.shape[1] for x in lens)], "n_ids": [total[0]]})

    return written(ranged.mapInArrow(write, "file string, part long, n_docs long, n_ids long"), "token-files")


def read_file(f, size: int):
    """(documents: validity, ids, lengths; generator of id blocks) of an open token file."""
    def exact(at, n):
        f.seek(at)
        b = f.read(n)
        if len(b) != n:
            raise ValueError("token file is cut off")
        return b

    head, trailer = exact(0, 8), exact(size - 12, 12)
    if head[:4] != MAGIC or trailer[8:] != MAGIC:
        raise ValueError("not a token file")
    vocabulary, end = struct.unpack("<I", head[4:])[0], struct.unpack("<Q", trailer[:8])[0]
    mark, n, length, crc = struct.unpack("<4sIII", exact(end, 16))
    body = exact(end + 16, length)
    if mark != b"DOCS" or zlib.crc32(body) != crc:
        raise ValueError("document table is damaged")
    body = zlib.decompress(body)
    table = (np.frombuffer(body, np.uint8, n), np.frombuffer(body, "<i8", n, n), np.frombuffer(body, "<u4", n, 9 * n))

    def blocks():
        at = 8
        while at < end:
            mark, count, lanes, length, crc = struct.unpack("<4sIIII", exact(at, 20))
            payload = exact(at + 20, length)
            if mark != b"BLOK" or zlib.crc32(payload) != crc:
                raise ValueError(f"block at {at} is damaged")
            yield decode_block(count, lanes, payload, vocabulary)
            at += 20 + length

    return table, blocks()


def read_tokens(files: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """Read files written by ``write_tokens``: (doc_id, start, n_tokens, ids_crc32[, ids]) per document."""
    import pyarrow as pa
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if ids else []
    schema = pa.schema(fields)

    def read(batches):
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = task_fs(folder.rstrip("/") + "/" + name)
                with fs.open_input_file(path) as f:
                    (valid, names, lens), blocks = read_file(f, f.size())
                    rows, k, crc, need, start, own = [], 0, 0, int(lens[0]) if len(lens) else 0, base, []
                    for block in blocks:
                        raw, at = block.astype("<u4"), 0
                        while k < len(lens) and (at < len(raw) or need == 0):
                            take = raw[at:at + need]
                            crc = zlib.crc32(take.tobytes(), crc)
                            if ids:
                                own.append(take.astype(np.int32))
                            at += len(take)
                            need -= len(take)
                            if need:
                                break
                            row = (int(names[k]) if valid[k] else None, start, int(lens[k]), crc)
                            rows.append(row + (np.concatenate(own),) if ids else row)
                            start += int(lens[k])
                            k, crc, own = k + 1, 0, []
                            need = int(lens[k]) if k < len(lens) else 0
                        if len(rows) > 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                    while k < len(lens) and need == 0:
                        row = (int(names[k]) if valid[k] else None, start, 0, 0)
                        rows.append(row + (np.zeros(0, np.int32),) if ids else row)
                        k += 1
                        need = int(lens[k]) if k < len(lens) else 0
                    if k < len(lens):
                        raise ValueError(f"{name} has fewer ids than its documents")
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    # One row per file: its documents start after the ids of all earlier files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).where("n_docs > 0").select("file", "base")
    n = max(files.count(), 1)
    return placed.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def op1_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents to token files and read the files back."""
    import public_tokenizers
    folder = shared_folder(spark, "tokens")
    files = write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(files, folder)
