"""Language identification of whole and mixed-language texts.

A word's score for a language is the sum of the log probabilities of its byte trigrams (with word edges), learned as
hashed counts over all labelled documents. The script of a word, told from code-point ranges, narrows its candidates
to the languages that were seen to use that script. Viterbi over the words, with a penalty for every switch, labels
the spans of a text; the text's language is the one with the most letters (ties: the smaller name), the score its
share of the letters.

Model size: ``BUCKETS`` floats per language, whatever the size of the corpus; that table alone reaches the driver.

Defined results: ``und`` with score 0 for texts that are null or have no letter, and where no language was learned;
a null language teaches nothing; repeated rows count each time; an empty table gives no rows; columns besides the
named ones are not read, whatever they are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tabflow.llm.common import col, documents, free_name
from tabflow.llm.textvec import row_bounds, slices, spans, utf8

BUCKETS = 1 << 15
SWITCH_PENALTY = 10.0
#: Least share of a language's words in a script for the language to be a candidate for words in that script.
SCRIPT_SHARE = 0.005
#: First code points of runs of scripts, with the script (fixed values); Latin is 0.
SCRIPTS = ((0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0900, 6), (0x0980, 7),
           (0x0E00, 8), (0x10A0, 9), (0x1100, 10), (0x1200, 11), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 12),
           (0x3100, 13), (0xAC00, 10), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0))
N_SCRIPTS = 14
#: Words handled by one Viterbi run (whole texts; a longer text is a run of its own).
RUN_WORDS = 1_000_000


def scan(data: np.ndarray, offs: np.ndarray):
    """(starts, ends, script of each word, trigram bucket per byte, bytes that carry a trigram) of a slice."""
    n = len(data)
    low = data.copy()
    up = (data >= 65) & (data <= 90)
    low[up] += 32
    latin = np.zeros(n, bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[latin] += 32
    letter = ((low >= 97) & (low <= 122)) | (data >= 0x80)
    # Signs are no letters: U+0080 to U+00BF but ª µ º, × and ÷, U+2000 to U+2BFF, U+3000 to U+3004, U+1F000 to U+1FFFF.
    d1, d2 = np.append(data[1:], 0), np.append(data[2:], (0, 0))[:n]
    two = ((data == 0xC2) & (d1 != 0xAA) & (d1 != 0xB5) & (d1 != 0xBA)) | ((data == 0xC3) & ((d1 == 0x97) | (d1 == 0xB7)))
    three = ((data == 0xE2) & (d1 < 0xB0)) | ((data == 0xE3) & (d1 == 0x80) & (d2 <= 0x84))
    four = (data == 0xF0) & (d1 == 0x9F)
    for lead, size in ((two, 2), (three, 3), (four, 4)):
        at = np.flatnonzero(lead)
        for k in range(size if len(at) else 0):
            letter[np.minimum(at + k, n - 1)] = False
    starts, ends = spans(letter, offs)
    z = np.where(letter, low, 0).astype(np.uint32)
    z1, z2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    z1[1:], z2[2:] = z[:-1], z[:-2]
    heads = offs[:-1][offs[:-1] < n]
    z1[heads] = z2[heads] = 0
    z2[heads[heads + 1 < n] + 1] = 0
    code = ((((z2 << np.uint32(16)) | (z1 << np.uint32(8)) | z) * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
    script = np.zeros(len(starts), np.int64)
    lead = np.flatnonzero(data >= 0xCD)  # below this lead byte every letter is Latin
    if len(lead):
        b = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        x, y, w = b[lead], b[lead + 1] & 63, b[lead + 2] & 63
        # Four bytes: U+20000 and up are Han, those below of no script here.
        cp = np.where(x < 0xE0, ((x & 31) << 6) | y, np.where(x < 0xF0, ((x & 15) << 12) | (y << 6) | w, np.where((x > 0xF0) | (y >= 32), 0x4E00, 0)))
        starts_of, kinds = np.array(SCRIPTS).T
        kind = kinds[np.searchsorted(starts_of, cp, "right") - 1]
        other = (kind > 0) & letter[lead]
        script[np.searchsorted(starts, lead[other], "right") - 1] = kind[other]
    return starts, ends, script, code, (z > 0) | (z1 > 0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """Model from the rows with a language: trigram log probabilities and the scripts of each language."""
    import pyarrow as pa

    def count(batches):
        total = {}
        for b in batches:
            data, offs = utf8(b.column(0))
            langs = np.array(b.column(1).to_pylist(), object)
            for i, j, d, o in slices(data, offs):
                starts, _, script, code, use = scan(d, o)
                row = np.repeat(np.arange(j - i), np.diff(o))
                row_w = np.searchsorted(o, starts, "right") - 1
                names, which = np.unique(langs[i:j].astype(str), return_inverse=True)
                grams = np.bincount(which[row[use]] * BUCKETS + code[use], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                kinds = np.bincount(which[row_w] * N_SCRIPTS + script, minlength=len(names) * N_SCRIPTS).reshape(len(names), N_SCRIPTS)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + np.concatenate([grams[k], kinds[k]])
        for name, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(x[at])], ["lang", "at", "n"])

    rows = docs.where(col(lang_col).isNotNull()).select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    got = rows.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    if got.empty:
        return None
    names = sorted(got["lang"].unique())
    table = np.zeros((len(names), BUCKETS + N_SCRIPTS))
    table[np.searchsorted(names, got["lang"].to_numpy().astype(str)), got["at"].to_numpy()] = got["n"].to_numpy()
    grams, kinds = table[:, :BUCKETS], table[:, BUCKETS:]
    logp = np.log(grams + 0.5) - np.log(grams.sum(1, keepdims=True) + 0.5 * BUCKETS)
    uses = kinds >= SCRIPT_SHARE * np.maximum(kinds.sum(1, keepdims=True), 1)
    uses[:, ~uses.any(0)] = True
    return {"langs": names, "logp": np.ascontiguousarray(logp.T.astype(np.float32)), "uses": uses.T.copy()}


def viterbi(emit: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Label per word of the best path of each text; text i has the words first[i]..first[i + 1]. All texts step together."""
    words, k = emit.shape
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    begin, size = first[:-1][order], lens[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more than t words
    switched, best = np.zeros((words, k), bool), np.zeros(words, np.int16)
    v = np.zeros((len(size), k), np.float32)
    for t in range(longest):
        m = active[t]
        at = begin[:m] + t
        cur = v[:m]
        if t:
            arg = cur.argmax(1)
            jump = cur[np.arange(m), arg][:, None] - np.float32(penalty)
            sw = jump > cur
            switched[at], best[at] = sw, arg
            cur = np.where(sw, jump, cur)
            cur -= cur.max(1, keepdims=True)
        v[:m] = cur + emit[at]
    label = np.zeros(words, np.int16)
    state = np.zeros(len(size), np.int64)
    done = 0
    for t in range(longest - 1, -1, -1):
        m = active[t]
        if m > done:
            state[done:m] = v[done:m].argmax(1)
            done = m
        at = begin[:m] + t
        s = state[:m]
        label[at] = s
        state[:m] = np.where(switched[at, s], best[at], s)
    return label


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = SWITCH_PENALTY, with_spans: bool = False, carry: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]); a span is (start, end, lang) in bytes of the UTF-8 text.

    ``carry=True`` keeps all columns of ``docs`` in place of the id (underscores are added to clashing new names)."""
    import pyarrow as pa
    rows = docs if carry else docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    text_at = rows.columns.index(text_col if carry else "text")
    kept = list(range(len(rows.columns))) if carry else [0]
    new = ["lang_pred", "score"] + ["spans"] * with_spans
    names = [f"c{i}" for i in kept] + new
    types = {"lang_pred": "string", "score": "double", "spans": "array<struct<start:long,end:long,lang:string>>"}
    schema = StructType([StructField(f"c{i}", rows.schema.fields[i].dataType) for i in kept]
                        + [StructField(n, _parse_datatype_string(types[n])) for n in new])
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches):
        langs = model["langs"] if model else []
        k = len(langs)

        def flush(held):
            old = [pa.concat_arrays([h[0].column(i) for h in held]) for i in kept]
            texts = [t for h in held for t in h[1]]
            emit = np.concatenate([h[2] for h in held])
            letters = np.concatenate([h[3] for h in held])
            base = np.cumsum([0] + [len(h[2]) for h in held])
            first = np.concatenate([h[4][:-1] + b for h, b in zip(held, base)] + [base[-1:]])
            ascii_ = np.concatenate([h[5] for h in held])
            label = viterbi(emit, first, penalty)
            row = np.repeat(np.arange(len(texts)), np.diff(first))
            share = np.bincount(row * k + label, weights=letters, minlength=len(texts) * k).reshape(-1, k)
            total = share.sum(1)
            pick = share.argmax(1)
            ok = np.array([bool(t) and (a or has_letter(x.as_py())) for t, a, x in zip(total, ascii_, texts)], bool)
            cols = [*old, pa.array([langs[p] if o else "und" for p, o in zip(pick, ok)], pa.string()),
                    pa.array(np.where(ok, share[np.arange(len(texts)), pick] / np.maximum(total, 1), 0.0))]
            if with_spans:
                starts, ends = (np.concatenate([h[i] for h in held]) for i in (6, 7))
                out = []
                for i in range(len(texts)):
                    a, b = first[i], first[i + 1]
                    cut = np.flatnonzero(np.diff(label[a:b])) + 1
                    cuts = np.concatenate([[0], cut, [b - a]]) if b > a else np.zeros(1, int)
                    out.append([{"start": int(starts[a + p]), "end": int(ends[a + q - 1]), "lang": langs[label[a + p]]}
                                for p, q in zip(cuts, cuts[1:])] if ok[i] else [])
                cols.append(pa.array(out, pa.list_(kind)))
            return pa.RecordBatch.from_arrays(cols, names)

        held, words = [], 0
        for b in batches:
            if not k:
                cols = [*(b.column(i) for i in kept), pa.array(["und"] * len(b), pa.string()), pa.array(np.zeros(len(b)))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([[]] * len(b), pa.list_(kind))] if with_spans else []), names)
                continue
            data, offs = utf8(b.column(text_at))
            for i, j, d, o in slices(data, offs, max(1 << 16, (1 << 20) // k)):
                starts, ends, script, code, use = scan(d, o)
                score = np.zeros((len(d) + 1, k), np.float64)
                np.cumsum(np.where(use[:, None], model["logp"][code], np.float32(0)), axis=0, dtype=np.float64, out=score[1:])
                stop = np.minimum(ends + 1, o[np.searchsorted(o, starts, "right")])  # the byte after a word carries its edge
                emit = (score[stop] - score[starts]).astype(np.float32)
                emit[~model["uses"][script]] -= np.float32(1e4)
                first = row_bounds(starts, o)
                plain = np.concatenate([[0], np.cumsum((d | 32 >= 97) & (d | 32 <= 122) & (d < 128))])
                row_at = o[np.searchsorted(o, starts, "right") - 1]
                points = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
                held.append((b.slice(i, j - i), b.column(text_at)[i:j], emit, (points[ends] - points[starts]).astype(float), first,
                             plain[o[1:]] > plain[o[:-1]], starts - row_at, ends - row_at))
                words += len(emit)
                if words >= RUN_WORDS:
                    yield flush(held)
                    held, words = [], 0
        if held:
            yield flush(held)

    out = rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).mapInArrow(run, schema)  # plain names for the way
    last = [c for c in rows.columns] if carry else ["doc_id"]
    for n in new:
        last.append(free_name(n, last))
    return out.toDF(*last)


def fold(id_col, folds: int):
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents of three folds and predict the language of all."""
    docs = documents(spark, sf_dir)
    model = learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
