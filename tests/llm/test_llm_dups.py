"""Line dedup, Jaccard join and near-duplicate vectors against brute force."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_helpers import docs, rows, same_as_sql  # noqa: E402

from tabflow.llm import common, crosspoly, jaccard, linededup  # noqa: E402

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def brute_lines(pairs, least=16):
    seen, out = [], []
    for i, text in pairs:
        if text is None:
            out.append((i, None, 0))
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            if len(line) >= least:
                if any(near(line, s) for s in seen):
                    seen.append(line)
                    gone += 1
                    continue
                seen.append(line)
            kept.append(line)
        out.append((i, "\n".join(kept), gone))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([15, 16, 17, 40, 90]))) for _ in range(25)]
    base += ["aaaaaaaaaaaaaaaaaaaaaaaa", "b" * 17, "b" * 18, "b" * 19]

    def touched(line):
        at, how = rng.randrange(len(line)), rng.choice("nrid")
        if how == "n":
            return line
        return line[:at] + {"r": "z" + line[at + 1:], "i": "z" + line[at:], "d": line[at + 1:]}[how]

    texts = ["\n".join(touched(rng.choice(base)) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    got = linededup.dedup_lines(docs(spark, texts).select("doc_id", "text"))
    assert rows(got, "doc_id", "text", "lines_dropped") == brute_lines(list(enumerate(texts)))


def test_lines_edge_cases(spark):
    long = "word " * 30000
    texts = [None, "", "short\nshort\n\n\n", "a line of some length", "a line of some lengths\r", long, long + "x", "A line of some length"]
    got = linededup.dedup_lines(docs(spark, texts, extra=True))
    assert set(got.columns) >= {"lines_dropped", "lines_dropped_", "a.b"}
    assert rows(got.select("doc_id", "text", "lines_dropped_"), "doc_id", "text", "lines_dropped_") == brute_lines(list(enumerate(texts)))
    twice = linededup.dedup_lines(docs(spark, ["one same long line", "one same long line", "one same long line"], ids=[1, 1, None]))
    assert rows(twice, "doc_id", "text") == [(1, "one same long line"), (1, "one same long line"), (None, "")]
    assert linededup.dedup_lines(docs(spark, [])).count() == 0
    only_equal = linededup.dedup_lines(docs(spark, ["a line of some length", "a line of some lengtH"]), max_edits=0)
    assert rows(only_equal, "lines_dropped") == [(0,), (0,)]


def test_lines_of_rows_that_share_an_id(spark):
    a, b, c, d = ("the %s line of these documents" % w for w in ("first", "second", "third", "very last"))
    texts = [a, f"{b}\n{c}", f"{a}\n{d}", f"{d}\n{b}", "no other line is like it", c + " again", c + " again", c + " again\nx", None, None]
    ids = [1, None, None, 7, 7, None, None, None, None, 7]
    got = linededup.dedup_lines(docs(spark, texts, ids=ids))
    assert got.count() == len(texts)
    kept = [(r.doc_id, line) for r in got.collect() if r.text for line in r.text.split("\n")]
    assert sorted(line for _, line in kept if len(line) >= 16) == sorted([a, b, c, d, "no other line is like it", c + " again"])
    assert {line: i for i, line in kept if line in (b, d, "no other line is like it")} == {b: 7, d: 7, "no other line is like it": 7}
    assert sum(r.lines_dropped for r in got.collect()) == 5
    assert sum(r.text is None for r in got.collect()) == 2


def test_lines_of_one_large_group(spark):
    """Many lines at one position: each is dropped but the earliest, without all pairs."""
    texts = [f"the same long line number {chr(0x4e00 + i)} of them" for i in range(1500)]
    got = linededup.dedup_lines(docs(spark, texts))
    assert rows(got.where("lines_dropped = 0"), "doc_id") == [(0,)]


def test_op4_sql(spark):
    same_as_sql(linededup.op4_linededup(spark, SF), linededup.OP4_SQL, SF)


# --- Jaccard ---------------------------------------------------------------------------------------------------

def shingles(text, k=5):
    import re
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, num=75, den=100):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def test_jaccard_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    seeds = [[rng.choice(words) for _ in range(rng.choice([5, 8, 30, 80]))] + passage * rng.choice([0, 0, 1]) for _ in range(30)]
    texts = []
    for _ in range(220):
        t = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in t))
    got = jaccard.jaccard_components(docs(spark, texts))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(texts)


def test_jaccard_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(20000))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c d e", "A  b\nc d e", long, long + " x", "é ß", "É ß", "  x"]
    got = jaccard.jaccard_components(docs(spark, texts, extra=True))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(texts)
    twice = jaccard.jaccard_components(docs(spark, ["same words here", "same words here", "same words here", "q"], ids=[4, 4, None, None]))
    assert rows(twice, "doc_id", "component_id") == [(4, 4), (4, 4), (None, None), (None, None)]
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_jaccard_large_near_group_stays_linear(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(300):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(len(t))] = f"x{i}{rng.random()}"
        texts.append(" ".join(t))
    got = jaccard.jaccard_components(docs(spark, texts))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(texts)


def test_op10_sql(spark):
    same_as_sql(jaccard.op10_jaccard(spark, SF), jaccard.OP10_SQL, SF)


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    texts = [one, one, one + " more", two, two, two + " more", three, "only " + three[::-1], three + " more", "", "", None]
    ids = [4, 4, None, None, None, None, 7, 7, 2, 9, 9, None]
    for order in (range(len(texts)), reversed(range(len(texts)))):
        order = list(order)
        got = corpus_pipeline.near_duplicates(spark, docs(spark, [texts[i] for i in order], ids=[ids[i] for i in order]), SF)
        kept = [(r.doc_id, r.text) for r in got.collect()]
        assert [k for k in kept if k[1] and k[1].startswith("a")] == [(4, one)]
        assert len([k for k in kept if k[1] and k[1].startswith("b")]) == 1
        assert (2, three + " more") in kept and (7, three) not in kept and (7, texts[7]) in kept
        assert len(kept) == 4 + 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 130), (130, 120), (120, 110), (200, 200), (300, 301), (300, 302), (301, 302)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 61)} | {k: 100 for k in (100, 110, 120, 130)} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- vectors ---------------------------------------------------------------------------------------------------

def brute_vectors(data, threshold=0.93):
    ok = {}
    for k, (i, v, lab) in enumerate(data):
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    root, links = {k: k for k in range(len(data))}, [0] * len(data)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(ok)
    for x in keys:
        for y in keys:
            if x < y and data[x][2] == data[y][2] and len(ok[x]) == len(ok[y]) and float(ok[x] @ ok[y]) >= threshold:
                links[x] += 1
                links[y] += 1
                a, b = find(x), find(y)
                root[b] = a
    smallest = {}
    for k in range(len(data)):
        if data[k][0] is not None:
            smallest[find(k)] = min(smallest.get(find(k), 10 ** 18), data[k][0])
    return sorted(((d[0], links[k], smallest.get(find(k)) if d[0] is not None else None) for k, d in enumerate(data)),
                  key=lambda t: tuple((x is None, x) for x in t))


def vector_frame(spark, data):
    return spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in data], "vec_id long, embedding array<float>, label int, rep int, size int")


def test_vectors_against_brute_force_with_small_blocks(spark):
    rng = np.random.default_rng(7)
    data, n = [], 0
    for lab in (0, 1, 1, 2):
        centre = rng.normal(size=32)
        for _ in range(60):
            v = (centre + 0.09 * rng.normal(size=32)).astype(np.float32).tolist()
            data.append((n, v, lab))
            n += 1
    data += [(n + k, data[k][1], data[k][2]) for k in range(0, 40, 3)]
    for block in (16, 512):
        got = crosspoly.near_vectors(vector_frame(spark, data), block=block)
        assert rows(got, "vec_id", "n_links", "component_id") == brute_vectors(data)


def test_vectors_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, nan], 1), (5, [1.0, inf], 1), (6, [1.0, 0.0], None),
            (7, [1.0, 0.0], 1), (8, [2.0, 0.1], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [5.0], 1), (13, [3.0], 1)]
    got = crosspoly.near_vectors(vector_frame(spark, data))
    assert rows(got, "vec_id", "n_links", "component_id") == brute_vectors(data)
    assert {r.vec_id: r.kept for r in got.collect() if r.vec_id is not None} == {r[0]: r[0] == r[2] for r in brute_vectors(data) if r[0] is not None}
    assert crosspoly.near_vectors(vector_frame(spark, [])).count() == 0


def test_vector_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(3000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.935 * x + np.sqrt(1 - 0.935 ** 2) * y
    cx, cy = crosspoly.codes(x), crosspoly.codes(y)
    a, b = crosspoly.met(cx[:, :, 0], cx, cy[:, :, 0], cy)
    assert (a | b).any(1).mean() >= 0.9


def test_op8_sql(spark):
    same_as_sql(crosspoly.op8_crosspoly(spark, SF), crosspoly.OP8_SQL, SF)
