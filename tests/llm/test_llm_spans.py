"""Filter audit (op11), repeated spans (op12) and vector codes (op13) against SQL and brute force."""

import hashlib
import itertools
import math
import random
import re
import sys
import os

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_helpers import docs, same_as_sql  # noqa: E402

from tabflow.llm import filteraudit, hilbertpq, substrings  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("query, sql", [(filteraudit.op11_filteraudit, filteraudit.OP11_SQL),
                                        (substrings.op12_substrings, substrings.OP12_SQL),
                                        (hilbertpq.op13_hilbertpq, hilbertpq.OP13_SQL)])
def test_queries_equal_their_sql(spark, query, sql):
    same_as_sql(query(spark, SF), sql, SF)


# --- op11 -------------------------------------------------------------------------------------------------------

def audit_by_hand(rows, labels):
    """{(part, order, step): counts} straight from the definition, document by document."""
    last = 1 << 70
    ids = [last if r[0] is None else r[0] for r in rows]
    texts = [r[1] or "" for r in rows]
    fails, good, toxic = [], [], []
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": any(u == t and j < ids[i] for u, j in zip(texts, ids))}
        fails.append({k for k, v in f.items() if v})
        own = [x for x in labels if rows[i][0] is not None and x[0] == rows[i][0]]
        good.append(any(x[1] == 1 for x in own))
        toxic.append(any(x[2] == 1 for x in own))
    out = {}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {r[2] or "" for r in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shap = dict.fromkeys("ABCDE", 0)
        for o in orders:
            left = set(mine)
            for s, c in enumerate(o, 1):
                gone = {i for i in left if c in fails[i]}
                redundant = sum(c in fails[i] for i in mine if i not in left)
                left -= gone
                shap[c] += len(gone)
                out[part, o, s] = [len(left), len(gone), redundant, sum(fails[i] == {c} for i in mine), sum(good[i] for i in gone), sum(toxic[i] for i in gone)]
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shap[o[s - 1]])
    return out


def test_audit_equals_the_definition_on_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(5)
    long_ = " ".join(f"w{i}" for i in range(250))
    texts = [long_, None, "", "a a a a # b", "SHOUT " * 300, long_ + " $", " \t\n", "é" * 50 + "A", "x " * 100_000]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice([None, "", "en", "d.e"])) for _ in range(60)]
    rows += rows[:10]
    labels = [(rng.choice([None, *range(14)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(12)]
    d = spark.createDataFrame([(i, t, p, 1, 2, 3, 4) for i, t, p in rows], "doc_id long, text string, lang string, key int, n int, mask int, `a.b` int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[f] for f in filteraudit.FIELDS] for r in
           filteraudit.audit(filteraudit.mask_weights(d, lab), "ABCDE").collect()}
    assert got == audit_by_hand(rows, labels)


def test_audit_of_no_rows_and_of_no_labels(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(filteraudit.mask_weights(d, lab), "ABCDE").count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert filteraudit.audit(filteraudit.mask_weights(one, lab), "ABCDE").count() == 600


def test_removal_step_is_the_first_failing_filter():
    orders = np.array(list(itertools.permutations(range(4))))
    masks = np.array([[bool(m >> i & 1) for i in range(4)] for m in range(16)])
    steps = filteraudit.removal_steps(masks, np.argsort(orders, axis=1) + 1)
    for m, o in itertools.product(range(16), range(24)):
        want = next((s for s, f in enumerate(orders[o], 1) if masks[m, f]), 5)
        assert steps[m, o] == want


# --- op12 -------------------------------------------------------------------------------------------------------

def spans_by_hand(rows, length):
    """(n_words, n_removed, kept) per row from the definition."""
    last = (1 << 63) - 1
    ids = [last if i is None else i for i, _ in rows]
    ws = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for i, w in zip(ids, ws):
        for p in range(len(w) - length + 1):
            k = tuple(w[p:p + length])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in zip(ids, ws):
        gone = {j for p in range(len(w) - length + 1) if first[tuple(w[p:p + length])] < i for j in range(p, p + length)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("length, seed", [(3, 1), (6, 2), (9, 3), (50, 4)])
def test_spans_equal_the_definition(spark, length, seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "Ä", "c d", "€"] if length < 9 else [f"w{i}" for i in range(30)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [make(length + rng.randrange(2 * length)) for _ in range(3)]
    texts = [None, "", " \t\n ", " ".join(make(length - 1))]
    for _ in range(40):
        w = make(rng.randrange(3 * length))
        for _ in range(rng.randrange(3)):
            s = list(rng.choice(shared))
            if rng.random() < 0.4:
                s[rng.randrange(len(s))] = "edit"
            at = rng.randrange(len(w) + 1)
            w[at:at] = s
        texts.append("".join(x + rng.choice([" ", "\n", "\t ", "\r\x0b\x0c"]) for x in w))
    texts += rng.sample(texts, 10)
    ids = [rng.choice([None, i, i, i % 7, -i]) for i in range(len(texts))]
    rows = list(zip(ids, texts)) + list(zip(ids, texts))[:8]
    d = docs(spark, [t for _, t in rows], extra=True, ids=[i for i, _ in rows])
    for name in ("ord", "th", "gone", "kept_text", "n_words", "p", "q", "node", "h1", "src"):
        d = d.withColumn(name, d["doc_id"] * 0 + 77)
    out = substrings.dedup_substrings(d, length=length)
    assert out.columns[:len(d.columns)] == d.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r[-2], r[-1], r[-3]) for r in out.collect())
    want = sorted((i is None, i or 0, t or "", *v) for (i, t), v in zip(rows, spans_by_hand(rows, length)))
    assert got == want
    assert all(r["ord"] == 77 and r["gone"] == 77 for r in out.where("doc_id is not null").collect())


def test_spans_of_no_rows_and_of_a_long_text(spark):
    assert substrings.dedup_substrings(docs(spark, [])).count() == 0
    text = " ".join(f"t{i % 9973}" for i in range(120_000))  # repeats within itself only
    out = substrings.dedup_substrings(docs(spark, [text, "x " + text + " y"])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"]) for r in out] == [(120_000, 0), (120_002, 120_000)]
    assert out[1]["kept_text"] == "x y"


def test_spans_say_where_they_come_from(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = ["start " + passage + " end", "other begin " + passage, "nothing here"]
    got = [tuple(r)[:1] + tuple(r)[2:5] + tuple(r)[6:] for r in substrings.repeated_spans(docs(spark, texts)).collect()]
    assert got == [(1, 2, 62, 0, 1)]


def test_every_window_lies_in_one_edge_and_its_node_is_its_own_minimum():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    first = np.array([0, 120, 120, 260, 400])
    pre = [substrings.rolling(h), substrings.rolling(substrings.mix(h))]
    r, p, q, node, *_ = substrings.edges_of(first, pre, 12, 4)
    seen = {}
    for a, b, c, n in zip(r, p, q, node):
        for w in range(b, c + 1):
            assert (a, w) not in seen
            seen[a, w] = n
    for a in range(4):
        for w in range(first[a + 1] - first[a] - 12 + 1):
            k = first[a] + w + np.arange(9)
            assert seen[a, w] == substrings.span_hash(pre[0], k, k + 4).min().view(np.int64)


# --- op13 -------------------------------------------------------------------------------------------------------

def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """{position: (code, error, label_error)} and the digest, in Python integers."""
    ok = [(i, [float(x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not ok:
        return [], None
    d = max(1, -(-max(len(v) for _, v, _ in ok) // parts))
    scaled = lambda x: int(x) * 4096 if abs(x) >= 1 << 52 else math.floor(x * 4096)
    full = [[scaled(x) for x in v + [0.0] * (parts * d - len(v))] for _, v, _ in ok]
    order = sorted(range(len(ok)), key=lambda k: (ok[k][0] is None, ok[k][0] or 0, ok[k][1]))[:entries]
    cut = lambda v, p: v[p * d:(p + 1) * d]
    books = [[cut(full[k], p) for k in order] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in full:
                got.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for j, pts in got.items():
                books[p][j] = [sum(x) // len(pts) for x in zip(*pts)]
    out, total = [], {}
    for (i, _, l), v in zip(ok, full):
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        err = sum(b[0] for b in best)
        out.append([i, "".join(f"{b[1]:02x}" for b in best), err, l])
        total[l] = total.get(l, 0) + err
    long_ = lambda x: x if x < 1 << 63 else None
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, c, long_(e), long_(total[l]) if all(long_(o[2]) is not None for o in out if o[3] == l) else None) for i, c, e, l in out], hashlib.sha256(text.encode()).hexdigest()


def check_codes(spark, rows):
    df = spark.createDataFrame([(i, v, l, 5, 6, 7) for i, v, l in rows], "vec_id long, embedding array<double>, label int, part int, at int, `n.x` int")
    got = hilbertpq.quantise(df).collect()
    want, digest = codes_by_hand(rows)
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} <= {digest}


def test_codes_equal_plain_integers_on_ties_nulls_and_repeated_rows(spark):
    rng = random.Random(8)
    some = [[rng.choice([-0.5, -0.25, 0.0, 1e-5, 0.3]) for _ in range(16)] for _ in range(12)]
    rows = [(rng.choice([None, i, i, 3]), list(rng.choice(some)), rng.choice([None, 0, 1])) for i in range(150)]
    rows += [(1000, None, 1), (1001, [0.1] * 15 + [None], 1), (1002, [0.1] * 15 + [float("nan")], 0), (1003, [float("inf")] + [0.0] * 15, 0),
             (-1, [0.1, -0.2], 0), (1004, [], None)]
    check_codes(spark, rows)


def test_codes_of_a_hot_vector_few_rows_and_none(spark):
    rng = random.Random(9)
    hot = [rng.uniform(-1, 1) for _ in range(24)]
    check_codes(spark, [(i, hot if i % 3 else [rng.uniform(-1, 1) for _ in range(24)], i % 4) for i in range(900)])
    check_codes(spark, [(i, [rng.uniform(-1, 1) for _ in range(8)], None) for i in range(3)])
    check_codes(spark, [])


@pytest.mark.parametrize("size", [4e4, 1e9, 1e17, 1e300])
def test_codes_of_large_components_are_exact(spark, size):
    rng = random.Random(10)
    check_codes(spark, [(i, [rng.uniform(-size, size) for _ in range(16)], i % 2) for i in range(60)])


def test_the_curve_visits_neighbours():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = [k.tobytes() for k in hilbertpq.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_keep_every_nearest_entry_and_drop_most():
    rng = np.random.default_rng(4)
    book = rng.integers(-4096, 4096, (16, 4))
    book[5] = book[3]
    kept = 0
    for _ in range(200):
        pts = rng.integers(-4096, 4096, 4) + rng.integers(-300, 300, (40, 4))
        short = hilbertpq.shortlist(pts.min(axis=0)[None], pts.max(axis=0)[None], book)[0]
        at, dist = hilbertpq.nearest(pts, book)
        few = np.flatnonzero(short)
        at2, dist2 = hilbertpq.nearest(pts, book[few])
        assert (few[at2] == at).all() and (dist == dist2).all()
        kept += len(few)
    assert kept < 200 * 8
