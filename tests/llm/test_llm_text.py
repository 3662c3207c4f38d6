"""Mixing, quality, fingerprints, language ID and the pipeline: brute force, exact SQL or held-out accuracy."""

import hashlib
import math
import os
import random
import sys

import re

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_helpers import docs, duck, rows, same_as_sql  # noqa: E402

from tabflow.llm import langid, mixing, packing, quality, syncmers  # noqa: E402

SF = "/root/testdata/sf0.001"


# --- mixing ----------------------------------------------------------------------------------------------------

def brute_fill(caps, weights, budget):
    """Whole-token water filling of {name: cap}: saturate what cannot take its share, then largest remainders."""
    share, open_ = {}, {k for k in caps if weights[k] > 0}
    left = budget
    while open_:
        w = sum(weights[k] for k in open_)
        full = [k for k in open_ if caps[k] * w <= weights[k] * left]
        if not full:
            base = {k: weights[k] * left // w for k in open_}
            extra = left - sum(base.values())
            order = sorted(open_, key=lambda k: (-(weights[k] * left % w), k is not None, k or ""))
            share |= {k: base[k] + (r < extra) for r, k in enumerate(order)}
            return share
        k = min(full, key=lambda k: caps[k] / weights[k])
        share[k] = caps[k]
        left -= caps[k]
        open_.remove(k)
    return share


def brute_mix(data, weights, num, den, epochs, seed):
    """data: (id, a, b, n). Budgets by level, then a seeded prefix of each leaf's documents."""
    leaf = {}
    for i, a, b, n in data:
        if n:
            leaf.setdefault((a, b), []).append((i, n))
    have = {k: sum(n for _, n in v) for k, v in leaf.items()}
    tops = {a for a, _ in have}
    top = brute_fill({a: epochs * sum(h for k, h in have.items() if k[0] == a) for a in tops}, {a: weights["a"].get(a, 1) for a in tops},
                     sum(have.values()) * num // den)
    out = []
    for a in top:
        kids = {b: epochs * h for (x, b), h in have.items() if x == a}
        for b, s in brute_fill(kids, {b: weights["b"].get(b, 1) for b in kids}, top[a]).items():
            whole, rest = divmod(s, have[a, b])
            for e in range(whole):
                out += [(i, a, b, e, n, n) for i, n in leaf[a, b]]
            key = lambda x: (int(hashlib.md5(f"{seed}:{whole}:{'' if x[0] is None else x[0]}".encode()).hexdigest()[:15], 16), x)  # noqa: E731, B023
            for i, n in sorted(leaf[a, b], key=key):
                if rest > 0:
                    out.append((i, a, b, whole, n, min(n, rest)))
                    rest -= n
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def mix_frame(spark, data):
    return spark.createDataFrame([(i, a, b, " ".join(["w"] * n), 1, 2) for i, a, b, n in data], "doc_id long, a string, b string, text string, epoch int, n_tokens int")


def test_mixing_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    data = [(i, rng.choice(["x", "y", None]), rng.choice(["p", "q", "r", None]), rng.choice([0, 1, 5, 30])) for i in range(300)]
    weights = {"a": {"x": 5, "y": 0}, "b": {"p": 7, None: 3}}
    for docs_per_range in (4, 20_000):
        monkeypatch.setattr(mixing, "RANGE_DOCS", docs_per_range)
        for num, den, epochs in ((1, 2, 1), (9, 10, 1), (3, 2, 3), (50, 1, 2), (0, 1, 2)):
            got = mixing.mix_sources(mix_frame(spark, data), ["a", "b"], weights, (num, den), epochs, seed="s")
            assert rows(got, "doc_id", "a", "b", "epoch", "n_tokens", "taken") == brute_mix(data, weights, num, den, epochs, "s")


def test_mixing_edge_cases(spark):
    data = [(1, "x", "p", 3), (1, "x", "p", 3), (None, "x", "p", 2), (4, "x", "p", 0)]
    got = mixing.mix_sources(mix_frame(spark, data), ["a", "b"], {}, (1, 1), 1)
    assert rows(got, "doc_id", "taken") == [(1, 3), (1, 3), (None, 2)]
    assert mixing.mix_sources(mix_frame(spark, []), ["a", "b"], {}).count() == 0
    kept = mixing.select_documents(mix_frame(spark, data), ["a", "b"], {}, (1, 1))
    assert rows(kept, "doc_id") == [(1,), (1,), (None,)] and kept.columns[-1] == "n_tokens"


def test_whole_rows_are_repeated_as_epochs_take_them(spark, monkeypatch):
    rng = random.Random(12)
    data = [(i, rng.choice(["x", "y", None]), rng.choice(["p", "q", None]), rng.choice([0, 1, 5, 30])) for i in range(200)]
    weights = {"a": {"x": 5, "y": 0}, "b": {"p": 7, None: 3}}
    for docs_per_range in (4, 20_000):
        monkeypatch.setattr(mixing, "RANGE_DOCS", docs_per_range)
        for num, den, epochs in ((9, 10, 1), (3, 2, 3), (50, 1, 2), (0, 1, 2)):
            got = mixing.select_documents(mix_frame(spark, data), ["a", "b"], weights, (num, den), "s", max_epochs=epochs)
            want = brute_mix(data, weights, num, den, epochs, "s")
            assert rows(got, "doc_id") == sorted((x[0],) for x in want) and got.columns == mix_frame(spark, []).columns
    # Rows of one id with different texts, and rows without an id, are told apart.
    same = [(1, "x", "p", 3), (1, "x", "p", 4), (None, "x", "p", 5), (None, "x", "p", 6), (2, "x", "p", 0)]
    lengths = sorted(len(r.text.split()) for r in mixing.select_documents(mix_frame(spark, same), ["a"], {}, (3, 2), max_epochs=4).collect())
    assert set(lengths) == {3, 4, 5, 6} and 4 < len(lengths) < 8 and 27 <= sum(lengths) < 27 + 6


def test_op3_sql(spark):
    same_as_sql(mixing.op3_mixing(spark, SF), mixing.OP3_SQL, SF)


# --- quality ---------------------------------------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op5_quality(spark, "/root/testdata/sf0.01").collect()}
    _, labels = duck("SELECT doc_id, quality FROM labels", "/root/testdata/sf0.01", ("labels",))
    held = [(got[i].predicted, q) for i, q in labels if i in got and got[i].held_out]
    assert len(held) > 40 and sum(p == q for p, q in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_discriminant_equals_plain_formula(spark):
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    x = rng.normal(size=(200, d)) @ rng.normal(size=(d, d))
    y = (rng.random(200) < 0.7).astype(int)
    model = quality.fit(spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)] + [(x[0].tolist(), None)], "x array<double>, y int"))
    together = sum((y == k).mean() * np.cov(x[y == k].T, bias=True) for k in (0, 1))
    logs = []
    for k in (0, 1):
        c = np.cov(x[y == k].T, bias=True)
        c = (1 - quality.SHRINK_POOLED) * c + quality.SHRINK_POOLED * together
        c = (1 - quality.SHRINK_SPHERE) * c + (quality.SHRINK_SPHERE * np.trace(c) / d + quality.LEAST_VARIANCE) * np.eye(d)
        z = x - x[y == k].mean(0)
        logs.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (z * (z @ np.linalg.inv(c))).sum(1))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))
    got = quality.score(spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "doc_id long, x array<double>"), model)
    assert np.allclose([s for _, s in rows(got, "doc_id", "score")], want, atol=1e-8)


def test_statistics_do_not_depend_on_the_slice(spark):
    from tabflow.llm.textvec import utf8
    import pyarrow as pa
    texts = ["A b, c.\nA b, c.", "", "é É ß", "word " * 500, "a\n\n b", "!! 12 | # x", "same same other"]
    whole = quality.statistics(*utf8(pa.array(texts)))
    assert np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(*utf8(pa.array([t])))[0])


def test_quality_edge_cases(spark):
    x = quality.features(docs(spark, [None, "", "x " * 50000, "q", "q"], extra=True, ids=[0, 1, 2, 3, None]))
    got = quality.score(x, None)
    assert rows(got, "doc_id", "score") == [(0, 0.5), (1, 0.5), (2, 0.5), (3, 0.5), (None, 0.5)]
    assert quality.fit(spark.createDataFrame([], "x array<double>, y int")) is None
    assert quality.score(quality.features(docs(spark, [])), None).count() == 0


# --- fingerprints ----------------------------------------------------------------------------------------------

def brute_anchors(text, k=syncmers.K, s=syncmers.S):
    """Closed syncmers by their definition, with the module's own s-mer hash taken one window at a time."""
    from tabflow.llm.textvec import mix, rolling

    def smer(t):
        return int(mix(rolling(np.frombuffer(t.encode("utf-32-le"), np.uint32))[-1:])[0])

    out = []
    for i in range(len(text) - k + 1):
        h = [smer(text[i + j:i + j + s]) for j in range(k - s + 1)]
        if min(h) in (h[0], h[-1]):
            out.append(i)
    return out


def test_anchors_against_definition():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgé 中") for _ in range(n)) for n in (0, 19, 20, 21, 90, 300)] + ["a" * 50]
    codes, offs = syncmers.codes_of(texts)
    at, _ = syncmers.anchors(codes, offs)
    for i, t in enumerate(texts):
        mine = at[(at >= offs[i]) & (at < offs[i + 1])] - offs[i]
        assert mine.tolist() == brute_anchors(t)


def expect_prints(data):
    """(id, text) -> rows, next = the document before in id order, cyclically; ids distinct."""
    order = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 3
        edited = t[:len(t) - q] + nxt[:q]
        a, b, c = syncmers.fingerprints([t, edited, nxt])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), syncmers.likeness(a, b), syncmers.likeness(a, c)))
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def test_fingerprints_and_next_documents(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice("abcdef ghé") for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(120)] + [None, "z" * 90000]
    ids = rng.sample(range(-50, 10 ** 12), len(texts) - 1) + [None]
    got = syncmers.fingerprint_documents(docs(spark, texts, extra=True, ids=ids))
    assert rows(got, "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next") == expect_prints(list(zip(ids, texts)))
    prints = {r.doc_id: r.fingerprint for r in got.collect()}
    assert len({prints[i] for i, t in zip(ids, texts) if t == ""} or {1}) == 1


def test_fingerprint_edge_cases(spark):
    one = syncmers.fingerprint_documents(docs(spark, ["only one document in the table"]))
    assert rows(one, "n_chars", "near_next") == [(30, 1.0)]
    twice = syncmers.fingerprint_documents(docs(spark, ["same text " * 9, "same text " * 9, "other"], ids=[5, 5, 1]))
    assert twice.count() == 3 and len({r.fingerprint for r in twice.where("doc_id = 5").collect()}) == 1
    assert syncmers.fingerprint_documents(docs(spark, [])).count() == 0


def test_likeness_sees_order_and_edits():
    rng = random.Random(12)
    t = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    a, b, c, d = syncmers.fingerprints([t, t[:1900] + "INSERTED" + t[1950:], "".join(rng.sample(t, len(t))), t[2000:] + t[:2000]])
    assert syncmers.likeness(a, b) > 0.85 and syncmers.likeness(a, c) < 0.05
    assert syncmers.likeness(a, d) < 0.75 and syncmers.likeness(a, b) == syncmers.likeness(b, a)


def test_likeness_of_long_and_short_texts():
    rng = random.Random(13)

    def prose(n):
        return "".join(rng.choice("abcdefghij ") for _ in range(n))

    # A long text keeps anchors all along, a passage of some 50 words is found in it, and the likeness is close.
    t, other = prose(100_000), prose(100_000)
    passage = t[50_000:50_300]
    a, b, c = syncmers.fingerprints([t, t[:70_000] + other[:30_000], other[:40_000] + passage + other[40_300:]])
    assert syncmers.likeness(a, c) > 0
    at = syncmers.unpacked(a)[0][1]
    assert len(at) > 2500 and np.diff(at).max() < 1000
    assert abs(syncmers.likeness(a, b) - 0.7 / 1.3) < 0.03
    # Texts of 3 to 28 code points share anchors with their edited texts.
    for n in range(3, 29):
        for _ in range(20):
            t, other = prose(n), prose(n)
            x, y, z = syncmers.fingerprints([t, t[:n - n // 3] + other[:n // 3], t])
            assert syncmers.likeness(x, y) > 0 and syncmers.likeness(x, y) == syncmers.likeness(y, x) and x == z


def test_prints_unpack_as_packed():
    rng = np.random.default_rng(14)
    for top in (100, 20_000, 10 ** 9):
        places = np.sort(rng.choice(top, 60, replace=False))
        hashes = rng.integers(0, 1 << 32, 60)
        got = syncmers.unpacked(b"\0" + syncmers.packed(hashes, places) + b"\2" + syncmers.packed(hashes[:1], places[:1]))
        assert got[0][0].tolist() == hashes.tolist() and got[0][1].tolist() == places.tolist()
        assert got[2][0].tolist() == hashes[:1].tolist() and got[2][1].tolist() == places[:1].tolist()


# --- language --------------------------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in langid.op7_langid(spark, sf).collect()}
    _, truth = duck("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL", sf, ("documents",))
    held = [(got[i].lang_pred, lang) for i, lang in truth if got[i].held_out]
    assert len(held) > 100 and sum(p == t for p, t in held) / len(held) >= 0.98


def brute_viterbi(emit, penalty):
    import itertools
    best = None
    for path in itertools.product(range(emit.shape[1]), repeat=len(emit)):
        v = sum(emit[i, s] for i, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        if best is None or v > best[0] + 1e-9:
            best = (v, path)
    return best[0]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(13)
    lens = [0, 1, 5, 3, 0, 7, 2]
    first = np.cumsum([0] + lens)
    emit = rng.normal(size=(first[-1], 3)).astype(np.float32) * 3
    label = langid.viterbi(emit, first, 2.0)
    for i in range(len(lens)):
        e, p = emit[first[i]:first[i + 1]], label[first[i]:first[i + 1]]
        if len(e):
            mine = sum(e[k, s] for k, s in enumerate(p)) - 2.0 * int((np.diff(p) != 0).sum())
            assert abs(mine - brute_viterbi(e, 2.0)) < 1e-3


TRAIN = [("the house and the garden are with them here", "en"), ("der hund und die katze sind nicht im garten", "de"),
         ("кошка и собака живут в доме с нами", "ru"), ("η γάτα και ο σκύλος είναι στο σπίτι", "el")]


def trained(spark):
    data = [(i, t, lang, None, None) for i, (t, lang) in enumerate(TRAIN * 3)] + [(99, "nothing taught", None, None, None)]
    return langid.learn(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"))


def test_language_spans_and_scripts(spark):
    model = trained(spark)
    text = "the house and the garden кошка и собака живут the garden are here"
    got = langid.identify(docs(spark, [text]), model, with_spans=True).first()
    raw = text.encode()
    assert [(s.lang, raw[s.start:s.end].decode()) for s in got.spans] == [
        ("en", "the house and the garden"), ("ru", "кошка и собака живут"), ("en", "the garden are here")]
    # A word in a script that one language alone uses is that language's, whatever its trigrams.
    assert langid.identify(docs(spark, ["жжж", "ΩΩΩ"]), model).orderBy("doc_id").collect()[0].lang_pred == "ru"


def test_language_counts_letters_not_bytes_or_signs(spark):
    model = trained(spark)
    text = "собака живут the house and the garden …—😀😀"
    got = langid.identify(docs(spark, [text, "the😀", "«и»", "× ÷ 😀 …"]), model, with_spans=True).orderBy("doc_id").collect()
    assert got[0].lang_pred == "en" and abs(got[0].score - 20 / 31) < 1e-9
    assert [s.lang for s in got[0].spans] == ["ru", "en"] and got[1].lang_pred == "en"
    raw = "«и»".encode()
    assert [raw[s.start:s.end].decode() for s in got[2].spans] == ["и"]
    assert got[3].lang_pred == "und"


def test_language_word_scores_equal_the_plain_sums():
    """Emissions by the definition: trigrams of the lower-cased bytes of a word and its two edges."""
    from tabflow.llm.textvec import utf8
    import pyarrow as pa
    texts = ["Abc dé, Ünd x", "", "жук—Привет 漢字😀ok", "a"]
    data, offs = utf8(pa.array(texts))
    starts, ends, script, code, use = langid.scan(data, offs)
    words_ = [(i, m.start(), m.group()) for i, t in enumerate(texts) for m in re.finditer(r"[A-Za-zÀ-ÖØ-öø-ÿЀ-ӿ一-鿿]+", t)]
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends)] == [w for _, _, w in words_]
    assert script.tolist() == [13 if ord(w[0]) >= 0x4E00 else 2 if ord(w[0]) >= 0x400 else 0 for _, _, w in words_]
    for (row, at, word), s, e in zip(words_, starts, ends):
        # The row's letters are lower-cased Latin-1 bytes, everything else zero.
        raw = bytearray(texts[row].encode())
        keep = bytearray(len(raw))
        for m in re.finditer(r"[A-Za-zÀ-ÖØ-öø-ÿЀ-ӿ一-鿿]+", texts[row]):
            a = len(texts[row][:m.start()].encode())
            low = "".join(c.lower() if ord(c) < 256 else c for c in m.group()).encode()
            keep[a:a + len(low)] = low
        a = len(texts[row][:at].encode())
        for k in range(a, min(a + len(word.encode()) + 1, len(raw))):
            z = [keep[k - j] if k >= j else 0 for j in (2, 1, 0)]
            want = ((((z[0] << 16) | (z[1] << 8) | z[2]) * 0x9E3779B1) % (1 << 32)) >> 17
            assert code[offs[row] + k] == want


def test_language_edge_cases(spark):
    model = trained(spark)
    texts = [None, "", "12 34 !", "… —", "the house", "the house", "und die katze " * 20000, "ñ"]
    got = langid.identify(docs(spark, texts, extra=True), model)
    pred = [r.lang_pred for r in got.orderBy("doc_id").collect()]
    assert pred[:4] == ["und"] * 4 and pred[4:7] == ["en", "en", "de"] and pred[7] != "und"
    assert langid.identify(docs(spark, ["abc"]), None).first().lang_pred == "und"
    kept = langid.identify(docs(spark, ["the house"], extra=True), model, carry=True)
    assert kept.columns[-2:] == ["lang_pred_", "score_"] and kept.first()["a.b"] == 1
    assert langid.identify(docs(spark, []), model).count() == 0
    assert langid.learn(docs(spark, ["x"])) is None


# --- pipeline --------------------------------------------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as pipe
    from test_llm_dups import brute_components, brute_lines
    docs0 = spark.read.parquet(f"{SF}/documents.parquet")
    data = sorted(docs0.collect(), key=lambda r: r.doc_id)
    kept = [pipe.written(docs0, "t")]
    for name, stage in pipe.STAGES:
        kept.append(pipe.written(stage(spark, kept[-1], SF), "t"))
        if name != "packing":
            assert kept[-1].columns == docs0.columns
    lang, lines, near, mixed, packed = ({r.doc_id: r for r in k.collect()} for k in kept[1:])
    assert set(lang) == {r.doc_id for r in data if any(c.isalpha() for c in r.text or "")}
    assert sum(lang[r.doc_id].lang == r.lang for r in data) >= 0.98 * len(data)
    want = brute_lines([(i, lang[i].text) for i in sorted(lang)])
    assert {i: t for i, t, gone in want if not gone or t.strip(" ")} == {i: r.text for i, r in lines.items()}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    order = sorted(lines)
    parts = brute_components([lines[i].text for i in order])
    assert set(near) == {order[i] for i, _, c in parts if c == i}
    words = {i: len((r.text or "").split()) for i, r in near.items()}
    assert set(mixed) <= set(near) and sum(words[i] for i in mixed) >= 0.95 * sum(words.values())
    assert {i: r.text for i, r in mixed.items()} == {i: near[i].text for i in mixed}
    total = {}
    for r in kept[-1].collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    spots = {r.doc_id: r.n for r in kept[-2].select("doc_id", (packing.word_count(kept[-2].text) + 1).alias("n")).collect()}
    assert total == spots and packed


def test_pipeline_mixes_to_the_weights_and_packs_a_document_once(spark):
    import corpus_pipeline as pipe
    rng = random.Random(13)
    data = [(i, " ".join(f"w{i}x{k}" for k in range(rng.randrange(5, 40))), rng.choices(["en", "de", "fr", "es"], [5, 3, 2, 1])[0],
             f"s{rng.randrange(6)}", 1) for i in range(1200)]
    data += [(None, "without an id", "en", "s0", 1), (7, "the same id", "en", "s0", 1), (5000, " ", "en", "s0", 1), (5001, None, "en", "s0", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipe.written(pipe.mixed(spark, df, SF), "t")
    assert got.columns == df.columns
    out = got.collect()
    words, times = lambda r: len(r.text.split()), {}
    for r in out:
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    total, by_domain, by_lang = sum(map(words, out)), {}, {}
    for r in out:
        d = int(r.source[1:]) % 3
        by_domain[d] = by_domain.get(d, 0) + words(r) / total
        by_lang[r.lang] = by_lang.get(r.lang, 0) + words(r) / total
    for d, w in ((0, 0.5), (1, 0.3), (2, 0.2)):
        assert abs(by_domain[d] - w) < 0.03
    for lang, w in (("en", 0.6), ("de", 0.2), ("fr", 0.1), ("es", 0.1)):
        assert abs(by_lang[lang] - w) < 0.03
    assert abs(total / sum(words_of(r[1]) for r in data) - 2) < 0.05 and max(times.values()) <= 4
    # Every row has one place, in sequences that are used as often as the row is in the mix.
    places = pipe.packed(spark, got, SF).collect()
    put = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens - 1, r.epochs) for r in places)
    assert put == sorted((i is None, i or 0, words_of(t), n) for (i, t), n in times.items())
    bins = {}
    for r in places:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        assert len({(r.epochs, r.bin_size, r.bin_used) for r in b}) == 1 and sum(r.n_tokens for r in b) == b[0].bin_used <= b[0].bin_size
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens


def words_of(text):
    return len((text or "").split())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipe
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0
