"""TF-IDF inside the row: against the formula, and without an exchange after the fit."""

import math
import re
from collections import Counter

import pytest

from tabflow.operators.text import Tfidf

DOCS = [(1, "Red red apple, green_1 pear"), (2, "apple PEAR pear a b"), (3, None), (4, ""), (5, "zzz unseen"), (5, "apple apple"), (None, "été red")]


def by_hand(rows, fit_rows, k):
    words = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    known = [words(t) for _, t in fit_rows if t is not None]
    total, df = Counter(w for d in known for w in d), Counter(w for d in known for w in set(d))
    vocab = sorted(sorted(total, key=lambda w: (-total[w], w))[:k])
    idf = {w: math.log((1 + len(known)) / (1 + df[w])) + 1 for w in vocab}
    out = []
    for i, t in rows:
        raw = {w: n * idf[w] for w, n in Counter(words(t)).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out += [(i or 0, w, x / norm) for w, x in raw.items()]
    return vocab, sorted(out)


@pytest.mark.parametrize("k", [3, 100])
def test_weights_equal_the_formula(spark, k):
    df = spark.createDataFrame(DOCS, "`d.id` int, text string")
    model = Tfidf("d.id", "text", k).fit(df.where("`d.id` < 3"))
    vocab, want = by_hand(DOCS, DOCS[:2], k)
    got = sorted((r[0] or 0, r["term"], r["weight"]) for r in model.transform(df).collect())
    assert model.terms == vocab
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    vectors = model.to_vectors(df).collect()
    assert len(vectors) == len(DOCS) and all(len(r["tfidf"]) == len(vocab) for r in vectors)


def test_nothing_is_exchanged_after_the_fit(spark):
    df = spark.createDataFrame(DOCS, "id int, text string")
    model = Tfidf("id", "text").fit(df)
    assert "Exchange" not in model.transform(df)._jdf.queryExecution().executedPlan().toString()
    none = Tfidf("id", "text").fit(df.where("id in (3, 4)"))
    assert none.empty and none.transform(df).count() == 0 and none.to_vectors(df).count() == len(DOCS)
