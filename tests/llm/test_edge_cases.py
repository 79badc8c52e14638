"""Columns that clash with names used inside, repeated ids, and scores held against plain versions."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import common, embeddings, jaccard, linededup, mixing, quality, toxicity

CLASH = ("_id", "_v", "_w", "_version", "_runs", "_lines", "_at", "_stay", "_times", "_pass", "_words", "doc", "of", "runs", "l", "stay", "salt_", "hot_", "doc_", "version", "row", "print", "code")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("doc_id", "text", "lang", "source").withColumns({c: F.lit("x") for c in CLASH})


def test_columns_that_clash(clashing, docs):
    for run in (linededup.dedup, mixing.apply, jaccard.keep_first):
        got, want = run(clashing), run(docs.select("doc_id", "text", "lang", "source"))
        assert set(clashing.columns) <= set(got.columns)
        key = ["doc_id", "text", "source"]
        assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))
        assert got.where(" OR ".join(f"`{c}` <> 'x'" for c in CLASH)).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    d = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (None, b), (None, b)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first(d).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, b), (None, b)], key=str)


def test_one_id_with_two_vectors(spark):
    common.ship(spark)
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 16))
    near = x + 0.001 * y
    rows = [(1, y), (1, x), (3, near), (4, -x), (5, y), (5, y)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (3, 1, 1, False), (4, 0, 4, True), (5, 2, 1, False), (5, 2, 1, False)]


def test_codes_keep_all_pairs_and_drop_most(spark):
    """Bounds never lose a pair that shares a bucket; nearly all unrelated vectors go without being fetched."""
    common.ship(spark)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 64))
    x[500:] = x[:100] + 0.2 * rng.standard_normal((100, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(a, b) for a, b in combinations(range(600), 2) if u[a] @ u[b] >= 0.95]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert sum(got.values()) == 2 * len(links) and len(links) > 60
    assert embeddings.tables(10**10, 0.95, 1e-6)[1] < 400


def _plain(w, m, tokens):
    """One window, one step at a time, in double precision."""
    h = {k: v.astype(float) for k, v in w.items()}
    n = toxicity.HIDDEN

    def word(t):
        g, _ = toxicity.grams([t])
        return np.concatenate([h["word"][m.vocabulary.get(t, 0)], h["char"][g].sum(0) / math.sqrt(len(g))])

    x = [word(t) for t in tokens] or [np.zeros(toxicity.WORD_DIM + toxicity.CHAR_DIM)]

    def run(xs, k):
        s, out = np.zeros(n), []
        for v in xs:
            i, r = v @ h[f"x{k}"] + h[f"c{k}"], s @ h[f"h{k}"]
            z, reset = (1 / (1 + np.exp(-(i[a : a + n] + r[a : a + n]))) for a in (0, n))
            c = np.tanh(i[2 * n :] + reset * r[2 * n :])
            s = z * s + (1 - z) * c
            out.append(s)
        return out

    states = np.array([np.concatenate(p) for p in zip(run(x, "f"), run(x[::-1], "b")[::-1], strict=True)])
    e = np.tanh(states @ h["att"] + h["attb"]) @ h["attv"]
    p = np.exp(e - e.max())
    return float((p / p.sum()) @ states @ h["out"] + h["outb"][0])


def test_windows_one_by_one(rows):
    texts = [t or "" for _, t, *_ in rows][:30] + ["", "one", "x" * 90 + "a", "x" * 90 + "b"]
    m = toxicity.start({"an": 1, "the": 2, "er": 3})
    logit, begin = toxicity.Scorer(m).windows(texts)
    want = []
    for t in texts:
        d = toxicity.tokens_of(t)
        want += [_plain(m.w, m, d[s : s + toxicity.WINDOW]) for s in range(0, max(1, len(d) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)]
    assert logit == pytest.approx(want, abs=1e-4)
    assert len(begin) == len(texts) and logit[-1] != logit[-2]  # words that differ after many characters
    again, _ = toxicity.Scorer(m).windows(texts[::-1])
    assert sorted(again.tolist()) == sorted(logit.tolist())  # whatever stands around a window


def test_ratios_by_hand(spark):
    """Counts of all n-grams one text at a time."""
    common.ship(spark)
    texts = ["a b a", "b c", None, "", "c c c d", "a b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good = spark.createDataFrame([(0,), (4,)], "k long")
    got = quality.ratios(df, good, "doc_id", "text", 64)
    raw, target = np.zeros(64), np.zeros(64)
    for k, t in enumerate(texts):
        f, _ = quality.features([t], 64)
        for b in f.tolist():
            raw[b] += 1
            target[b] += k in (0, 4)
    expected = raw * target.sum() / raw.sum()
    assert got.tolist() == np.rint(np.log((target + 4) / (expected + 4)) * quality.UNIT).astype(int).tolist()
