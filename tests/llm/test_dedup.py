from itertools import combinations

import numpy as np
import pyarrow as pa

from quantloom.llm import embeddings, jaccard, linededup
from tests_llm_brute import line_codes, lines_left, sets_of, smallest


def test_near_duplicates(docs, rows, none):
    s = sets_of(rows)
    links = [(a, b) for a, b in combinations(s, 2) if s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]) > 0]
    want = smallest(s, links)
    for small, hubs in ((4, 4), (1, 0), (1, 9)):  # without small groups all go the way of large ones
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, small=small, hubs=hubs).collect()}
        assert got == {i: (len(s[i]), want[i]) for i in s}
    assert len(links) > 15
    assert jaccard.near_duplicates(none).count() == 0
    assert jaccard.near_duplicates(docs.unionByName(docs)).count() == 2 * len(rows)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in s if want[i] == i}


def test_line_dedup(spark, docs, rows, none):
    got = linededup.dedup(docs)
    want = lines_left(rows, line_codes(spark, rows))
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert sum(1 for i, t, *_ in rows if want[i] != t) > 8
    assert linededup.dedup(none).count() == 0
    assert linededup.dedup(docs.unionByName(docs)).count() == 2 * len(rows)


def test_embeddings(spark, none):
    from quantloom.llm import common

    common.ship(spark)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x[100:150] = x[3] + 0.15 * rng.standard_normal((50, 16))
    x[150:170] = x[4]
    x[170:200] = x[:30] + 0.3 * rng.standard_normal((30, 16))
    vectors = [v.astype(np.float32).tolist() for v in x] + [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, k, "q") for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, rep long, vector string")
    y = np.array([v for v in vectors[:300]], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = [(a, b) for a, b in combinations(range(300), 2) if y[a] @ y[b] >= 0.95]
    want = smallest(range(len(vectors)), links)
    count = np.bincount(np.array(links).reshape(-1), minlength=len(vectors))
    for cell in (4096, 16):  # with 16, hot buckets are cut into blocks
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, cell=cell).collect()}
        assert got == {k: (count[k], want[k], want[k] == k) for k in range(len(vectors))}
    assert len(links) > 200
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    turn = embeddings.rotations(64, 1)[0]
    q = rng.standard_normal((200, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    o = q + 0.1 * rng.standard_normal(q.shape)
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    t = o @ turn
    est, half = embeddings.estimate(t >= 0, np.abs(t).sum(1) / 8, q @ turn)
    true = o @ q.T
    assert abs((est - true).mean()) < 0.01 and (np.abs(est - true) <= half).all()


def test_blocks_write_one_link_for_two_components():
    """A family whose members stand apart gives links between its components only, not a row for each pair."""
    rng = np.random.default_rng(3)
    base, sets = np.arange(1000, 1100), []
    for k in range(300):
        s = base.copy()
        s[rng.choice(100, k % 23, replace=False)] = rng.integers(10**6, 10**9, k % 23)
        sets.append(np.unique(s))
    label = [k % 150 for k in range(300)]
    rows = [(k, -k, label[k], first, sets[k].tolist()) for k in range(300) for first in ((True, False) if label[k] else (False,))]
    t = pa.table({c: pa.array(v) for c, v in zip(("sig", "more", "label", "first", "tokens"), zip(*rows, strict=True), strict=True)})
    got = [(r["u"]["sig"], r["v"]["sig"]) for r in jaccard._block(t).to_pylist()]
    alike = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})
    want = {(label[a], label[b]) for a in range(300) for b in range(300) if label[a] and label[a] != label[b] and alike(a, b)}
    assert all(alike(a, b) for a, b in got) and len(want) > 100
    assert sorted((label[a], label[b]) for a, b in got) == sorted(want)
