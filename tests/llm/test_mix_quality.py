import hashlib
import math
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quantloom.llm import hashing, mixing, quality


def expected_targets(sizes, weights=(1, 2, 3), repeats=3):
    """By resharing the excess until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap, total = {s: repeats * sizes[s] for s in names}, Fraction(sum(sizes.values()))
    full: set = set()
    while True:
        level = (total - sum(cap[s] for s in full)) / max(1, sum(w[s] for s in names if s not in full))
        over = {s for s in names if s not in full and level * w[s] > cap[s]}
        if not over:
            return {s: Fraction(cap[s]) if s in full else level * w[s] for s in names}
        full |= over


def test_mix(docs, rows, none):
    q, entries = mixing.mix(docs)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    sources = {}
    for i, _, _, s in rows:
        sources[s] = sources.get(s, 0) + size[i]
    want = expected_targets(sources)
    for r in q.collect():
        assert r.size == size[r.doc_id] and r.source_size == sources[r.source] and r.target == pytest.approx(float(want[r.source]))
    e = entries.orderBy("mix_offset").collect()
    assert [r.finish for r in e] == sorted(r.finish for r in e)
    at, taken, mine = 0, dict.fromkeys(sources, 0), {}
    for r in e:
        assert r.mix_offset == at
        at += r.words
        taken[r.source] += r.words
        mine[r.doc_id] = mine.get(r.doc_id, 0) + r.words
    assert all(abs(taken[s] - want[s]) <= 1 for s in sources) and all(n <= 3 * size[i] for i, n in mine.items())
    assert mixing.mix(none)[1].count() == 0
    out = mixing.apply(docs)
    assert out.columns == docs.columns and out.groupBy("doc_id").count().where("count > 3").count() == 0
    assert mixing.apply(docs.where("doc_id < 0")).count() == 0


def test_targets_with_a_small_source(spark):
    t = mixing.targets(spark.createDataFrame([("a", 600), ("b", 10), ("c", 20), (None, 0)], "source string, source_size long"))
    got = {r.source: r.target for r in t.collect()}
    want = expected_targets({"a": 600, "b": 10, "c": 20, None: 0})
    assert got == {s: pytest.approx(float(v)) for s, v in want.items()} and got["b"] == 30 and got["c"] == 60 and got[None] == 0


def test_words_hash_like_words():
    texts = ["The the,  dog!!\n", None, "", "a\x1cb A\x1cb", "x " * 3 + "y" * 50, "é É"]
    h, n = hashing.words(texts)
    assert n.tolist() == [3, 0, 0, 2, 4, 2]
    names = [w.translate({c: c + 32 for c in range(65, 91)}) for t in texts if t for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert len(set(h.tolist())) == len(set(names)) and all((h[a] == h[b]) == (names[a] == names[b]) for a in range(len(h)) for b in range(len(h)))
    _, marks = hashing.words(["it's %%% ok%%%"], marks=True)
    assert marks.tolist() == [6]
    long = "ab " * (hashing.SLICE // 2)
    assert hashing.words([long])[1].tolist() == [hashing.SLICE // 2]


def test_score_is_the_sum_of_ratios(docs, rows):
    import numpy as np

    ratio = np.arange(-50, 50) * quality.UNIT // 10
    texts = [r[1] for r in rows]
    alone = [int(quality.score([t], ratio)[0]) for t in texts]
    assert quality.score(texts, ratio).tolist() == alone and alone[texts.index(None)] == 0
    f, n = quality.features(["a b a"], 100)
    assert n.tolist() == [5] and len(set(f.tolist())) <= 4


def test_resampling(spark, docs, rows, none):
    junk = spark.createDataFrame([(1000 + k, " ".join(["%%% $$$ zzz###"] * (5 + k)), "en", "s1") for k in range(25)], "doc_id long, text string, lang string, source string")
    d = docs.select("doc_id", "text", "lang", "source").unionByName(junk)
    labels = d.select("doc_id", (F.col("doc_id") < 1000).alias("good")).where("doc_id % 2 = 0")
    out, ratio, bar = quality.resample(d, labels, buckets=512)
    r = out.orderBy("rank_no").collect()
    assert [x.rank_no for x in r] == list(range(1, len(rows) + 26))
    assert [x.noisy for x in r] == sorted((x.noisy for x in r), reverse=True)
    texts = dict([x[:2] for x in rows] + [(x.doc_id, x.text) for x in junk.collect()])
    for x in r:
        assert x.log_ratio == pytest.approx(int(quality.score([texts[x.doc_id]], ratio)[0]) / quality.UNIT)
        u = (int(hashlib.md5(f"gumbel:{x.doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        assert x.noisy == pytest.approx(x.log_ratio - math.log(-math.log(u)))
        assert x.kept == (x.noisy >= bar)
    kept = {x.doc_id for x in r if x.kept}
    assert sum(x.kept for x in r) >= sum(x.log_ratio >= -8 for x in r)
    assert len([i for i in kept if i >= 1000]) <= 3 and len([i for i in kept if i < 1000]) >= len(rows) - 2
    stay = quality.keep(d, labels, buckets=512)
    assert stay.columns == d.columns and {x.doc_id for x in stay.collect()} == kept
    assert quality.resample(none, labels)[0].count() == 0 and quality.keep(none, labels).count() == 0
    assert quality.resample(docs, labels.limit(0))[0].where("not kept").count() == 0
