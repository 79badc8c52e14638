"""Product codes by Yinyang Lloyd and hard negatives by norm buckets, against plain versions on odd tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import codebooks, negatives

NAN, INF = float("nan"), float("inf")


def odd_vectors(seed: int, n: int, dim: int = 16, unit: bool = False) -> list[tuple]:
    """(vec_id, label, embedding): clusters, copies, ties, repeated ids, null ids, bad vectors, another length."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    out: list[tuple] = []
    for k in range(n):
        c = centres[0] if k % 3 == 0 else rng.choice(centres)  # a third lies in one place
        v = [x + rng.choice([0, 0.001, 0.3]) * rng.uniform(-1, 1) for x in c] if k % 4 else list(c)
        scale = 1 if unit else rng.choice([0.1, 1, 1, 3])
        out.append((k, rng.choice([0, 0, 1, 2, 9, None]), [x * scale for x in v]))
    out += [out[5], out[5], (5, 1, out[6][2]), (None, 1, out[7][2]), (n + 1, 0, None), (n + 2, 0, [NAN] * dim), (n + 3, 1, [INF] + [0.0] * (dim - 1))]
    out += [(n + 4, 1, [None] + [0.0] * (dim - 1)), (n + 5, 0, [0.0] * dim), (100, 0, [-0.0] * dim), (n + 6, 0, [1.0, 2.0, 3.0]), (n + 7, 1, [])]
    return out


def table(spark, rows, dim_type="double"):
    d = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{dim_type}>")
    return d.withColumns({c: F.lit(1) for c in ("v", "own", "low", "sums", "bucket", "node", "norm", "side", "error", "key_", "lows")}).repartition(3)


def whole(rows, scale):
    return [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain_codes(rows, parts=8, size=16, rounds=6, scale=4096):
    q = sorted(whole(rows, scale), key=lambda r: (r[0] is None, r[0], r[2]))
    width = -(-max([len(v) for *_, v in q] + [1]) // parts) * parts
    q = [(i, lab, v + [0] * (width - len(v))) for i, lab, v in q]
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for *_, v in q[:size]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((dist(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = [best(v, p)[1] for *_, v in q]
            mine = [[cut(v, p) for o, (*_, v) in zip(own, q, strict=True) if o == k] for k in range(len(books[p]))]
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(mine, books[p], strict=True)]
    rows_out = []
    for i, lab, v in q:
        found = [best(v, p) for p in range(parts)]
        rows_out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return rows_out, books


@pytest.mark.parametrize(("seed", "n", "big"), [(1, 300, False), (2, 9, False), (3, 60, True)])
def test_codes_equal_plain_lloyd(spark, seed, n, big):
    rows = odd_vectors(seed, n)
    if big:
        rows = [(i, lab, v and [x if x is None or not math.isfinite(x) else x * 3e4 for x in v]) for i, lab, v in rows]
    got, books, asked = codebooks.codes(table(spark, rows))
    want, want_books = plain_codes(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert [b.tolist() for b in books] == want_books
    if n > 100:  # bounds leave out distances: the first pass asks for all of them, the last for less than half
        assert asked[-1] < 0.5 * asked[0]


def test_codes_of_an_empty_table(spark):
    got, books, _ = codebooks.codes(table(spark, odd_vectors(1, 9)).where("false"))
    assert got.collect() == [] and got.columns == ["vec_id", "label", "code", "error"]
    assert codebooks.fingerprint(books)


def test_a_bound_is_never_above_a_distance():
    rng = np.random.default_rng(4)
    x, books = rng.integers(-50, 50, (500, 4)), rng.integers(-50, 50, (16, 4))
    group = codebooks.groups(books, 4)
    own, low = np.zeros(500, int), np.full((500, 4), -np.inf)
    drift = np.zeros(16)
    for _ in range(5):
        own, best, low, _ = codebooks.nearest(x, books, group, own, low, drift)
        d = ((x[:, None] - books) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (best == d.min(1)).all()
        for g in range(4):
            others = np.where((group == g) & (np.arange(16) != own[:, None]), np.sqrt(d), np.inf).min(1)
            assert (low[:, g] <= others).all()
        moved = books + rng.integers(-3, 4, books.shape)
        drift, books = np.sqrt(((moved - books) ** 2).sum(1)), moved


def plain_negatives(rows, scale=256):
    q = [(n, i, lab, v) for n, (i, lab, v) in enumerate(whole(rows, scale)) if lab is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for n, i, lab, v in q:
        if i is None or i % 10:
            continue
        scored = [(dot(v, w), j, m, other) for m, j, other, w in q if m != n]
        for s, j, *_ in sorted([r for r in scored if r[3] == lab], key=order)[:5]:
            fits = sorted([r for r in scored if r[3] != lab and 30 * s <= 100 * r[0] <= 90 * s], key=order)[:10]
            out += [(i, j, k + 1, r[1], s, r[0]) for k, r in enumerate(fits)]
    return out


@pytest.mark.parametrize(("seed", "n", "unit", "kind"), [(1, 260, False, "small"), (2, 200, True, "small"), (3, 120, False, "mid"), (4, 60, False, "big")])
def test_negatives_equal_all_scores(spark, monkeypatch, seed, n, unit, kind):
    rows = odd_vectors(seed, n, unit=unit)
    grow = {"small": 1, "mid": 1e3, "big": 1e5}[kind]  # inner products in single and double precision, and beyond 53 bits
    rows = [(i, lab, v and [x if x is None or not math.isfinite(x) else x * grow for x in v]) for i, lab, v in rows]
    monkeypatch.setattr(negatives, "SLICE", 16)  # many slices and buckets
    monkeypatch.setattr(negatives, "BUCKET_BYTES", 16 * 8 * 20)
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0)
    key = lambda r: tuple((x is None, x) for x in r)
    want = plain_negatives(rows)
    assert len(want) > 50
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_negatives_of_nothing(spark):
    t = table(spark, odd_vectors(1, 30))
    for d in (t.where("false"), t.where("label is null"), t.where("vec_id % 10 <> 0")):
        got = negatives.mine(d, F.col("vec_id") % 10 == 0)
        assert got.collect() == [] and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_short_rows_are_no_negatives_of_long_ones(spark, monkeypatch):
    """Rows that are too short for every window lie in buckets that no anchor asks."""
    monkeypatch.setattr(negatives, "BUCKET_BYTES", 4 * 8 * 10)
    rows = [(k, k % 2, [float(1 + k % 3), 1.0, 0.0, 0.0] if k < 20 else [1e-3, 0.0, 0.0, 0.0]) for k in range(60)]
    out = negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") < 2).collect()
    assert {r["negative_id"] for r in out} <= set(range(20)) and out
