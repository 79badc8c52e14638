"""Suffix arrays in step against sorting, and bytes removed against every string of every document."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import suffixes


def columns(texts: list[list[int]]) -> np.ndarray:
    n = max(map(len, texts)) + 1
    t = np.full((n, len(texts)), 9, np.int32)
    for k, x in enumerate(texts):
        t[n - 1 - len(x) : n - 1, k] = x
    t[n - 1] = 0
    return t


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays_and_common_prefixes(seed):
    rng = random.Random(seed)
    texts = [[rng.randint(1, 1 + seed) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    texts += [[2] * 30, [2, 3] * 15, [3, 2] * 14, [1], [1, 1, 1], [2, 2, 1] * 8, [5, 4, 3, 2, 1]]
    t = columns(texts)
    sa = suffixes.suffix_arrays(t, 10)
    begin = len(t) - 1 - np.array([len(x) for x in texts])
    shared = suffixes.common_prefixes(t, sa, begin)
    for k in range(len(texts)):
        c = t[:, k].tolist()
        want = sorted(range(len(c)), key=lambda i: c[i:])
        assert sa[:, k].tolist() == want
        for a, b in zip(want, want[1:], strict=False):
            if b >= begin[k] and b < len(c) - 1:
                m = 0
                while c[a + m] == c[b + m] > 1:
                    m += 1
                assert shared[b, k] == m


def plain(rows, length=50):
    first: dict[bytes, float] = {}
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            first[g] = min(first.get(g, float("inf")), i)
    out = []
    for (i, b), (own, _) in zip(data, rows, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def odd_documents(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé日") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(20), prose(12), prose(40), "ab" * 60, "x" * 400, prose(9)[:50]]
    out: list[tuple] = []
    for k in range(120):
        t = prose(rng.randint(0, 60))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            p, cut = rng.choice(passages), rng.randint(0, len(t))
            lo = rng.randint(0, max(0, len(p) - 55))
            t = t[:cut] + p[lo : rng.randint(lo + 40, lo + 300)] + t[cut:]
        out.append((k, t))
    base = prose(150)
    for k in range(30):  # near copies: a group of a fingerprint has many distinct segments
        at = rng.randint(0, len(base) - 5)
        out.append((200 + k, base[:at] + rng.choice("äöüß") + base[at + 1 :]))
    out += [(300 + k, out[7][1]) for k in range(10)] + [(5, out[5][1]), (5, out[6][1]), (None, base), (None, base), (400, None), (401, ""), (402, "x" * 49), (403, "x" * 50), (-3, "x" * 120), (404, prose(3000))]
    out += [(405, out[-1][1][5000:9000])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "chunk", "slice_", "hot", "lane"), [(1, 4 << 20, 1 << 17, 64, 4096), (2, 3000, 700, 64, 4096), (3, 3000, 256, 3, 4096), (4, 2000, 1 << 17, 5, 200), (5, 1500, 333, 1 << 30, 1 << 20)])
def test_removed_bytes_equal_all_strings(spark, monkeypatch, seed, chunk, slice_, hot, lane):
    for name, value in (("CHUNK", chunk), ("SLICE", slice_), ("HOT", hot), ("LANE", lane)):
        monkeypatch.setattr(suffixes, name, value)
    rows = odd_documents(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("chunk", "shard", "keys", "marked", "n_bytes", "ids", "found")}).repartition(4)
    got = suffixes.repeated(d)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = plain(rows)
    assert sum(r[2] for r in want) > 5000
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_no_documents(spark):
    assert suffixes.repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_segments_larger_than_a_lane_are_compared_string_by_string(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = rng.integers(50, 80, 40)
    texts = rng.integers(97, 99, sizes.sum()).astype(np.uint8)
    texts[: 40 * 50] = np.tile(texts[:500], 4)[: 40 * 50]
    low, owner = rng.integers(0, 1000, 40), np.sort(rng.integers(0, 3, 40))
    in_step = suffixes.lowest(texts, sizes, low, owner, 12)
    monkeypatch.setattr(suffixes, "LANE", 0)
    assert (in_step == suffixes.lowest(texts, sizes, low, owner, 12)).all()
    assert (in_step < np.repeat(low, sizes - 11)).any()


@pytest.mark.parametrize("hot", [64, 3])
def test_small_shares_of_a_shard(spark, monkeypatch, hot):
    """Shards are cut by what is dealt, and a shard counts its keys range by range."""
    for name, value in (("CHUNK", 3000), ("HOT", hot), ("TOLD", 500), ("SENT", 3000), ("COUNT", 50)):
        monkeypatch.setattr(suffixes, name, value)
    rows = odd_documents(7)
    rows += [(i and i + 1000, t) for i, t in rows]  # all of it twice
    key = lambda r: tuple((x is None, x) for x in r)
    got = suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_memory_of_a_chunk_that_repeats():
    """All strings of a chunk of 2 MB are told, sent and removed: some bytes of memory for a byte of text, not hundreds."""
    import tracemalloc

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(320_000)).encode()
    row = {"chunk": 0, "ids": np.array([7]).tobytes(), "ends": np.array([len(text)]).tobytes(), "text": text}
    state = lambda keys, kind: [{"shard": 0, "many": len(keys), "marks": np.packbits(np.repeat([[True], [kind > 1]], len(keys), 1), axis=1).tobytes()}]
    for kind in (1, 2):
        tracemalloc.start()
        c = suffixes.Chunk(row, 50, 1)
        c.marked(state(c.keys, kind))
        c.segments(state(c.string_keys, 1) if len(c.string_keys) else [])
        many = c.strings[c.order][c.first]
        found = [{"shard": 0, "least": np.array([3]).tobytes(), "runs": np.array([many.sum()], np.int32).tobytes()}]
        (out,) = c.documents(found)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out[:4] == (7, len(text), len(text), 1)
        assert peak < 80 * len(text), peak / len(text)  # 94 when hashes of all strings and places in 64 bits were held
