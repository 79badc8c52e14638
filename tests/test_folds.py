"""Chunked operators equal the fold over a key's rows one by one, wherever a key is cut."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import chunks, folds

ROWS = (7, 40, 10**6)


def table(spark, seed=1, n=300):
    """A long key, a short one, one row, times with holes; nulls, zeros, runs of both flags."""
    rng = random.Random(seed)
    rows, t = [], 0
    for key, many in (("a", n), ("b", 25), ("c", 1), (None, 30)):
        x = 1.0
        for _ in range(many):
            t += rng.choice([1, 1, 1, 2, 60])
            x = max(0.0, x + rng.uniform(-0.15, 0.15))
            v = rng.choice([x, x, x, x, None, 0.0]) if rng.random() < 0.2 else x
            rows.append((key, t, v, rng.choice([True, False, False, None]), rng.choice([True, False, False, None]), rng.choice([-1.0, 0.0, None]) if rng.random() < 0.03 else rng.uniform(-0.3, 0.3)))
    shuffled = list(rows)
    rng.shuffle(shuffled)
    return spark.createDataFrame(shuffled, "k string, t long, x double, e boolean, l boolean, r double").repartition(3), rows


def by_key(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def got(df, name):
    return {(r["k"], r["t"]): r[name] for r in df.collect()}


@pytest.mark.parametrize("rows", ROWS)
def test_state_machine(spark, rows):
    df, data = table(spark)
    want = {}
    for key, rs in by_key(data).items():
        inside = False
        for r in rs:
            inside = (not r[4]) if inside else bool(r[3])
            want[key, r[1]] = int(inside)
    assert got(folds.state_machine(df, "k", "t", "e", "l", rows=rows), "state") == want


@pytest.mark.parametrize("rows", ROWS)
@pytest.mark.parametrize("band", (0.1, 0.4))
def test_band(spark, rows, band):
    df, data = table(spark, 2)
    want = {}
    for key, rs in by_key(data).items():
        held = 0.0
        for r in rs:
            p = r[2] or 0.0
            if p == 0 or abs(p - held) > band:
                held = p
            want[key, r[1]] = held
    assert got(folds.apply_band(df, "k", "t", "x", band, rows=rows), "held") == want


@pytest.mark.parametrize("rows", ROWS)
def test_rsi(spark, rows):
    df, data = table(spark, 3)
    have = got(folds.rsi(df, "k", "t", "x", 5, rows=rows), "rsi")
    for key, rs in by_key(data).items():
        x = pd.Series([r[2] for r in rs], dtype=float).ffill()
        d = x.diff()
        d[x.notna() & d.isna() & (x.shift().notna())] = 0.0
        up, down = (s.ewm(alpha=1 / 5, adjust=False).mean() for s in (d.clip(lower=0), -d.clip(upper=0)))
        want = (100 - 100 / (1 + up / down.where(down > 0))).where(down > 0, 100.0)
        assert np.allclose([have[key, r[1]] for r in rs], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("rows", ROWS)
@pytest.mark.parametrize("n", (1, 4, 10))
def test_rolling_drawdown(spark, rows, n):
    df, data = table(spark, 4)
    have = got(folds.rolling_max_drawdown(df, "k", "t", "r", n, rows=rows), "max_drawdown")
    for key, rs in by_key(data).items():
        f = [1 + (r[5] or 0.0) for r in rs]
        for i, r in enumerate(rs):
            if i < n - 1:
                assert have[key, r[1]] is None
                continue
            worst = 0.0
            for a in range(i - n + 1, i + 1):
                level = 1.0
                for b in range(a + 1, i + 1):
                    level *= f[b]
                    worst = min(worst, level - 1)
            assert have[key, r[1]] == pytest.approx(worst, abs=1e-9)


def test_chunks_are_even_and_in_order(spark):
    d = spark.range(20000).selectExpr("'a' as k", "id * id as t").union(spark.range(50).selectExpr("'b'", "id"))
    c = chunks.numbered(chunks.chunked(d, "k", "t", 1000), "k", "t")
    sizes = {(r["k"], r["chunk_"]): (r["n"], r["lo"], r["hi"]) for r in c.groupBy("k", "chunk_").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("i_").alias("hi")).collect()}
    assert sizes["b", 0][0] == 50 and len(sizes) > 15
    assert c.where("k = 'a' and i_ * i_ <> t").count() == 0
    assert max(n for (k, _), (n, *_) in sizes.items()) < 4000  # times lie densest at the beginning


def test_a_key_without_rows_or_times(spark):
    df, _ = table(spark)
    assert folds.apply_band(df.where("false"), "k", "t", "x").collect() == []
    same = df.selectExpr("k", "cast(0 as long) as t", "x").limit(50)
    assert chunks.chunked(same, "k", "t", 3).select("chunk_").distinct().count() == 1  # one time can't be cut
