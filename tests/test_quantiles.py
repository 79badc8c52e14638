"""Quantiles in chunks and blocks equal a sort of every window."""

import random

import numpy as np
import pytest

from quantloom.operators import quantiles


def table(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key, many in (("a", 200), ("b", 9), (None, 40), ("c", 1)):
        for t in range(many):
            x = rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) + t / 20, 1.0, None])
            rows.append((key, 3 * t + rng.randint(0, 2), x))
    mixed = list(rows)
    rng.shuffle(mixed)
    return spark.createDataFrame(mixed, "k string, t long, x double").repartition(3), rows


def want(rows, q, n, least):
    out = {}
    for key in {r[0] for r in rows}:
        x = [r[2] for r in rows if r[0] == key]
        for i, r in enumerate([r for r in rows if r[0] == key]):
            seen = [y for y in x[max(0, i + 1 - (n or i + 1)) : i + 1] if y is not None]
            out[key, r[1]] = float(np.quantile(seen, q)) if len(seen) >= max(1, least) else None
    return out


@pytest.mark.parametrize(("rows", "q", "least"), [(5, 0.5, 3), (16, 0.9, 1), (64, 0.0, 1), (64, 1.0, 30), (10**6, 0.5, 0)])
def test_expanding(spark, rows, q, least):
    df, data = table(spark, rows)
    got = {(r.k, r.t): r.v for r in quantiles.expanding_quantile(df, "k", "t", "x", q, least, "v", rows=rows).collect()}
    assert got == pytest.approx(want(data, q, None, least))


@pytest.mark.parametrize(("rows", "n", "q", "least"), [(5, 7, 0.5, 3), (16, 3, 0.9, 1), (30, 30, 0.25, 20), (10**6, 1, 0.5, 1)])
def test_rolling(spark, rows, n, q, least):
    df, data = table(spark, n)
    got = {(r.k, r.t): r.v for r in quantiles.rolling_quantile(df, "k", "t", "x", q, n, least, "v", rows=rows).collect()}
    assert got == pytest.approx(want(data, q, n, least))


def test_nothing(spark):
    df, _ = table(spark, 1)
    assert quantiles.expanding_quantile(df.where("false"), "k", "t", "x", 0.5, 1).collect() == []
    none = quantiles.expanding_quantile(df.selectExpr("k", "t", "cast(null as double) as x"), "k", "t", "x", 0.5, 1)
    assert {r.quantile for r in none.collect()} == {None}
