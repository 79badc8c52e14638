"""Swept cells equal single runs; bands equal a loop over windows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import sweeps as sw

DAY = dt.date(2020, 1, 1)


def prices(spark, seed=2, days=420):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", "c"):
        x = 100.0
        for k in range(0 if s != "c" else 90, days):
            x *= 1 + rng.gauss(0.001, 0.03)
            rows.append((s, DAY + dt.timedelta(days=k), x))
    return spark.createDataFrame(rows, "symbol string, date date, close double"), rows


def single(rows, v: sw.Variant):
    """Net returns by date and symbol of one variant, with pandas."""
    wide = pd.DataFrame(rows, columns=["s", "d", "c"]).pivot(index="d", columns="s", values="c")
    mom = sum(wide / wide.shift(n) - 1 for n in v.lookbacks) / len(v.lookbacks)
    vol = wide.pct_change(fill_method=None).rolling(30).std() * np.sqrt(365)
    w = ((mom.rank(axis=1, ascending=False, method="first") <= v.top) & (mom > 0) & (vol > 0)) * (v.target / vol).clip(upper=1) / v.top
    w = w.fillna(0.0)
    sunday = pd.Series([d.weekday() == 6 for d in w.index], index=w.index)
    w = w[sunday].reindex(w.index).ffill().fillna(0.0)
    if v.guarded:
        w = w.mul(1 - (wide["a"] < wide["a"].rolling(50).mean()).astype(float), axis=0)
    p = w.shift(1).fillna(0.0)
    turn = p.diff().abs().fillna(p.abs())
    return p * wide.pct_change(fill_method=None).fillna(0.0) - turn * 0.003


def test_cells_equal_single_runs(spark):
    df, rows = prices(spark)
    variants = [sw.Variant("one"), sw.Variant("wide", lookbacks=(10, 40), target=0.2), sw.Variant("two", top=2, guarded=True)]
    from quantloom.operators import scoring as sc
    from quantloom.operators import timeseries as ts

    low = (F.col("symbol") == "a") & sc.holds(F.col("close") < ts.rolling(F.avg, "close", "symbol", "date", 50))
    d = df.withColumn("low", low)
    swept = sw.rotations(d, variants, F.col("low")).cache()
    for k, v in enumerate(variants):
        want = single(rows, v)
        for r in swept.collect():
            assert r[f"n{k}"] == pytest.approx(want.loc[r["date"], r["symbol"]], abs=1e-12)
    periods = {"first": ("2020-01-01", "2020-08-01"), "rest": ("2020-08-01", None), "all": ("2020-01-01", None)}
    got = {(r.period, r.variant): r for r in sw.accounts(swept, variants, periods).collect()}
    assert len(got) == 9
    for k, v in enumerate(variants):
        own = single(rows, v).sum(axis=1)
        for name, (a, b) in periods.items():
            x = own[[d >= dt.date.fromisoformat(a) and (b is None or d < dt.date.fromisoformat(b)) for d in own.index]]
            e = (1 + x).cumprod()
            assert got[name, v.name].days == len(x) and got[name, v.name].max_drawdown == pytest.approx((e / e.cummax() - 1).min())
    assert got["all", "one"].trades >= got["first", "one"].trades + got["rest", "one"].trades > 0


def test_bands_and_verdict(spark):
    df, rows = prices(spark)
    from quantloom.operators import timeseries as ts

    d = df.withColumn("ret", ts.pct_change("close", "symbol", "date"))
    windows = {"short": 7, "long": 60}
    known = sw.bands(d, "symbol", "date", "ret", windows, rows=50)
    got = {(r.symbol, r.span, r.measure): r for r in known.collect()}
    for s in "abc":
        level = pd.Series([c for x, _, c in rows if x == s])
        for span, n in windows.items():
            ret = (level / level.shift(n) - 1).dropna()
            dd = level.rolling(n).apply(lambda x: (x / np.maximum.accumulate(x) - 1).min(), raw=True).dropna()
            for name, x in (("ret", ret), ("drawdown", dd)):
                r = got[s, span, name]
                assert [r.p5, r.p25, r.p50, r.p75, r.p95] == pytest.approx([x.quantile(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)])
                assert r.negative == pytest.approx((x < 0).mean())
    live = spark.createDataFrame([("a", 5, -0.9), ("b", 30, 0.0), ("c", 500, 9.0), ("z", 3, 0.1)], "symbol string, n int, perf double")
    v = {r.symbol: (r.span, r.verdict) for r in sw.band_verdict(live, known, "symbol", "n", "perf", windows).collect()}
    assert v["a"] == ("short", "below") and v["b"][0] == "long" and v["c"] == ("long", "above") and v["z"] == ("short", None)
