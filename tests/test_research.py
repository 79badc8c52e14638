"""As-of by number of entries equals reindexing with a limited forward fill."""

import datetime as dt
import random

import pandas as pd
import pytest

from quantloom.operators import research as rs

DAY = dt.date(2020, 1, 1)


@pytest.mark.parametrize(("seed", "limit"), [(1, 5), (2, 1), (3, 0), (4, 2)])
def test_limited_carry(spark, seed, limit):
    rng = random.Random(seed)
    days = [DAY + dt.timedelta(days=k) for k in range(200) if rng.random() < 0.7]
    entries = [(key, DAY + dt.timedelta(days=k), None if rng.random() < 0.1 else rng.random()) for key, p in (("a", 0.3), ("b", 0.05), ("c", 0.9)) for k in range(200) if rng.random() < p]
    lags = {"a": 2, "c": 1}
    got = {(r.k, r.d): r.value for r in rs.asof_entries(spark.createDataFrame([(d,) for d in days], "d date"), spark.createDataFrame(entries, "k string, d date, value double"), "k", "d", limit, lags).collect()}
    assert len(got) == 3 * len(days)
    idx = pd.DatetimeIndex(days)
    for key in "abc":
        s = pd.Series({pd.Timestamp(d + dt.timedelta(days=lags.get(key, 0))): v for k, d, v in entries if k == key}, dtype=float).sort_index()
        want = s.reindex(idx, method="ffill", limit=limit) if limit else s.reindex(idx)
        for d, w in zip(days, want, strict=True):
            assert got[key, d] == (None if pd.isna(w) else w)


def test_wide_and_features(spark):
    rng = random.Random(5)
    names = ["funding", "implied", "addresses", "transfers", "hashes", "mvrv", "inflow", "outflow", "stable", "locked", "fear", "stocks", "dollar", "bonds", "gold"]
    rows = [(n, DAY + dt.timedelta(days=k), rng.uniform(1, 2)) for n in names for k in range(260)]
    w = rs.wide(spark.createDataFrame(rows, "n string, date date, value double"), "n", names, "date").selectExpr("'x' as asset", "*", "10 + funding as close")
    f = rs.features(w, "asset", "date").toPandas().set_index("date").sort_index()
    p = w.toPandas().set_index("date").sort_index()
    assert list(f.columns[2:]) == list(rs.FEATURES)
    weekly = p["funding"].rolling(7).mean()
    want = (weekly - weekly.rolling(365, min_periods=180).mean()) / weekly.rolling(365, min_periods=180).std()
    pd.testing.assert_series_equal(f["funding_z"].astype(float), want, check_names=False)
    s = p["hashes"].rolling(7).mean()
    pd.testing.assert_series_equal(f["hashes_growth"].astype(float), s / s.shift(30) - 1, check_names=False)
    flow = (p["inflow"] - p["outflow"]).rolling(7).sum() / (p["inflow"] + p["outflow"]).rolling(7).sum()
    pd.testing.assert_series_equal(f["net_flow"].astype(float), flow, check_names=False)
