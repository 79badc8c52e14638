"""Peaks and segments equal a loop over windows; the flag rule on a drawn mast and flag."""

import datetime as dt
import random

import pytest

from quantloom.operators import extremes


@pytest.mark.parametrize(("n", "rows"), [(1, 10), (7, 10), (12, 30), (60, 10**6)])
def test_peaks(spark, n, rows):
    rng = random.Random(n)
    data = [(key, t, float(rng.randint(5, 9)), float(rng.randint(0, 5))) for key, many in (("a", 120), ("b", 8), ("c", 1)) for t in range(many)]
    got = {(r.k, r.t): r for r in extremes.peaks(spark.createDataFrame(data, "k string, t int, h double, l double").repartition(3), "k", "t", "h", "l", n, rows).collect()}
    assert len(got) == len(data)
    for key in "abc":
        x = [r for r in data if r[0] == key]
        for i in range(len(x)):
            r = got[key, i]
            if i < n - 1:
                assert r.peak is None and r.low_after is None
                continue
            w = x[i - n + 1 : i + 1]
            top = max(y[2] for y in w)
            at = next(j for j, y in enumerate(w) if y[2] == top)
            assert (r.peak, r.peak_age, r.low_before, r.low_after) == (top, n - 1 - at, min(y[3] for y in w[: at + 1]), min(y[3] for y in w[at:]))


def test_flag_rule(spark):
    closes = [100.0] * 20 + [100 + 2.0 * k for k in range(1, 41)] + [178.0, 176.0, 177.0, 175.0, 176.0, 175.0, 177.0, 176.0, 175.0, 176.0, 177.0, 176.0, 185.0, 186.0]
    start = dt.datetime(2024, 1, 1)
    bars = [("s", start + dt.timedelta(hours=k), c, c + 1, c - 1, c) for k, c in enumerate(closes)]
    out = extremes.flag_setup(spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, open double, high double, low double, close double"), 0.3, 0.1, 0.5).orderBy("ts").collect()
    hits = [k for k, r in enumerate(out) if r.entry]
    assert hits == [72]  # the next close only equals the high before it
    r = out[72]
    assert r.stop_pct == pytest.approx(1 - 174 / 185) and r.target_pct == pytest.approx((186 - 99) / 185)
    zero = spark.createDataFrame([(*b[:2], 0.0, 0.0, 0.0, 0.0) for b in bars], "symbol string, ts timestamp_ntz, open double, high double, low double, close double")
    assert not any(r.entry for r in extremes.flag_setup(zero, 0.3, 0.1, 0.5).collect())
