"""The monthly panel: what is known when, splits, purchases, holes."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quantloom.operators import panel as pn

FIRST, LAST = dt.date(2015, 1, 1), dt.date(2018, 6, 29)


def weekdays():
    return [d for k in range((LAST - FIRST).days + 1) if (d := FIRST + dt.timedelta(days=k)).weekday() < 5]


def tables(spark, change=lambda t, d, c: c, split=None):
    close = lambda k, d: 50 + 10 * math.sin((d - FIRST).days / (40 + k)) + k
    days = weekdays()
    prices = [(f"T{k}", d, x) for k in range(5) for d in days if (x := change(f"T{k}", d, close(k, d))) is not None]
    shares = [(f"T{k}", dt.date(y, m, 1), (1e8 + 1e6 * (y - 2014)) * (1 if split is None or k != 3 else 0.01 if dt.date(y, m, 1) >= split else 1)) for k in range(5) for y in range(2014, 2019) for m in (1, 4, 7, 10)]
    accounts = [(f"T{k}", y, dt.date(y + 1, 3, 31), 1e9 + y, 4e8 + k, 2e9, 2e8, 1e8) for k in range(5) for y in range(2013, 2018) if (k, y) != (2, 2015)]
    purchases = [("T3", dt.date(2017, 3, 10), "a", 1e5), ("T3", dt.date(2017, 3, 20), "b", 2e5), ("T3", dt.date(2017, 3, 21), "a", 5e4), ("T3", dt.date(2017, 4, 5), "c", 3e5)]
    make = spark.createDataFrame
    out = [make(prices, "ticker string, date date, close double"), make(shares, "ticker string, end date, val double"), make(accounts, "ticker string, year int, available date, revenue double, gross_profit double, assets double, net_income double, cfo double")]
    return [*out, make(purchases, "ticker string, filing_date date, owner string, value double"), make([("T3", split, 0.01)], "ticker string, date date, ratio double") if split else None]


def panel(spark, *a, **k):
    return {(r.date, r.ticker): r for r in pn.monthly_panel(*tables(spark, *a, **k)).collect()}


@pytest.fixture(scope="module")
def base(spark):
    return panel(spark)


def test_months_and_columns(base):
    days = sorted({d for d, _ in base})
    assert days[0] >= FIRST + dt.timedelta(days=380) and days[-1] == LAST and len(days) == 30
    assert all(r.mcap == pytest.approx(base[d, t].mcap) and r.fwd_ret is not None or d == LAST for (d, t), r in base.items())


def test_purchases_count_by_their_filing(base):
    march, april, july = (base[d, "T3"] for d in (dt.date(2017, 3, 31), dt.date(2017, 4, 28), dt.date(2017, 7, 31)))
    assert march.insider_buyers == 2 and march.insider_share == pytest.approx(3.5e5 / march.mcap)
    assert april.insider_buyers == 3 and july.insider_buyers == 0 and base[dt.date(2017, 3, 31), "T4"].insider_buyers == 0


def test_accounts_count_once_published(base):
    assert base[dt.date(2017, 2, 28), "T0"].revenue_growth == pytest.approx((1e9 + 2015) / (1e9 + 2014) - 1)
    assert base[dt.date(2017, 3, 31), "T0"].revenue_growth == pytest.approx((1e9 + 2016) / (1e9 + 2015) - 1)  # published that day
    assert base[dt.date(2017, 5, 31), "T2"].revenue_growth is None  # no year before it, and the last growth is too old
    assert base[dt.date(2017, 5, 31), "T2"].gross_margin == pytest.approx((4e8 + 2) / 2e9)


def test_shares_a_year_before(base):
    r = base[dt.date(2017, 7, 31), "T1"]  # counts of 1 July are known from the 16th on
    assert r.shares_change == pytest.approx((1e8 + 3e6) / (1e8 + 2e6) - 1)
    assert base[dt.date(2017, 1, 31), "T1"].mcap / 1e6 == pytest.approx((100 + 3) * (50 + 10 * math.sin((dt.date(2017, 1, 31) - FIRST).days / 41) + 1))


def test_no_future_price_matters(spark, base):
    cut = dt.date(2017, 6, 30)
    other = panel(spark, lambda t, d, c: c * 3 if d > cut else c)
    for key, r in base.items():
        if key[0] <= cut:
            assert [getattr(other[key], c) for c in (*pn.FEATURES, "mcap")] == [getattr(r, c) for c in (*pn.FEATURES, "mcap")]


def test_a_reverse_split_changes_no_value(spark):
    """One dollar a share and a billion shares, one for a hundred: the adjusted price was a hundred before."""
    day = dt.date(2017, 1, 3)
    price = lambda t, d, c: 100.0 if t == "T3" else c
    split = panel(spark, price, split=day)
    lone = {k for k in split if k[1] == "T3"}
    assert not lone  # 1e8 shares before, 1e6 after: a hundred million at all times, below two billion
    rows = tables(spark, price, split=day)
    naive = {(r.date, r.ticker) for r in pn.monthly_panel(*rows[:4]).collect()}
    assert (dt.date(2016, 6, 30), "T3") in naive


def test_holes_in_prices(spark):
    """No price on a month's last day: no row, and no return for the month before."""
    gone = dt.date(2017, 5, 31)
    p = panel(spark, lambda t, d, c: None if t == "T1" and d == gone else c)
    assert (gone, "T1") not in p and p[dt.date(2017, 4, 28), "T1"].fwd_ret is None and p[gone, "T0"].fwd_ret is not None


def test_nothing(spark):
    t = tables(spark)
    assert pn.monthly_panel(t[0].where("false"), *t[1:4]).collect() == []
    assert pn.monthly_panel(t[0], t[1].where(F.lit(False)), *t[2:4]).collect() == []


def test_ties_round_as_in_sql(spark):
    """Prices by the dozen end in a half of the last digit that is kept."""
    import duckdb

    from quantloom.sources import frames as fr

    x = [k / 100 / q for k in range(1000000, 1003000, 7) for q in (16.0, 32.0, 48.0)] + [-0.5e-6, 0.5e-6, -1.0000005, 0.0, float("inf")]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(x)), "i int, x double").repartition(1).sortWithinPartitions("i").select(fr.rounded("x", 6)).collect()]
    assert got == [r[0] for r in duckdb.execute("select round(x, 6) from (select unnest($1::double[]) as x)", [x]).fetchall()]


def gaps(t, d, c):
    """Prices on some days only; T4 begins late and ends early."""
    return None if (d.toordinal() * 7 + int(t[1])) % 5 < 2 or t == "T4" and not dt.date(2015, 5, 6) <= d <= dt.date(2018, 4, 17) else 60.0 if t == "T2" and d.year == 2016 else c


def test_carried_prices_equal_filled_ones(spark):
    from quantloom.operators import timeseries as ts

    prices, *rest = tables(spark, gaps)
    filled = ts.fill_days(prices, "ticker", "date", "close").select("ticker", "date", "close")
    want = sorted(map(tuple, pn.monthly_panel(filled, *rest).collect()))
    assert len(want) > 100 and {t for _, t, *_ in want} == {f"T{k}" for k in range(5)}
    assert sorted(map(tuple, pn.monthly_panel(prices, *rest, carried=True).collect())) == want


def test_price_windows_stand_at_month_ends_only(spark, monkeypatch):
    """No window of prices slides over all days; blocks smaller than a company make no difference."""
    import numpy as np

    prices, *rest = tables(spark, gaps)
    plan = pn.monthly_panel(prices, *rest)._jdf.queryExecution().executedPlan().toString()
    assert f"-{pn.YEAR - 1}" not in plan
    monkeypatch.setattr(pn, "BLOCK", 100)
    rows = pn.month_ends(prices, False).collect()
    days = {t: [(r.date, r.close) for r in sorted(prices.where(F.col("ticker") == t).collect(), key=lambda r: r.date)] for t in {r.ticker for r in rows}}
    assert len(rows) == len({(t, d.year, d.month) for t, x in days.items() for d, _ in x})
    for r in rows:
        x = [(d, c) for d, c in days[r.ticker] if (d - dt.date(1970, 1, 1)).days <= r.at]
        c = np.array([c for _, c in x])
        back = np.diff(c) / c[:-1]
        near = lambda v: v if v is None else pytest.approx(v)
        assert r.close == c[-1] and r.momentum == near(c[-22] / c[-253] - 1 if len(c) > 252 else None) and r.month_return == near(c[-1] / c[-22] - 1 if len(c) > 21 else None)
        assert r.near_high == near(c[-1] / c[-252:].max() if len(c) >= 200 else None) and r.volatility == near(back[-252:].std(ddof=1) * 252**0.5 if len(back) >= 200 else None)
        assert r.above_average == (float(c[-50:].mean() > c[-200:].mean()) if len(c) >= 200 else None) or c[-200:].std() == 0
