"""The queries over keys and month ends on a small table, against brute force over all keys."""

import random
from calendar import monthrange
from datetime import date, datetime, timedelta

import pytest

from quantloom.operators import joins as jn
from quantloom.plans import QUERIES


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = [(k, k % 13, rng.randint(1, 9999) / 4, datetime(1996, 1, 1) + timedelta(days=rng.choice([3, 40, 41, 300, 400, 900])), rng.choice("ABC")) for k in range(1, 80)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    return str(d), [(o, c, v, t.date(), p) for o, c, v, t, p in rows]


def probes(rows):
    end = lambda t: date(t.year, t.month, monthrange(t.year, t.month)[1])
    return [(c, m) for c in sorted({r[1] for r in rows}) for m in sorted({end(r[3]) for r in rows})]


def got(spark, name, d, *cols):
    day = lambda x: x.date() if isinstance(x, datetime) else x
    return sorted(((r.key, day(r.month)), *(r[c] for c in cols)) for r in QUERIES[name](spark, d).collect())


@pytest.mark.parametrize(("name", "back", "old"), [("j7_asof_backward", 0, 450), ("j8_asof_year_earlier", 365, 10**6)])
def test_asof_of_all_keys(spark, orders, name, back, old):
    d, rows = orders
    want = []
    for c, m in probes(rows):
        at = m - timedelta(days=back)
        last = max(((t, o, v) for o, k, v, t, _ in rows if k == c and t <= at), default=None)
        want.append(((c, m), last[2] if last and (at - last[0]).days <= old else None))
    assert len({k for (k, _), _ in want}) == 13
    assert got(spark, name, d, "value") == want


@pytest.mark.parametrize("name", ["j7_asof_backward", "j8_asof_year_earlier"])
def test_keys_meet_months_after_the_sort(spark, orders, name):
    plan = QUERIES[name](spark, orders[0])._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Generate explode") < plan.find("Window ")  # the sort holds facts, not keys times months


def test_asof_of_facts_that_lack_something(spark):
    day = lambda n: date(2020, 1, n)
    f = spark.createDataFrame([(1, None, day(2), 1), (1, 5.0, day(4), 2), (1, 6.0, day(4), 3), (1, 7.0, None, 4), (2, 1.0, None, 5), (None, 1.0, day(1), 6), (3, 9.0, day(9), 7), (4, 2.0, day(1), 8)], "k int, v double, t date, o int")
    d = spark.createDataFrame([([day(n) for n in (1, 3, 5, 8)],)], "d array<date>")
    got = {(r.k, r.at.day): r.v for r in jn.asof_dates(f, d, "k", "at", "t", "v", "o", 1, 2).collect()}
    want = {(k, n): None for k in (None, 1, 2, 3, 4) for n in (1, 3, 5, 8)}
    assert got == {**want, (1, 5): 6.0, (4, 3): 2.0}


def test_interval_window_of_all_keys(spark, orders):
    d, rows = orders
    want = []
    for c, m in probes(rows):
        near = [(v, p) for _, k, v, t, p in rows if k == c and m - timedelta(days=90) < t <= m]
        if near:
            want.append(((c, m), len(near), len({p for _, p in near}), pytest.approx(sum(v for v, _ in near))))
    assert got(spark, "j12_interval_window", d, "filings", "owners", "value") == want
