"""Small exact cases, nulls and look-ahead."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import crosssec as cs
from quantloom.operators import joins as jn
from quantloom.operators import scoring as sc
from quantloom.operators import folds as fo
from quantloom.operators import stateful as so
from quantloom.operators import stats as st
from quantloom.operators import timeseries as ts


def series(spark, values, name="x", kind="double"):
    return spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(days=k), v if v is None else float(v)) for k, v in enumerate(values)], f"k string, d date, {name} {kind}")


def column(df, name, order="d"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_band(spark):
    df = fo.apply_band(series(spark, [0.5, 0.55, 0.7, 0.72, 0.0, None]), "k", "d", "x", 0.1)
    assert column(df, "held") == [0.5, 0.5, 0.7, 0.7, 0.0, 0.0]


def test_state_machine_same_bar(spark):
    df = spark.createDataFrame([("a", k, e, x) for k, (e, x) in enumerate([(True, True), (False, False), (True, True), (None, True), (True, False)])], "k string, d int, e boolean, x boolean")
    assert column(fo.state_machine(df, "k", "d", "e", "x"), "state") == [1, 1, 0, 0, 1]


def test_rsi_extremes(spark):
    up, down = (fo.rsi(series(spark, v), "k", "d", "x", 2) for v in ([1.0, 2, 3, 4, 5], [5.0, 4, 3, 2, 1]))
    assert column(up, "rsi")[-1] == 100 and column(down, "rsi")[-1] == 0


def bars(spark, rows):
    begin = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("a", begin + dt.timedelta(hours=k), *r) for k, r in enumerate(rows)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, entry boolean, stop_pct double, target_pct double")


@pytest.mark.parametrize(
    ("second", "exit_price", "reason"),
    [((100, 120, 90, 100), 95.0, "stop"), ((80, 120, 70, 100), 80.0, "stop"), ((112, 113, 111, 112), 112.0, "target"), ((100, 111, 99, 100), 110.0, "target"), ((100, 101, 99, 100), 100.0, "end")],
)
def test_trade_exits(spark, second, exit_price, reason):
    flat = (100.0, 100.0, 100.0, 100.0)
    t = so.simulate_trades(bars(spark, [(*flat, True, 0.05, 0.1), (*map(float, second), False, None, None)])).collect()
    assert len(t) == 1 and t[0].exit_price == pytest.approx(exit_price) and t[0].reason == reason
    assert t[0].pnl == pytest.approx(exit_price / 100 * (1 - so.COST) ** 2 - 1)


def test_a_key_without_trades(spark):
    flat = (100.0, 100.0, 100.0, 100.0)
    none = bars(spark, [(*flat, False, 0.05, 0.1)] * 3)
    assert so.simulate_trades(none).collect() == []
    both = none.withColumn("symbol", F.lit("b")).unionByName(bars(spark, [(*flat, True, 0.05, 0.1), (*flat, False, None, None)]))
    assert [(r.symbol, r.bars, r.reason) for r in so.simulate_trades(both).collect()] == [("a", 1, "end")]


def test_fees(spark):
    df = series(spark, [0.01] * 4, "ret").withColumn("pos", F.element_at(F.array(*map(F.lit, (1.0, 1.0, -1.0, 0.0))), F.dayofmonth("d")))
    assert column(st.strategy_returns(df, "k", "d", "pos", "ret", 0.001), "net") == pytest.approx([0.009, 0.01, -0.012, -0.001])


def test_profit_factor_and_threshold(spark):
    r = st.profit_factor(series(spark, [0.2] * 4 + [-0.05] * 6), "k", "x").collect()[0]
    assert r.profit_factor == pytest.approx(0.8 / 0.3)
    assert st.profit_factor(series(spark, [0.2]), "k", "x").collect()[0].profit_factor == float("inf")
    assert st.t_threshold(1) == pytest.approx(2.0) and st.t_threshold(5) < st.t_threshold(50)


def test_rolling_needs_its_window(spark):
    df = series(spark, [1.0, None, 3.0, 4.0, 5.0]).withColumn("m", ts.rolling(F.avg, "x", "k", "d", 2))
    assert column(df, "m") == [None, None, None, 3.5, 4.5]


def test_ranks(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "c", 2.0), (1, "d", None)], "g int, k string, x double")
    assert {r.k: r.rank for r in ts.average_rank(df, "g", "x").collect()} == {"a": 2.5, "b": 1.0, "c": 2.5, "d": None}
    assert {r.k: r.rank for r in ts.first_rank(df, "g", "x", "k").collect()} == {"a": 1, "c": 2, "b": 3, "d": None}
    assert {r.k: r.rank_x for r in cs.neutral_ranks(df, "g", ["x"]).collect()}["d"] == 0.0


def test_asof_ties_and_staleness(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    f = spark.createDataFrame([(1, day(0), 1.0, 1), (1, day(0), 2.0, 2), (1, day(5), None, 3)], "k int, t date, v double, o int")
    p = spark.createDataFrame([(1, day(-1)), (1, day(0)), (1, day(3)), (1, day(4)), (2, day(9))], "k int, d date")
    assert [(r.k, r.v) for r in jn.asof(p, f, "k", "d", "t", "v", "o", 3).orderBy("k", "d").collect()] == [(1, None), (1, 2.0), (1, 2.0), (1, None), (2, None)]


def test_points_ignore_missing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(sc.points((F.col("a") > 0, 2), (F.col("b") > 0, 3))).collect()] == [2.0, 0.0]


def test_month_end(spark):
    df = spark.createDataFrame([(dt.date(2017, 12, 29),), (dt.date(2017, 12, 31),)], "d date")
    assert [tuple(r) for r in df.select(ts.month_end(F.col("d"), 0), ts.month_end(F.col("d"), 1)).collect()] == [(dt.date(2017, 12, 31),) * 2, (dt.date(2017, 12, 31), dt.date(2018, 1, 31))]


def test_no_look_ahead(spark):
    from quantloom.plans.catalog import rotation

    def run(last):
        rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=k), 100.0 + k * g + (k % 5) + (last if k >= 80 else 0)) for s, g in (("a", 1), ("b", 2), ("c", -0.5)) for k in range(90)]
        d = rotation(spark.createDataFrame(rows, "symbol string, date date, close double"))
        return [tuple(r) for r in d.where("date < date'2024-03-21'").orderBy("symbol", "date").select("symbol", "date", "pos").collect()]

    assert run(0) == run(500)
