import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import forecast as fc
from quantloom.sources import parse
from quantloom.streaming import steps

DAY = dt.date(2024, 1, 1)


def payload(spark, x):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),)], "payload string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_json_series(spark):
    t = 1704067200
    assert rows(parse.fear_greed(payload(spark, {"data": [{"value": "40", "timestamp": str(t)}, {"value": "x", "timestamp": str(t)}]}))) == [(DAY, 40.0), (DAY, None)]
    assert rows(parse.stablecoins(payload(spark, [{"date": str(t), "totalCirculatingUSD": {"peggedUSD": 5}}]))) == [(DAY, 5.0)]
    assert rows(parse.locked_value(payload(spark, [{"date": t, "tvl": 7.5}]))) == [(DAY, 7.5)]
    assert rows(parse.metric_rows(payload(spark, [{"time": "2024-01-01T00:00", "PriceUSD": "3"}, {"time": "2024-01-02T00:00"}]), "PriceUSD")) == [(DAY, 3.0)]
    assert rows(parse.frame_values(payload(spark, {"data": [{"cik": 1, "end": "2024-01-01", "val": 2}]}))) == [(1, DAY, 2.0)]
    assert rows(parse.fear_greed(payload(spark, "not json"))) == []


def test_klines_drop_the_open_bar(spark):
    bar = lambda h: [1704067200000 + 3600000 * h, "1", "3", "0.5", "2", "10", 1704067200000 + 3600000 * (h + 1) - 1, "0", 5, "4", "0", "0"]
    k = parse.klines(payload(spark, [bar(0), bar(1)]), F.lit("2024-01-01 01:30:00").cast("timestamp"))
    assert [(r.open, r.high, r.low, r.close, r.volume, r.taker) for r in k.collect()] == [(1.0, 3.0, 0.5, 2.0, 10.0, 4.0)]


def test_filings_tickers_csv(spark):
    recent = {"form": ["4", "8-K", "4"], "filingDate": ["2024-01-01", "2024-01-01", "2020-01-01"], "accessionNumber": ["a", "b", "c"]}
    assert rows(parse.filings(payload(spark, {"filings": {"recent": recent}}), "2023-01-01")) == [(DAY, "a")]
    data = [[1, "A", "aa.b", "NYSE"], [2, "B", "AA.B", "NYSE"], [3, "C", "c", "OTC"]]
    assert rows(parse.company_tickers(payload(spark, {"fields": [], "data": data}))) == [(1, "AA-B", "A", "NYSE")]
    assert rows(parse.dated_csv(payload(spark, "DATE,X\n2024-01-01,4.5\n2024-01-02,.\nbad,1"))) == [(DAY, 4.5)]


def test_html_and_xml(spark):
    html = "<table><tr><td>Short Float</td><td><b>12.5%</b></td><td class=x>Cap</td><td>1,234</td><td>Cap</td><td>9</td></tr></table>"
    m = payload(spark, html).select(parse.table_cells(F.col("payload")).alias("m")).select("m", parse.number(F.col("m")["Cap"]), parse.number(F.col("m")["none"])).collect()[0]
    assert m[0] == {"Short Float": "12.5%", "Cap": "1,234"} and m[1:] == (1234.0, 0.0)
    one = "<nonDerivativeTransaction><transactionCoding><transactionCode>{}</transactionCode></transactionCoding><transactionShares><value>{}</value></transactionShares><transactionPricePerShare><value>10</value></transactionPricePerShare></nonDerivativeTransaction>"
    xml = "<d><rptOwnerName>O</rptOwnerName><officerTitle>CEO</officerTitle>" + one.format("P", 6000) + one.format("S", 9000) + one.format("P", 10) + one.format("A", 9999) + "</d>"
    assert [(r.code, r.amount) for r in parse.insider_transactions(payload(spark, xml)).collect()] == [("P", 60000.0), ("S", -90000.0)]


def test_prob_up(spark):
    q = [float(k) for k in range(1, 10)]
    d = spark.createDataFrame([(5.0, q), (0.5, q), (9.5, q), (1.0, q), (9.0, q), (2.5, q)], "last double, q array<double>")
    assert [round(r[0], 9) for r in d.select(fc.prob_up(F.col("last"), F.col("q"))).collect()] == [0.5, 0.95, 0.05, 0.9, 0.1, 0.75]


def test_walk_forward_and_scores(spark):
    rng = np.random.default_rng(1)
    close = 100 * np.cumprod(1 + 0.01 * rng.standard_normal(60))
    d = spark.createDataFrame([("a", k, float(c)) for k, c in enumerate(close)], "k string, t int, close double")
    out = fc.walk_forward(d, "k", "t", "close", fc.normal_forecaster, 32).orderBy("t").collect()
    assert all(r.quantiles is None for r in out[:31]) and all(len(r.quantiles) == 9 and r.quantiles == sorted(r.quantiles) for r in out[31:])
    changed = d.withColumn("close", F.when(F.col("t") > 50, F.col("close") * 3).otherwise(F.col("close")))
    again = fc.walk_forward(changed, "k", "t", "close", fc.normal_forecaster, 32).orderBy("t").collect()
    assert [r.quantiles for r in again[:51]] == [r.quantiles for r in out[:51]]
    s = spark.createDataFrame([("a", 2.0, 1.0), ("a", 0.0, 9.0)], "k string, v double, y double")
    assert fc.qlike(s, "k", "v", "y").collect()[0].qlike == pytest.approx(np.log(2) + 0.5)


def test_filter_sees_no_future(spark):
    rng = np.random.default_rng(3)
    c = 100 * np.cumprod(1 + 0.01 * rng.standard_normal(160))

    def run(last):
        v = [("a", k, float(x * 1.01), float(x * 0.99), float(x * (last if k >= 150 else 1))) for k, x in enumerate(c)]
        d = spark.createDataFrame(v, "symbol string, ts int, high double, low double, close double")
        return [tuple(r) for r in fc.ensemble_filter(d, settings=fc.Filter(members=20, window=40)).orderBy("ts").collect()]

    a, b = run(1), run(2)
    assert a[:150] == b[:150] and a[10][2] is None and 0 <= a[140][2] <= 1


def test_insert_ignore(spark):
    old = spark.createDataFrame([("a", 1)], "uid string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "uid string, v int")
    assert rows(steps.insert_ignore(new, old, "uid", "v")) == [("b", 3)]
    assert sorted(rows(steps.insert_ignore(new, None, "uid", "v"))) == [("a", 2), ("b", 3)]


def test_account(spark):
    d = [("s", DAY + dt.timedelta(days=k), p, t) for k, (p, t) in enumerate([(100.0, 1.0), (100.0, 0.95), (70.0, 1.0), (200.0, 1.0)])]
    frame = spark.createDataFrame(d + d[:1], "sleeve string, date date, price double, target double")
    r = steps.account_steps(frame).orderBy("date").collect()
    assert r[0].cash == pytest.approx(0) and r[0].qty == pytest.approx(50 * (1 - steps.FEE))
    assert r[1].qty == r[0].qty and not r[1].halted  # inside the band
    assert r[2].halted and r[2].qty == 0 and r[2].cash == pytest.approx(50 * (1 - steps.FEE) * 70 * (1 - steps.FEE))
    assert r[3].qty == 0 and r[3].equity == r[2].cash and len(r) == 4


def test_bars_from_a_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_type as symbol", "cast(ts as timestamp) as ts", "value", "event_id")
    cut = e.selectExpr("percentile_approx(ts, array(0.33, 0.66)) as c").first()["c"]
    for part in (e.where(F.col("ts") < cut[0]), e.where((F.col("ts") >= cut[0]) & (F.col("ts") < cut[1])), e.where(F.col("ts") >= cut[1])):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # one after the other: a stream reads files by their time
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = steps.closed_bars(stream, "1 day").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema("symbol string, ts timestamp, open double, high double, low double, close double, volume long").parquet(f"{tmp_path}/out")
    whole = steps.closed_bars(e)
    assert got.count() > 0 and got.join(whole, got.columns, "left_anti").count() == 0
