"""Payload parsers on literal payloads."""

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from quantloom.sources import parse


def one(spark, payload, **more):
    return spark.createDataFrame([(payload, *more.values())], ["payload", *more])


def test_candles_and_funding(spark):
    now = F.to_timestamp(F.lit("2024-01-01 02:00:00"))
    got = parse.exchange_candles(one(spark, json.dumps([[1704067200, 1, 4, 2, 3, 9], [1704074400, 1, 1, 1, 1, 1]])), now).collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(2, 4, 1, 3, 9)]
    pages = spark.createDataFrame([(json.dumps([{"timestamp": "2024-01-01T08:00:00.000Z", "fundingRate": 0.1}]),), (json.dumps([{"timestamp": "2024-01-01T08:00:00.000Z", "fundingRate": 0.1}, {"timestamp": "2024-01-01T16:00:00.000Z", "fundingRate": 0.2}]),), ("broken",)], "payload string")
    assert sorted(r.rate for r in parse.funding_rates(pages).collect()) == [0.1, 0.2]
    index = parse.volatility_index(one(spark, json.dumps({"result": {"data": [[1704067200000, 1, 2, 0, 5.5], [1704070800000, 1, 2, 0, 7.5], [1704153600000, 1, 1, 1, 6.0]]}}))).orderBy("date").collect()
    assert [(r.date, r.value) for r in index] == [(dt.date(2024, 1, 1), 5.5), (dt.date(2024, 1, 2), 6.0)]


def test_feed_and_mentions(spark):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><company-info><cik>320193</cik></company-info></feed>'
    d = spark.createDataFrame([(feed,), ("<feed/>",), (None,)], "payload string")
    assert [r[0] for r in d.select(parse.feed_cik("payload")).collect()] == ["0000320193", None, None]
    posts = {"data": {"children": [{"data": {"title": "buy abc now", "selftext": "", "score": 5}}, {"data": {"title": "abcd", "selftext": "x ABC", "score": 2}}, {"data": {"title": "abcd", "selftext": None, "score": 9}}]}}
    got = parse.mentions(one(spark, json.dumps(posts), ticker="ABC").unionByName(one(spark, "{}", ticker="XYZ"))).collect()
    assert {r.ticker: (r.mentions, r.score) for r in got} == {"ABC": (2, 7), "XYZ": (0, 0)}


def test_transactions_without_a_price(spark):
    def t(code, shares, price):
        p = f"<transactionPricePerShare><value>{price}</value></transactionPricePerShare>" if price else ""
        return f"<nonDerivativeTransaction><transactionCode>{code}</transactionCode><transactionShares><value>{shares}</value></transactionShares>{p}</nonDerivativeTransaction>"

    doc = f"<doc><rptOwnerName>A B</rptOwnerName><officerTitle>CEO</officerTitle>{t('P', 1000, None)}{t('P', 1000, 100)}{t('S', 2000, 50)}</doc>"
    got = parse.insider_transactions(one(spark, doc)).collect()
    assert [(r.code, r.shares, r.price, r.amount) for r in got] == [("P", 1000, 100, 100000), ("S", 2000, 50, -100000)]


def test_filing_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q1.zip", "w") as z:
        z.writestr("2024/Submission.tsv", "ACCESSION_NUMBER\tFILING_DATE\tISSUERCIK\tISSUERTRADINGSYMBOL\na\t31-MAR-2017\t7\t abc\nb\t01-APR-2017\tx\tdef\n")
        z.writestr("NONDERIV_TRANS.TSV", "ACCESSION_NUMBER\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\na\tP\t10\t2.5\na\tS\t10\t2.5\na\tP\t10\t\nb\tP\t1\t1\n")
        z.writestr("REPORTINGOWNER.TSV", "ACCESSION_NUMBER\tRPTOWNERCIK\na\t5\na\t6\n")
    tables = [parse.archive_table(spark, str(tmp_path / "*.zip"), n) for n in ("SUBMISSION.TSV", "NONDERIV_TRANS.TSV", "REPORTINGOWNER.TSV")]
    got = parse.filed_purchases(*tables).collect()
    assert [tuple(r) for r in got] == [(dt.date(2017, 3, 31), 7, "ABC", "5", 25.0)]
