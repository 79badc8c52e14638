"""Payload parsers: string columns (JSON, XML, HTML, CSV) to rows with built-in functions. Bad payloads give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(df: DataFrame, payload: str, schema: str, path: str | None = None) -> DataFrame:
    j = F.from_json(payload, schema)
    return df.select(F.explode(j[path] if path else j).alias("r"))


def day_of(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds.cast("long")))


def fear_greed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """date, value of {"data": [{"value": "..", "timestamp": ".."}]}."""
    r = _rows(df, payload, "data array<struct<value:string,timestamp:string>>", "data")
    return r.select(day_of(F.col("r.timestamp")).alias("date"), F.try_to_number("r.value", F.lit("999")).cast("double").alias("value"))


def stablecoins(df: DataFrame, payload: str = "payload") -> DataFrame:
    """date, value of [{"date": "..", "totalCirculatingUSD": {"peggedUSD": ..}}]."""
    r = _rows(df, payload, "array<struct<date:string,totalCirculatingUSD:struct<peggedUSD:double>>>")
    return r.select(day_of(F.col("r.date")).alias("date"), F.col("r.totalCirculatingUSD.peggedUSD").alias("value"))


def locked_value(df: DataFrame, payload: str = "payload") -> DataFrame:
    """date, value of [{"date": .., "tvl": ..}]."""
    r = _rows(df, payload, "array<struct<date:long,tvl:double>>")
    return r.select(day_of(F.col("r.date")).alias("date"), F.col("r.tvl").alias("value"))


def metric_rows(df: DataFrame, metric: str, payload: str = "payload") -> DataFrame:
    """date, value of [{"time": "2020-01-01T..", metric: ".."}]; rows without the metric are left out."""
    r = _rows(df, payload, "array<map<string,string>>")
    return r.select(F.to_date(F.substring(F.col("r")["time"], 1, 10)).alias("date"), F.col("r")[metric].cast("double").alias("value")).where("value is not null")


def klines(df: DataFrame, now: Column, payload: str = "payload") -> DataFrame:
    """Closed bars of [[open ms, open, high, low, close, volume, close ms, .., .., taker volume, ..]]."""
    r = _rows(df, payload, "array<array<string>>")
    at = lambda k: F.get("r", F.lit(k)).cast("double")
    bars = r.select(
        F.timestamp_millis(F.get("r", F.lit(0)).cast("long")).alias("ts"), at(1).alias("open"), at(2).alias("high"), at(3).alias("low"), at(4).alias("close"), at(5).alias("volume"), at(9).alias("taker"), F.timestamp_millis(F.get("r", F.lit(6)).cast("long")).alias("_closed")
    )
    return bars.where(F.col("_closed") < now).drop("_closed")


def filings(df: DataFrame, since: str, payload: str = "payload") -> DataFrame:
    """filed, accession of form 4 in {"filings": {"recent": {"form": [..], "filingDate": [..], "accessionNumber": [..]}}}."""
    j = F.from_json(payload, "filings struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>>>")["filings"]["recent"]
    r = df.select(F.explode(F.arrays_zip(j["form"].alias("form"), j["filingDate"].alias("filed"), j["accessionNumber"].alias("accession"))).alias("r"))
    return r.where(F.col("r.form") == "4").select(F.to_date("r.filed").alias("filed"), "r.accession").where(F.col("filed") >= F.to_date(F.lit(since)))


def company_tickers(df: DataFrame, payload: str = "payload") -> DataFrame:
    """cik, ticker, name, exchange of {"fields": [..], "data": [[cik, name, ticker, exchange]]} on two exchanges, one row a ticker."""
    from ..operators.joins import first_of

    r = _rows(df, payload, "fields array<string>, data array<array<string>>", "data")
    at = lambda k: F.get("r", F.lit(k))
    r = r.select(at(0).cast("int").alias("cik"), F.regexp_replace(F.upper(at(2)), r"\.", "-").alias("ticker"), at(1).alias("name"), at(3).alias("exchange"))
    return first_of(r.where(F.col("exchange").isin("NYSE", "Nasdaq")), ["ticker"], "cik")


def frame_values(df: DataFrame, payload: str = "payload") -> DataFrame:
    """cik, end, val of {"data": [{"cik": .., "end": "..", "val": ..}]}."""
    r = _rows(df, payload, "data array<struct<cik:int,end:string,val:double>>", "data")
    return r.select("r.cik", F.to_date("r.end").alias("end"), "r.val")


def dated_csv(df: DataFrame, payload: str = "payload") -> DataFrame:
    """date, value of "header\\ndate,value" text; a dot or anything that isn't a number is left out."""
    line = df.select(F.explode(F.slice(F.split(payload, r"\r?\n"), 2, 1_000_000)).alias("l"))
    return line.select(F.expr("try_cast(split_part(l, ',', 1) AS DATE)").alias("date"), F.expr("try_cast(split_part(l, ',', 2) AS DOUBLE)").alias("value")).where("date is not null and value is not null")


def table_cells(html: Column) -> Column:
    """map of label -> value from a page's alternating table cells; the first of equal labels counts."""
    cells = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(cells) / 2) - 1, F.lit(0))), lambda i: F.struct(F.get(cells, (2 * i).cast("int")).alias("k"), F.get(cells, (2 * i + 1).cast("int")).alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"].isNotNull())
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def number(text: Column) -> Column:
    """A number with per cent sign and thousands commas; 0 where there is none."""
    return F.coalesce(F.regexp_replace(text, "[%,]", "").try_cast("double"), F.lit(0.0))


def insider_transactions(df: DataFrame, payload: str = "payload", least: float = 50_000) -> DataFrame:
    """owner, title, code, shares, price, amount (negative for sales) of Form 4 documents: open-market buys and sales of at least `least`."""
    x = df.select(
        F.expr(f"xpath_string({payload}, '//rptOwnerName')").alias("owner"),
        F.expr(f"xpath_string({payload}, '//officerTitle')").alias("title"),
        # one fragment a transaction, so that what one lacks doesn't shift the others
        F.explode(F.regexp_extract_all(payload, F.lit(r"(?s)<nonDerivativeTransaction>.*?</nonDerivativeTransaction>"), F.lit(0))).alias("t"),
    )
    at = lambda path: F.expr(f"xpath_string(t, '{path}')")
    x = x.select("owner", "title", at("//transactionCode").alias("code"), at("//transactionShares/value").try_cast("double").alias("shares"), at("//transactionPricePerShare/value").try_cast("double").alias("price"))
    amount = F.col("shares") * F.col("price")
    return x.where(F.col("code").isin("P", "S") & (amount >= least)).withColumn("amount", F.when(F.col("code") == "P", amount).otherwise(-amount))


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """All frames under one another with their name in `tag`."""
    out = None
    for name, df in frames.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def exchange_candles(df: DataFrame, now: Column, payload: str = "payload") -> DataFrame:
    """Bars of [[seconds, low, high, open, close, volume]] that began before `now`."""
    r = _rows(df, payload, "array<array<double>>")
    at = lambda k: F.get("r", F.lit(k))
    return r.select(F.timestamp_seconds(at(0).cast("long")).alias("ts"), at(3).alias("open"), at(2).alias("high"), at(1).alias("low"), at(4).alias("close"), at(5).alias("volume")).where(F.col("ts") < now)


def funding_rates(df: DataFrame, payload: str = "payload") -> DataFrame:
    """ts, rate of [{"timestamp": "..", "fundingRate": ..}], one row a time: pages may overlap."""
    r = _rows(df, payload, "array<struct<timestamp:string,fundingRate:double>>")
    return r.select(F.to_timestamp("r.timestamp").alias("ts"), F.col("r.fundingRate").alias("rate")).where("ts is not null").groupBy("ts").agg(F.first("rate").alias("rate"))


def volatility_index(df: DataFrame, payload: str = "payload") -> DataFrame:
    """date, value (the close) of {"result": {"data": [[ms, open, high, low, close]]}}, the first row of each day."""
    j = F.from_json(payload, "result struct<data:array<array<double>>>")["result"]["data"]
    r = df.select(F.posexplode(j).alias("k", "r")).select("k", F.timestamp_millis(F.get("r", F.lit(0)).cast("long")).alias("ts"), F.get("r", F.lit(4)).alias("value"))
    return r.groupBy(F.to_date("ts").alias("date")).agg(F.min_by("value", F.struct("ts", "k")).alias("value"))


def feed_cik(payload: Column | str) -> Column:
    """The company number of an Atom feed, ten digits; NULL where there is none."""
    found = F.regexp_extract(payload, r"(?s)<(?:[\w.-]+:)?cik>\s*(\d+)\s*</", 1)
    return F.when(found != "", F.lpad(found, 10, "0"))


def mentions(df: DataFrame, ticker: str = "ticker", payload: str = "payload") -> DataFrame:
    """ticker, mentions, score: posts of {"data": {"children": [{"data": {"title", "selftext", "score"}}]}} that name the ticker as a word between spaces."""
    posts = F.from_json(payload, "data struct<children:array<struct<data:struct<title:string,selftext:string,score:long>>>>")["data"]["children"]
    p = df.select(ticker, F.explode_outer(posts).alias("p")).select(ticker, "p.data.*")
    word = F.concat(F.lit(" "), F.upper(ticker), F.lit(" "))
    named = lambda c: F.coalesce(F.contains(F.concat(F.lit(" "), F.upper(c), F.lit(" ")), word), F.lit(False))
    hit = named("title") | named("selftext")
    return p.groupBy(ticker).agg(F.count_if(hit).alias("mentions"), F.coalesce(F.sum(F.when(hit, F.col("score"))), F.lit(0)).alias("score"))


def filed_purchases(submissions: DataFrame, transactions: DataFrame, owners: DataFrame) -> DataFrame:
    """filing_date, cik, ticker, owner, value of open-market purchases (code P) from the three tables of a filing archive, all strings.

    A filing with several owners counts the first by number; rows without date, company or value are left out.
    """
    one = owners.groupBy("ACCESSION_NUMBER").agg(F.min("RPTOWNERCIK").alias("owner"))
    d = transactions.where("TRANS_CODE = 'P'").join(submissions, "ACCESSION_NUMBER").join(one, "ACCESSION_NUMBER", "left")
    value = F.col("TRANS_SHARES").try_cast("double") * F.col("TRANS_PRICEPERSHARE").try_cast("double")
    day = F.coalesce(F.try_to_timestamp("FILING_DATE", F.lit("dd-MMM-yyyy")), F.try_to_timestamp("FILING_DATE", F.lit("yyyy-MM-dd"))).cast("date")
    out = d.select(day.alias("filing_date"), F.col("ISSUERCIK").try_cast("int").alias("cik"), F.trim(F.upper("ISSUERTRADINGSYMBOL")).alias("ticker"), "owner", value.alias("value"))
    return out.na.drop(subset=["filing_date", "cik", "value"])


def archive_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All columns as strings of the tab-separated file whose name ends with `name`, in any case, in each ZIP archive of path.

    An archive is opened in the task that reads it; its lines leave as they are read.
    """
    import io
    import zipfile

    import pandas as pd

    def lines(batches):
        for batch in batches:
            for raw in batch["content"]:
                archive = zipfile.ZipFile(io.BytesIO(raw))
                for n in archive.namelist():
                    if n.upper().endswith(name.upper()):
                        for part in pd.read_csv(archive.open(n), sep="\t", dtype=str, chunksize=50_000, keep_default_na=False):
                            yield pd.DataFrame({"row": part.to_dict("records")})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "row map<string,string>")
    names = [r[0] for r in rows.select(F.explode(F.map_keys("row"))).distinct().collect()]  # column names
    return rows.select(*[F.nullif(F.col("row")[n], F.lit("")).alias(n) for n in sorted(names)])
