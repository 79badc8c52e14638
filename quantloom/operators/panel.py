"""Monthly panel of companies, each value as it was known: prices, filings, splits and probes of a company are one table, dealt once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least market value; days from a share count's date to its publication; days after which filings count no more; days of purchases. Fixed values.
MIN_CAP, SHARES_LAG, STALE, PURCHASES = 2e9, 15, 450, 90
#: Trading days of the longest price window, and the least that it needs; calendar days of a history before its first month.
YEAR, LEAST, BEGIN = 252, 200, 380
#: Price rows that are looked at together (of whole companies).
BLOCK = 1 << 16

FEATURES = ("insider_buyers", "insider_share", "revenue_growth", "above_average", "momentum", "near_high", "volatility", "month_return", "gross_margin", "shares_change", "accruals")


OF_PRICES = ("momentum", "near_high", "volatility", "month_return", "above_average")


def of_prices(new: np.ndarray, at: np.ndarray, close: np.ndarray, carried: bool) -> tuple[np.ndarray, ...]:
    """Company, day, close and OF_PRICES at each company's last price of each month (NaN: none).

    new: where a company begins; at: its days, ascending; close: NaN where there is none. carried: closes hold on over days without
    one. Windows are added up from their oldest row on, in step for all months.
    """
    of = np.cumsum(new) - 1
    if carried:
        last = np.maximum.accumulate(np.where(new | ~np.isnan(close), np.arange(len(close)), 0))
        close = close[last]
        days = np.ones(len(at), np.int64)
        days[:-1][~new[1:]] = np.diff(at)[~new[1:]]
        begin = days.cumsum() - days
        of, at, close = np.repeat(of, days), np.repeat(at - begin, days) + np.arange(days.sum()), np.repeat(close, days)
        new = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
    month = at.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    i = np.flatnonzero(np.append((month[1:] != month[:-1]) | new[1:], True)) if len(at) else np.zeros(0, np.int64)
    rank = i - np.flatnonzero(new)[np.cumsum(new)[i] - 1]  # rows of the company before it
    ratio = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)
    r = np.full(len(close), np.nan)
    r[1:] = np.where(new[1:], np.nan, ratio(close[1:], close[:-1]) - 1)
    lag = lambda n: np.where(rank >= n, close[np.maximum(i - n, 0)], np.nan)
    count, high = np.zeros(len(i), np.int64), np.full(len(i), np.nan)
    n, mean, m2 = np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i))
    sums, counts = {w: np.zeros(len(i)) for w in (50, 200)}, {w: np.zeros(len(i), np.int64) for w in (50, 200)}
    for k in range(YEAR - 1, -1, -1):
        c, x = (np.where(rank >= k, v[np.maximum(i - k, 0)], np.nan) for v in (close, r))
        there = ~np.isnan(c)
        count += there
        high = np.fmax(high, c)
        for w in sums:
            if k < w:
                sums[w] += np.where(there, c, 0)
                counts[w] += there
        there = ~np.isnan(x)
        n += there
        delta = np.where(there, x - mean, 0)
        share = delta / np.maximum(n, 1)
        mean += share
        m2 += delta * (delta - share)
    above = np.where(counts[200] >= 200, sums[50] / np.maximum(counts[50], 1) > sums[200] / np.maximum(counts[200], 1), np.nan)
    spread = np.sqrt(m2 / np.maximum(n - 1, 1)) * np.sqrt(float(YEAR))
    features = ratio(lag(21), lag(YEAR)) - 1, np.where(count >= LEAST, ratio(close[i], high), np.nan), np.where(n >= LEAST, spread, np.nan), ratio(close[i], lag(21)) - 1, above
    return of[i], at[i], close[i], *features


def month_ends(prices: DataFrame, carried: bool) -> DataFrame:
    """ticker, at (day), close and OF_PRICES at each company's last price of each month: one pass over sorted prices, some companies at a time."""
    out = ("at", "close", *OF_PRICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
            close = t["close"].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
            of, at, *values = of_prices(new, t["at"].to_numpy().astype(np.int64), close, carried)
            ticker = t["ticker"].combine_chunks().take(pa.array(np.flatnonzero(new)[of]))
            return pa.RecordBatch.from_arrays([ticker, pa.array(at.astype(np.int32)), *(pa.array(v, from_pandas=True) for v in values)], ["ticker", *out])

        def begins(t: pa.Table) -> np.ndarray:
            x = t["ticker"].combine_chunks()
            a, b = x.slice(1), x.slice(0, max(len(x) - 1, 0))
            other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
            return np.append(np.ones(min(len(x), 1), bool), other)

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                t = pa.Table.from_batches(held)
                new = begins(t)
                cut = int(np.flatnonzero(new)[-1])  # the last company may go on
                if cut:
                    yield block(t.slice(0, cut), new[:cut])
                held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if rows:
            t = pa.Table.from_batches(held)
            yield block(t, begins(t))

    p = prices.select("ticker", F.unix_date(F.col("date").cast("date")).alias("at"), F.col("close").cast("double").alias("close")).where("at is not null")
    p = p.repartition("ticker").sortWithinPartitions("ticker", "at")
    schema = T.StructType([p.schema["ticker"], T.StructField("at", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in out[1:])])
    return p.mapInArrow(run, schema)


def monthly_panel(prices: DataFrame, shares: DataFrame, accounts: DataFrame, purchases: DataFrame, splits: DataFrame | None = None, min_cap: float = MIN_CAP, carried: bool = False) -> DataFrame:
    """date, ticker, the FEATURES, mcap and fwd_ret at the last trading day of each month of each company worth more than min_cap.

    prices: ticker, date, close (adjusted for splits); carried: a company's closes hold on over days without one, to its last. shares: ticker, end, val, known SHARES_LAG days after `end`, and brought to the
    price's basis by all splits after `end`. accounts: ticker, year, available, revenue, gross_profit, assets, net_income, cfo.
    purchases: ticker, filing_date, owner, value. splits: ticker, date, ratio.

    Features of prices are only computed where a month ends (`month_ends`), not day by day. Every filing and purchase is a row at
    the day on which it is known; a month end is one more, and so is the day a year before it. These rows are dealt by ticker once:
    last known values with their age, purchases of the last days and the year-old share count are windows of that one partitioning. Of two values known on a day the later row of
    `end` or `year` counts. Growth needs the year before. A month is missing where the company has no price that day, and
    fwd_ret where it has none a month later. Missing values are NULL, but without purchases there are 0.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    date = F.col("date").cast("date")
    if carried:
        spans = prices.groupBy("ticker").agg(F.min(date).alias("from"), F.max(date).alias("to"))
        months = F.explode(F.sequence(F.trunc("from", "month"), "to", F.expr("interval 1 month"))).alias("month")
        ends = spans.select("to", months).groupBy("month").agg(F.max(F.least("to", F.last_day("month"))).alias("last"))
    else:
        ends = prices.groupBy(F.trunc(date, "month").alias("month")).agg(F.max(date).alias("last"))  # one row a month
    begin = prices.agg(F.date_add(F.min(F.col("date").cast("date")), BEGIN).alias("begin"))  # one row
    none = {"close": "double", "val": "double", "end": "int", "year": "int", "revenue": "double", "gross_margin": "double", "accruals": "double", "owner": "string", "value": "double", **dict.fromkeys(OF_PRICES, "double")}

    def rows(df: DataFrame, kind: str, at: Column, **cols: Column) -> DataFrame:
        return df.select(F.col("ticker"), F.lit(kind).alias("kind"), at.cast("int").alias("at"), *[(cols.get(c, F.lit(None))).cast(t).alias(c) for c, t in none.items()])

    ratio = lambda a, b: F.try_divide(a, F.col(b))
    # the company's price on the last trading day of all
    p = month_ends(prices, carried).join(F.broadcast(ends.select(F.unix_date("last").alias("last_day"))), F.col("at") == F.col("last_day"))
    u = rows(p, "price", F.col("at"), **{c: F.col(c) for c in ("close", *OF_PRICES)})
    u = u.unionByName(rows(shares.where("val is not null and end is not null"), "shares", day("end") + SHARES_LAG, val=F.col("val"), end=day("end")))
    u = u.unionByName(rows(accounts.where("available is not null"), "accounts", day("available"), year=F.col("year"), revenue=F.col("revenue"), gross_margin=ratio(F.col("gross_profit"), "assets"), accruals=ratio(F.col("net_income") - F.col("cfo"), "assets")))
    u = u.unionByName(rows(purchases.where("filing_date is not null"), "purchase", day("filing_date"), owner=F.col("owner"), value=F.col("value")))
    if splits is not None:
        u = u.unionByName(rows(splits, "split", day("date"), value=F.col("ratio")))
    u = u.repartition("ticker")

    by_kind = W.partitionBy("ticker", "kind").orderBy(F.coalesce("year", F.lit(0)), "at")
    before = F.lag(F.struct("year", "revenue")).over(by_kind)
    u = u.withColumn("revenue_growth", F.when(before["year"] == F.col("year") - 1, F.try_divide(F.col("revenue"), before["revenue"]) - 1))
    # and a probe a year before a month end
    u = u.withColumn("probe", F.explode(F.when(F.col("kind") == "price", F.array(F.col("at"), F.col("at") - 365)).otherwise(F.array(F.lit(None).cast("int")))))
    u = u.withColumns({"month_end": F.when(F.col("probe").isNotNull(), F.col("at")), "at": F.coalesce("probe", "at"), "then": F.coalesce(F.col("probe") < F.col("at"), F.lit(False))})

    splits_of = F.collect_list(F.when(F.col("kind") == "split", F.struct(F.col("at").alias("d"), F.col("value").alias("ratio")))).over(W.partitionBy("ticker"))
    u = u.withColumn("splits", splits_of)  # a company's splits, a few
    later = F.aggregate(F.filter("splits", lambda s: s["d"] > F.col("end")), F.lit(1.0), lambda f, s: f * s["ratio"])
    u = u.withColumn("val", F.when(F.col("kind") == "shares", F.col("val") * later)).drop("splits")
    # known rows of a day come before its probes
    order = [F.col("at"), F.when(F.col("probe").isNotNull(), 1).otherwise(0), F.coalesce("end", "year", F.lit(0))]
    seen = W.partitionBy("ticker").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)

    def known(kind: str, c: str) -> Column:
        last = F.last(F.when((F.col("kind") == kind) & F.col(c).isNotNull(), F.struct(F.col(c).alias("x"), F.col("at").alias("t"))), ignorenulls=True).over(seen)
        return F.when(F.col("at") - last["t"] <= STALE, last["x"])

    recent = W.partitionBy("ticker").orderBy("at").rangeBetween(-(PURCHASES - 1), 0)
    bought = F.col("kind") == "purchase"
    u = u.withColumns({f"known_{c}": known(k, c) for k, c in (("shares", "val"), ("accounts", "revenue_growth"), ("accounts", "gross_margin"), ("accounts", "accruals"))})
    u = u.withColumns({"insider_buyers": F.size(F.collect_set(F.when(bought, F.col("owner"))).over(recent)).cast("double"), "bought": F.coalesce(F.sum(F.when(bought, F.col("value"))).over(recent), F.lit(0.0))})
    p = u.where("probe is not null").withColumn("year_ago", F.max(F.when(F.col("then"), F.col("known_val"))).over(W.partitionBy("ticker", "month_end"))).where(~F.col("then"))
    months = W.partitionBy("ticker").orderBy("at")
    following = F.lead(F.struct("at", "close")).over(months)
    month = lambda d: F.months_between(F.trunc(F.date_from_unix_date(d), "month"), F.lit("1970-01-01").cast("date"))
    p = p.withColumns({"mcap": F.col("known_val") * F.col("close"), "fwd_ret": F.when(month(following["at"]) - month(F.col("at")) == 1, F.try_divide(following["close"], F.col("close")) - 1)})
    p = p.withColumns({"insider_share": F.try_divide("bought", "mcap"), "shares_change": F.try_divide("known_val", "year_ago") - 1, **{c: F.col(f"known_{c}") for c in ("revenue_growth", "gross_margin", "accruals")}})
    p = p.join(F.broadcast(begin), F.date_from_unix_date("at") >= F.col("begin")).where(F.col("mcap") > min_cap)
    return p.select(F.date_from_unix_date("at").alias("date"), "ticker", *FEATURES, "mcap", "fwd_ret")
