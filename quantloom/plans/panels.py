"""Registered queries of the monthly panel of companies and of the factor model on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import panel as pn
from ..sources import frames as fr
from .catalog import query

#: Suppliers as companies: line prices are closes (carried over days without one), other columns make up filings.
SOURCES = """li AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS day, * FROM lineitem),
px AS (SELECT ticker, day, round(avg(l_extendedprice / l_quantity), 6) AS close FROM li GROUP BY 1, 2),
prices AS (SELECT g.ticker, g.date, last_value(close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS close
  FROM (SELECT ticker, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS date FROM px GROUP BY 1) g LEFT JOIN px ON px.ticker = g.ticker AND px.day = g.date),
shares AS (SELECT ticker, day AS "end", round(avg(l_quantity) * 1e5 * (1 + ticker % 40), 2) AS val FROM li WHERE l_linenumber = 1 AND l_orderkey % 4 = 0 GROUP BY 1, 2),
splits AS (SELECT ticker, day AS date, CASE WHEN min(l_orderkey) % 2 = 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS ratio FROM li WHERE l_quantity >= 49 AND l_linenumber = 2 AND l_orderkey % 5 = 0 GROUP BY 1, 2),
accounts AS (SELECT ticker, year(day) AS year, max(day) + 90 AS available, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice * l_discount), 4) AS gross_profit, round(sum(l_quantity) * 100, 2) AS assets, round(sum(l_extendedprice * l_tax), 4) AS net_income,
  round(sum(l_extendedprice) / 30, 4) AS cfo FROM li WHERE (ticker + year(day)) % 5 > 0 GROUP BY 1, 2),
purchases AS (SELECT ticker, day AS filing_date, CAST(l_partkey % 7 AS VARCHAR) AS owner, l_extendedprice AS value FROM li WHERE l_returnflag = 'R' AND l_linenumber = 1)"""


def sources(spark, d) -> tuple[DataFrame, ...]:
    """prices (days without one are left to monthly_panel), shares, accounts, purchases, splits."""
    li = fr.table(spark, d, "lineitem").withColumns({"ticker": F.col("l_suppkey"), "day": F.to_date("l_shipdate")})
    px = li.groupBy("ticker", "day").agg(fr.rounded(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("close"))
    prices = px.withColumnRenamed("day", "date")
    shares = li.where("l_linenumber = 1 AND l_orderkey % 4 = 0").groupBy("ticker", F.col("day").alias("end")).agg(F.avg("l_quantity").alias("q")).select("ticker", "end", fr.rounded(F.col("q") * 1e5 * (1 + F.col("ticker") % 40), 2).alias("val"))
    splits = li.where("l_quantity >= 49 AND l_linenumber = 2 AND l_orderkey % 5 = 0").groupBy("ticker", F.col("day").alias("date")).agg(F.when(F.min("l_orderkey") % 2 == 0, 2.0).otherwise(0.5).alias("ratio"))
    price, total = F.col("l_extendedprice"), lambda c, n: fr.rounded(F.sum(c), n)
    accounts = li.where((F.col("ticker") + F.year("day")) % 5 > 0).groupBy("ticker", F.year("day").alias("year")).agg(
        F.date_add(F.max("day"), 90).alias("available"), total(price, 2).alias("revenue"), total(price * F.col("l_discount"), 4).alias("gross_profit"), fr.rounded(F.sum("l_quantity") * 100, 2).alias("assets"), total(price * F.col("l_tax"), 4).alias("net_income"), fr.rounded(F.sum(price) / 30, 4).alias("cfo")
    )
    purchases = li.where("l_returnflag = 'R' AND l_linenumber = 1").select("ticker", F.col("day").alias("filing_date"), (F.col("l_partkey") % 7).cast("string").alias("owner"), price.alias("value"))
    return prices, shares, accounts, purchases, splits


_P = lambda n: f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
PANEL = SOURCES + f""", pr AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM prices),
w AS (SELECT ticker, date, close, lag(close, 21) OVER o / lag(close, 252) OVER o - 1 AS momentum, CASE WHEN count(close) OVER {_P(252)} >= 200 THEN close / max(close) OVER {_P(252)} END AS near_high,
  CASE WHEN count(r) OVER {_P(252)} >= 200 THEN stddev_samp(r) OVER {_P(252)} * sqrt(252.0) END AS volatility, close / lag(close, 21) OVER o - 1 AS month_return,
  CASE WHEN count(close) OVER {_P(200)} >= 200 THEN (avg(close) OVER {_P(50)} > avg(close) OVER {_P(200)})::INT END AS above_average FROM pr WINDOW o AS (PARTITION BY ticker ORDER BY date)),
ends AS (SELECT date_trunc('month', date) AS month, max(date) AS date FROM prices GROUP BY 1),
m AS (SELECT w.*, CASE WHEN date_diff('month', date, lead(date) OVER o) = 1 THEN lead(close) OVER o / close - 1 END AS fwd_ret FROM w WHERE date IN (SELECT date FROM ends) WINDOW o AS (PARTITION BY ticker ORDER BY date)),
sh AS (SELECT s.ticker, s."end" + 15 AS avail, s.val * coalesce(product(x.ratio), 1) AS val FROM shares s LEFT JOIN splits x ON s.ticker = x.ticker AND x.date > s."end" GROUP BY s.ticker, s."end", s.val),
ac AS (SELECT ticker, available, CASE WHEN lag(year) OVER o = year - 1 THEN revenue / lag(revenue) OVER o - 1 END AS revenue_growth, gross_profit / nullif(assets, 0) AS gross_margin, (net_income - cfo) / nullif(assets, 0) AS accruals FROM accounts WINDOW o AS (PARTITION BY ticker ORDER BY year)),
a AS (SELECT m.*, CASE WHEN m.date - s.avail <= 450 THEN s.val END AS now FROM m ASOF LEFT JOIN sh s ON m.ticker = s.ticker AND m.date >= s.avail),
b AS (SELECT a.*, CASE WHEN a.date - 365 - s.avail <= 450 THEN s.val END AS ago FROM a ASOF LEFT JOIN sh s ON a.ticker = s.ticker AND a.date - 365 >= s.avail),
g AS (SELECT b.*, CASE WHEN b.date - x.available <= 450 THEN x.revenue_growth END AS revenue_growth FROM b ASOF LEFT JOIN (FROM ac WHERE revenue_growth IS NOT NULL) x ON b.ticker = x.ticker AND b.date >= x.available),
h AS (SELECT g.*, CASE WHEN g.date - x.available <= 450 THEN x.gross_margin END AS gross_margin, CASE WHEN g.date - x.available <= 450 THEN x.accruals END AS accruals FROM g ASOF LEFT JOIN ac x ON g.ticker = x.ticker AND g.date >= x.available),
i AS (SELECT h.ticker, h.date, count(DISTINCT owner) AS n, sum(value) AS v FROM h JOIN purchases p ON h.ticker = p.ticker AND p.filing_date <= h.date AND p.filing_date > h.date - 90 GROUP BY 1, 2),
panel14 AS (SELECT h.date, h.ticker, coalesce(n, 0) AS insider_buyers, coalesce(v, 0) / (now * close) AS insider_share, revenue_growth, above_average, momentum, near_high, volatility, month_return, gross_margin, now / ago - 1 AS shares_change, accruals, now * close AS mcap, fwd_ret
  FROM h LEFT JOIN i USING (ticker, date) WHERE now * close > 2e9 AND h.date >= (SELECT min(date) FROM prices) + 380)"""


@query("q_panel", "date ticker ~insider_buyers ~insider_share ~revenue_growth ~above_average ~momentum ~near_high ~volatility ~month_return ~gross_margin ~shares_change ~accruals ~log_cap ~fwd_ret", PANEL, "SELECT *, ln(mcap) AS log_cap FROM panel14")
def q_panel(spark, d):
    """The panel of companies worth more than two billion: eleven features, market value and the next month's return."""
    return pn.monthly_panel(*sources(spark, d), carried=True).withColumn("log_cap", F.ln("mcap"))
