"""Canonical long frames over the warehouse tables, and the same frames as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded as SQL engines do it: scaled, to the next whole number, halves away from zero, and scaled back.

    F.round goes by the decimal digits that a double prints, so ties come out otherwise (1029.9159375 to six digits).
    """
    scaled = (F.col(value) if isinstance(value, str) else value) * 10.0**digits
    return F.round(scaled) / 10.0**digits


def daily_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, close: the mean order value of each priority and day."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (bar open), open, high, low, close, volume, taker: hourly bars of event values."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    first = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("symbol"), F.col("hour").alias("ts")).agg(
        F.min_by("value", first).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", first).alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.count_if(F.col("user_id") % 2 == 0).cast("double").alias("taker"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, avail, ord: dated facts, several a day possible, the later ord wins."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.to_date("o_orderdate").alias("avail"), F.col("o_orderkey").alias("ord"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (month end), ticker, revenue, discount, quantity, fwd_ret: one row a supplier and month."""
    from pyspark.sql import Window as W

    m = table(spark, sf_dir, "lineitem").groupBy(F.last_day("l_shipdate").alias("date"), F.col("l_suppkey").alias("ticker")).agg(
        rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), rounded(F.avg("l_discount"), 8).alias("discount"), F.sum("l_quantity").alias("quantity")
    )
    w = W.partitionBy("ticker").orderBy("date")
    return m.withColumn("fwd_ret", rounded(F.try_divide(F.lead("revenue").over(w), F.col("revenue")) - 1, 8))


DAILY = """daily AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)"""

BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume, (count(*) FILTER (user_id % 2 = 0))::DOUBLE AS taker
  FROM events GROUP BY 1, 2)"""

FACTS = """facts AS (SELECT o_custkey AS key, o_totalprice AS value, CAST(o_orderdate AS DATE) AS avail, o_orderkey AS ord FROM orders)"""

PANEL = """panel AS (
  SELECT *, round(lead(revenue) OVER (PARTITION BY ticker ORDER BY date) / nullif(revenue, 0) - 1, 8) AS fwd_ret
  FROM (SELECT last_day(l_shipdate) AS date, l_suppkey AS ticker, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
               round(avg(l_discount), 8) AS discount, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2))"""

#: daily on every calendar day of its symbol, closes carried forward, trading false on the filled days.
FILLED = DAILY + """, filled AS (
  SELECT g.symbol, g.date, d.close IS NOT NULL AS trading,
         last_value(d.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS close
  FROM (SELECT symbol, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY symbol) g
  LEFT JOIN daily d USING (symbol, date))"""
