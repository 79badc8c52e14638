"""Registered queries of smaller operators: chains of joins with clashing names, extremes by size, portfolio sums, closed markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import scoring as sc
from ..operators import timeseries as ts
from ..sources import frames as fr
from .catalog import SYM, _filled, query


@query("j3_j4_left_chain", "key ~balance ~value ~value_events #n #n_events", "", """SELECT c_custkey AS key, c_acctbal AS balance, o.value, coalesce(e.value, 0) AS value_events, o.n, coalesce(e.n, 0) AS n_events FROM customer
LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS value, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey LEFT JOIN (SELECT user_id, avg(value) AS value, count(*) AS n FROM events GROUP BY 1) e ON c_custkey = user_id""")
def j3(spark, d):
    """Customers with their orders and events, both of which have a value and a count; missing ones of the last table are 0."""
    t = lambda n: fr.table(spark, d, n)
    sums = lambda df, key, value: df.groupBy(F.col(key).alias("key")).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    base = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return jn.left_chain(base, {"orders": sums(t("orders"), "o_custkey", "o_totalprice"), "events": sums(t("events"), "user_id", "value")}, "key").fillna(0, ["value_events", "n_events"])


@query("t5_largest_moves", "symbol date ~change", fr.DAILY, f"SELECT symbol, date, change FROM (SELECT symbol, date, ln(close / lag(close) OVER {SYM})) AS change FROM daily) WHERE change IS NOT NULL ORDER BY round(abs(change), 9) DESC, symbol, date LIMIT 40")
def t5(spark, d):
    """The 40 largest daily moves, up or down."""
    c = fr.daily_close(spark, d).withColumn("change", ts.log_return("close", "symbol", "date")).where("change is not null")
    return c.orderBy(F.desc(fr.rounded(F.abs("change"), 9)), "symbol", "date").limit(40)


@query("t6_last_reversed", "place date symbol ~close", fr.DAILY, "SELECT CAST(row_number() OVER (ORDER BY date DESC, symbol) AS INT) AS place, date, symbol, close FROM daily ORDER BY 1 LIMIT 15")
def t6(spark, d):
    """The last 15 entries of the log, newest first."""
    from pyspark.sql import Window as W

    last = fr.daily_close(spark, d).orderBy(F.desc("date"), "symbol").limit(15)
    return last.withColumn("place", F.row_number().over(W.orderBy(F.desc("date"), "symbol")))  # 15 rows


@query("a24_sleeve_equity", "date ~equity ~best ~worst #sleeves", fr.FILLED, "SELECT date, sum(close) AS equity, max(close) AS best, min(close) AS worst, count(*) AS sleeves FROM filled GROUP BY 1")
def a24(spark, d):
    """All sleeves' equity of each day in one map, its sum, best and worst."""
    m = _filled(spark, d).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "close"))).alias("m"))  # an entry a sleeve
    v = F.map_values("m")
    return m.select("date", F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("equity"), F.array_max(v).alias("best"), F.array_min(v).alias("worst"), F.size("m").alias("sleeves"))


@query("o14_closed_market_carry", "symbol date ~w", fr.FILLED, f"SELECT symbol, date, coalesce(last_value(CASE WHEN trading AND dayofweek(date) BETWEEN 1 AND 5 THEN sqrt(close / 500000) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS w FROM filled")
def o14(spark, d):
    """Positions change on weekdays with a price only."""
    f = _filled(spark, d).withColumns({"w": F.sqrt(F.col("close") / 500000), "open": F.col("trading") & F.dayofweek("date").between(2, 6)})
    return ts.carried_while_closed(f, "symbol", "date", "w", "open")


@query("j11_signals_at_decisions", "symbol ts entry ~strength", fr.BARS, "SELECT b.symbol, b.ts, coalesce(s.entry, false) AS entry, s.strength FROM bars b LEFT JOIN (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, close > open AS entry, close / nullif(open, 0) AS strength FROM bars WHERE volume >= 3) s ON b.symbol = s.symbol AND b.ts = s.ts")
def j11(spark, d):
    """Signals of the hour before at each bar; none where that hour had less than three events."""
    b = fr.bars_1h(spark, d)
    s = b.where("volume >= 3").select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), (F.col("close") > F.col("open")).alias("entry"), F.try_divide("close", "open").alias("strength"))
    return jn.at_decisions(b.select("symbol", "ts"), s, ["symbol", "ts"], {"entry": False})


@query("x_classify_sides", "side #n", "t AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Purchase' WHEN '2-HIGH' THEN ' BUY ' WHEN '3-MEDIUM' THEN 'Sale (Partial)' WHEN '5-LOW' THEN NULL ELSE 'Exchange, ' || o_orderstatus END AS x FROM orders)", "SELECT CAST(CASE WHEN contains(lower(x), 'purchase') OR trim(lower(x)) = 'buy' THEN 1 WHEN contains(lower(x), 'sale') OR contains(lower(x), 'sell') THEN -1 ELSE 0 END AS INT) AS side, count(*) AS n FROM t GROUP BY 1")
def x_classify(spark, d):
    p = F.col("o_orderpriority")
    x = F.when(p == "1-URGENT", "Purchase").when(p == "2-HIGH", " BUY ").when(p == "3-MEDIUM", "Sale (Partial)").when(p != "5-LOW", F.concat(F.lit("Exchange, "), "o_orderstatus"))
    return fr.table(spark, d, "orders").groupBy(sc.trade_side(x).alias("side")).agg(F.count("*").alias("n"))
