"""Registered queries of the company screener: growth, hard filter, points, patterns, insiders, final scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import crosssec as cs
from ..operators import scoring as sc
from ..operators import timeseries as ts
from ..sources import frames as fr
from .catalog import HOURS, RANKS, _filled, query

#: One row a supplier: five years of revenue and earnings, grown at a rate of its own, and ratios made from its number.
COMPANY = """ys AS (
  SELECT l_suppkey AS ticker, year(l_shipdate) AS year, round(sum(l_extendedprice * (1 - l_discount)) * pow(1 + (l_suppkey % 5) * 0.05, year(l_shipdate) - 1995), 2) AS revenue,
         round(sum(l_quantity) * pow(1 + (l_suppkey % 7) * 0.04, year(l_shipdate) - 1995), 4) AS eps
  FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 2000 GROUP BY 1, 2),
seq AS (SELECT *, lag(revenue) OVER w AS before_r, lag(eps) OVER w AS before_e FROM ys WINDOW w AS (PARTITION BY ticker ORDER BY year)),
grown AS (
  SELECT ticker, CASE WHEN count(*) >= 4 AND arg_min(revenue, year) > 0 AND arg_max(revenue, year) > 0 THEN pow(arg_max(revenue, year) / arg_min(revenue, year), 1.0 / (count(*) - 1)) - 1 END AS revenue_cagr,
         CASE WHEN count(*) >= 4 AND arg_min(eps, year) > 0 AND arg_max(eps, year) > 0 THEN pow(arg_max(eps, year) / arg_min(eps, year), 1.0 / (count(*) - 1)) - 1 END AS eps_cagr,
         count(*) FILTER (revenue < before_r) AS revenue_falls, count(*) FILTER (eps < before_e) AS eps_falls FROM seq GROUP BY 1),
base AS (
  SELECT s_suppkey AS ticker, n_name AS sector, round((s_acctbal + 999) / 3000, 4) - 0.2 AS peg, 5.0 + s_suppkey % 37 AS pe, (s_suppkey % 29) / 60.0 AS profit_margin, (s_suppkey % 23) / 60.0 AS roe,
         (s_suppkey % 19) / 100.0 AS roa, 1e9 * (s_suppkey % 31) AS mktcap, 1e9 * (s_suppkey % 31) + 1e8 * (s_suppkey % 11) AS ev, CASE WHEN s_suppkey % 17 > 0 THEN 3e8 END AS ebitda, 0.5 + (s_suppkey % 13) / 10.0 AS current_ratio,
         revenue_cagr, eps_cagr, revenue_falls, eps_falls
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN grown ON ticker = s_suppkey),
med AS (SELECT sector, quantile_cont(pe, 0.5) AS m FROM base GROUP BY 1),
valued AS (SELECT base.*, (peg > 0 AND peg <= 2) OR (m <> 0 AND pe <= 1.5 * m) AS valued FROM base JOIN med USING (sector)),
checked AS (
  SELECT *, coalesce(revenue_cagr >= 0.08 AND coalesce(revenue_falls, 0) <= 1, false)::INT + coalesce(eps_cagr >= 0.10 AND coalesce(eps_falls, 0) <= 1, false)::INT + (profit_margin >= 0.10)::INT + (roe >= 0.15)::INT + (roa >= 0.07)::INT
            + coalesce((ev - mktcap) / ebitda <= 3, false)::INT + (current_ratio >= 1)::INT + valued::INT AS checks,
         least(10, coalesce(revenue_cagr >= 0.08, false)::INT * 2 + coalesce(eps_cagr >= 0.10, false)::INT * 2 + (roe >= 0.15)::INT * 2 + (roa >= 0.07)::INT + (profit_margin >= 0.10)::INT + valued::INT * 2) AS points
  FROM valued)"""


def _company(spark, d) -> DataFrame:
    t = lambda n: fr.table(spark, d, n)
    year, key = F.year("l_shipdate"), F.col("l_suppkey")
    y = t("lineitem").where(year.between(1996, 2000)).groupBy(key.alias("ticker"), year.alias("year")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.sum("l_quantity").alias("q"))
    grow = lambda n, rate: F.pow(1 + (F.col("ticker") % n) * rate, F.col("year") - 1995)
    y = y.select("ticker", F.struct("year", fr.rounded(F.col("r") * grow(5, 0.05), 2).alias("revenue"), fr.rounded(F.col("q") * grow(7, 0.04), 4).alias("eps")).alias("x"))
    y = y.groupBy("ticker").agg(F.sort_array(F.collect_list("x")).alias("x"))  # five years
    revenue, eps = sc.cagr(F.col("x.revenue")), sc.cagr(F.col("x.eps"))
    y = y.select("ticker", revenue[0].alias("revenue_cagr"), revenue[1].alias("revenue_falls"), eps[0].alias("eps_cagr"), eps[1].alias("eps_falls"))
    k = F.col("s_suppkey")
    base = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("ticker"), F.col("n_name").alias("sector"), (fr.rounded((F.col("s_acctbal") + 999) / 3000, 4) - 0.2).alias("peg"), (k % 37 + 5.0).alias("pe"), (k % 29 / 60.0).alias("profit_margin"), (k % 23 / 60.0).alias("roe"),
        (k % 19 / 100.0).alias("roa"), (k % 31 * 1e9).alias("mktcap"), (k % 31 * 1e9 + k % 11 * 1e8).alias("ev"), F.when(k % 17 > 0, 3e8).alias("ebitda"), (k % 13 / 10.0 + 0.5).alias("current_ratio"),
    )
    return sc.hard_filter(sc.pe_rule(base.join(y, "ticker", "left"), "sector", "peg", "pe"))


@query("f4_hard_filter", "ticker ~revenue_cagr ~eps_cagr #checks fundamental_pass", COMPANY, "SELECT ticker, revenue_cagr, eps_cagr, checks, checks = 8 AS fundamental_pass FROM checked")
def f4(spark, d):
    return _company(spark, d)


@query("p1_fundamental_points", "ticker ~points", COMPANY, "SELECT ticker, points FROM checked")
def p1(spark, d):
    c = _company(spark, d)
    return c.withColumn("points", sc.fundamental_points(c))


SIGNALS = COMPANY + """, sig AS (SELECT *, checks >= 6 AS fundamental_pass, ticker % 3 = 0 AS pattern_daily, ticker % 4 = 0 AS pattern_weekly, CASE WHEN ticker % 6 > 0 THEN (ticker % 41) / 80.0 END AS retracement,
  CASE WHEN ticker % 8 > 0 THEN ticker % 2 = 0 END AS insider_net_positive, ticker % 5 = 0 AS institutional_trend FROM checked),
final AS (SELECT *, CASE WHEN fundamental_pass AND (pattern_daily OR pattern_weekly) THEN round_even(least(10, 5 + coalesce(greatest(0, 1 - abs(retracement - 0.40) / 0.10), 0) + coalesce(revenue_cagr >= 0.16, false)::INT * 0.5
  + coalesce(eps_cagr >= 0.20, false)::INT * 0.5 + coalesce(insider_net_positive, false)::INT + institutional_trend::INT)::DOUBLE, 1) ELSE 0 END AS final_score FROM sig)"""


def _signals(spark, d) -> DataFrame:
    k = F.col("ticker")
    c = _company(spark, d).withColumns({"fundamental_pass": F.col("checks") >= 6, "pattern_daily": k % 3 == 0, "pattern_weekly": k % 4 == 0, "retracement": F.when(k % 6 > 0, k % 41 / 80.0), "insider_net_positive": F.when(k % 8 > 0, k % 2 == 0), "institutional_trend": k % 5 == 0})
    return c.withColumns({"final_score": sc.final_score(c), "points": sc.fundamental_points(c)})


@query("p5_final_score", "ticker ~final_score cap", SIGNALS, "SELECT ticker, final_score, CASE WHEN mktcap > 10e9 THEN 'large' ELSE 'mid' END AS cap FROM final")
def p5(spark, d):
    """Six of the eight rules are asked for, so that some companies pass at every size."""
    return _signals(spark, d).withColumn("cap", sc.cap_bucket(F.col("mktcap")))


@query("f6_candidates", "ticker ~final_score ~points", SIGNALS + ", c AS (SELECT * FROM final WHERE fundamental_pass AND (pattern_daily OR pattern_weekly)), t AS (SELECT * FROM final WHERE fundamental_pass ORDER BY points DESC, ticker LIMIT 10)", "SELECT ticker, final_score, points FROM c UNION ALL SELECT ticker, final_score, points FROM t WHERE NOT EXISTS (FROM c)")
def f6(spark, d):
    """Companies with filter and pattern; where there are none, the ten with the most points among those that pass the filter."""
    return _candidates(_signals(spark, d))


@query("f6_fallback", "ticker ~final_score ~points", SIGNALS, "SELECT ticker, 0 AS final_score, points FROM final WHERE fundamental_pass ORDER BY points DESC, ticker LIMIT 10")
def f6_fallback(spark, d):
    """The same without any pattern."""
    s = _signals(spark, d).withColumns({"pattern_daily": F.lit(False), "pattern_weekly": F.lit(False)})
    return _candidates(s.withColumn("final_score", sc.final_score(s)))


def _candidates(s: DataFrame) -> DataFrame:
    passed = s.where("fundamental_pass")
    both = passed.where("pattern_daily OR pattern_weekly")
    return both.unionByName(sc.top_k(passed, 10, "points", "ticker").join(F.broadcast(both.select(F.lit(1).alias("_any")).limit(1)), F.lit(True), "left_anti"))


@query("p4_short_points", "ticker ~share ~ratio ~points", "", "SELECT p_partkey AS ticker, p_size / 2.0 AS share, p_retailprice / 300 AS ratio, (p_size / 2.0 >= 10)::INT * 2 + (p_size / 2.0 >= 20)::INT + (p_retailprice / 300 >= 5)::INT * 2 AS points FROM part")
def p4(spark, d):
    p = fr.table(spark, d, "part").select(F.col("p_partkey").alias("ticker"), (F.col("p_size") / 2).alias("share"), (F.col("p_retailprice") / 300).alias("ratio"))
    return p.withColumn("points", sc.short_points(F.col("share"), F.col("ratio")))


FORM4 = """f AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE 'S' END AS code, o_orderpriority AS owner, CASE WHEN o_orderkey % 4 = 0 THEN 'Chief ' || o_orderpriority ELSE 'Clerk' END AS title,
  o_totalprice AS amount, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END AS signed FROM orders),
t AS (SELECT ticker, count(*) FILTER (code = 'P') AS buys, coalesce(sum(amount) FILTER (code = 'P'), 0) AS amount, coalesce(bool_or(code = 'P' AND regexp_matches(lower(title), 'ceo|cfo|president|chief|chairman|director')), false) AS senior_buy,
  count(DISTINCT owner) FILTER (code = 'P' AND day >= DATE '2001-08-01' - 365) >= 2 AS cluster_buy, coalesce(sum(signed) FILTER (day >= DATE '2001-08-01' - 720), 0) AS net FROM f GROUP BY 1)"""


@query("p3_insider_points", "ticker #buys ~amount senior_buy cluster_buy ~net ~score", FORM4, "SELECT *, least(10, (buys >= 1)::INT + (buys >= 3)::INT + (amount >= 100000)::INT + (amount >= 500000)::INT + senior_buy::INT * 2 + cluster_buy::INT * 3) AS score FROM t")
def p3(spark, d):
    p = F.col("o_orderstatus") == "O"
    f = fr.table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("day"), F.when(p, "P").otherwise("S").alias("code"), F.col("o_orderpriority").alias("owner"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Chief "), "o_orderpriority")).otherwise("Clerk").alias("title"), F.col("o_totalprice").alias("amount"), F.when(p, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("signed"))
    return sc.insider_signals(f, "ticker", F.lit("2001-08-01").cast("date"), 365, 720)


MAST = fr.DAILY + """, c AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM daily),
p AS (SELECT *, max(close) OVER (PARTITION BY symbol) AS peak FROM c), q AS (SELECT *, min(k) FILTER (close = peak) OVER (PARTITION BY symbol) AS peak_at FROM p),
r AS (SELECT *, min(k) FILTER (k >= peak_at AND (peak - close) / peak >= 0.3) OVER (PARTITION BY symbol) AS flag FROM q WHERE n >= 83 AND peak_at >= 5),
s AS (SELECT symbol, any_value(peak) AS peak, any_value(n) AS n, any_value(peak_at) AS peak_at, any_value(flag) AS flag, min(close) FILTER (k < peak_at) AS low, max(close) FILTER (k = n - 1) AS final,
  max(close) FILTER (k >= greatest(flag, n - 63)) AS hi, min(close) FILTER (k >= greatest(flag, n - 63)) AS lo FROM r GROUP BY 1)"""


@query("q_mast_flag", "symbol ~mast_rally ~retracement #consolidation pattern", MAST, "SELECT symbol, round_even(peak / low - 1, 3) AS mast_rally, CASE WHEN l THEN round_even((peak - final) / peak, 3) END AS retracement, CASE WHEN l THEN n - 1 - flag END AS consolidation, coalesce(l AND (peak - final) / peak BETWEEN 0.3 AND 0.5 AND n - 1 - flag BETWEEN 63 AND 2126 AND (hi - lo) / lo <= 20, false) AS pattern FROM (SELECT *, peak / low - 1 >= 1 AND n - peak_at >= 63 AS l FROM s)")
def q_mast(spark, d):
    """Daily closes; flags of any length and range down to 63 days, as these closes are wild."""
    return sc.mast_and_flag(fr.daily_close(spark, d), "symbol", "date", "close", 63, 2126, tight=20.0)


@query("f2_sector_gate", "symbol ~half ~whole passes", fr.DAILY + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM daily), x AS (SELECT symbol, max(close) FILTER (r = 1) / max(close) FILTER (r = 126) - 1 AS half, max(close) FILTER (r = 1) / arg_min(close, date) - 1 AS whole FROM n GROUP BY 1 HAVING count(*) >= 130)", "SELECT a.symbol, a.half, a.whole, coalesce(a.half > 0 AND a.whole > 0 AND (a.half > m.half OR a.whole > m.whole), false) AS passes FROM x a LEFT JOIN x m ON m.symbol = '3-MEDIUM' WHERE a.symbol <> '3-MEDIUM'")
def f2(spark, d):
    """Sectors that have risen over both spans and more than the market over one of them."""
    n = fr.daily_close(spark, d).withColumn("r", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))))
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("close")))
    x = n.groupBy("symbol").agg((at(1) / at(126) - 1).alias("half"), (at(1) / F.min_by("close", "date") - 1).alias("whole"), F.count("*").alias("n")).where("n >= 130")
    m = x.where("symbol = '3-MEDIUM'").select(F.col("half").alias("mh"), F.col("whole").alias("mw"))  # one row
    ok = (F.col("half") > 0) & (F.col("whole") > 0) & ((F.col("half") > F.col("mh")) | (F.col("whole") > F.col("mw")))
    return x.where("symbol <> '3-MEDIUM'").join(F.broadcast(m), F.lit(True), "left").withColumn("passes", sc.holds(ok))


@query("m11_ic_table", "signal ~ic #n #place", RANKS + ", s AS (SELECT 'revenue' AS signal, date, ticker, revenue AS x, fwd_ret AS y FROM panel UNION ALL SELECT 'discount', date, ticker, discount, fwd_ret FROM panel UNION ALL SELECT 'quantity', date, ticker, quantity, fwd_ret FROM panel), u AS (SELECT * FROM s WHERE x IS NOT NULL AND y IS NOT NULL AND date = DATE '1998-06-30'), k AS (SELECT signal, rank() OVER (PARTITION BY signal ORDER BY x) + (count(*) OVER (PARTITION BY signal, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY signal ORDER BY y) + (count(*) OVER (PARTITION BY signal, y) - 1) / 2.0 AS ry FROM u)", "SELECT signal, round_even(corr(rx, ry), 4) AS ic, count(*) AS n, row_number() OVER (ORDER BY round_even(corr(rx, ry), 4) DESC, signal) AS place FROM k GROUP BY 1 HAVING count(*) >= 10")
def m11(spark, d):
    """Rank correlation of every signal with the next month's return on one date, signals unpivoted so that one job serves all."""
    p = fr.panel(spark, d).where("date = DATE '1998-06-30'").withColumn("quantity", F.col("quantity").cast("double"))
    long = p.unpivot(["date", "ticker", "fwd_ret"], ["revenue", "discount", "quantity"], "signal", "x")
    ic = cs.ic_masked(long, "signal", "x", "fwd_ret", 10).withColumn("ic", F.bround("ic", 4))
    return ic.withColumn("place", F.row_number().over(W.orderBy(F.desc("ic"), "signal")))  # a row a signal


_H = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"


def _over(agg: str, n: int, lag: int = 0) -> str:
    w = _H.format(n - 1 + lag, lag)
    return f"CASE WHEN count({agg[agg.index('(') + 1 : -1]}) OVER {w} = {n} THEN {agg} OVER {w} END"


SNAP = HOURS + ", g AS (SELECT *, ln(nullif(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0), 0)) AS lr FROM filled_hours)," + f""" z AS (
  SELECT symbol, ts + INTERVAL 1 HOUR AS ts, close, lr AS ret_1h, ln(nullif(close / nullif(lag(close, 4) OVER s, 0), 0)) AS ret_4h, ln(nullif(close / nullif(lag(close, 24) OVER s, 0), 0)) AS ret_24h,
         {_over("stddev_samp(lr)", 24)} * sqrt(8760.0) AS vol_24h, {_over("stddev_samp(lr)", 168)} * sqrt(8760.0) AS vol_7d, close / nullif(lag(close, 480) OVER s, 0) - 1 AS trend_20d,
         {_over("sum(taker)", 24)} / nullif({_over("sum(volume)", 24)}, 0) AS taker_buy_24h, lag(close, 12) OVER s / nullif({_over("min(low)", 48, 12)}, 0) - 1 AS mast_gain_48h,
         {_over("max(high)", 12)} AS fh, {_over("min(low)", 12)} AS fl, {_over("min(low)", 48, 12)} AS ml, {_over("max(high)", 60)} AS peak, close / nullif({_over("max(high)", 12, 1)}, 0) - 1 AS breakout_dist
  FROM g WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""


@query("q_snap_all", "symbol ts ~close ~ret_1h ~ret_4h ~ret_24h ~vol_24h ~vol_7d ~trend_20d ~taker_buy_24h ~mast_gain_48h ~flag_range_12h ~flag_retrace ~breakout_dist", SNAP, "SELECT *, (fh - fl) / nullif(fl, 0) AS flag_range_12h, CASE WHEN peak - ml IS NOT NULL THEN greatest((peak - fl) / nullif(peak - ml, 0), 0) END AS flag_retrace FROM z")
def q_snap(spark, d):
    """Every feature of an hourly snapshot at the bar's end (two longer trends need more days than the events have): one sort per symbol."""
    k = ("symbol", "ts")
    b = ts.fill_hours(fr.bars_1h(spark, d)).withColumn("lr", ts.log_return("close", *k))
    r = lambda agg, c, n, lag=0: ts.rolling(agg, c, *k, n, lag=lag)
    year = F.sqrt(F.lit(8760.0))
    b = b.withColumns({
        "ret_1h": F.col("lr"), "ret_4h": ts.log_return("close", *k, 4), "ret_24h": ts.log_return("close", *k, 24),
        "vol_24h": r(F.stddev_samp, "lr", 24) * year, "vol_7d": r(F.stddev_samp, "lr", 168) * year, "trend_20d": ts.pct_change("close", *k, 480),
        "taker_buy_24h": F.try_divide(r(F.sum, "taker", 24), r(F.sum, "volume", 24)), "mast_gain_48h": F.try_divide(F.lag("close", 12).over(ts.by(*k)), r(F.min, "low", 48, 12)) - 1,
        "fh": r(F.max, "high", 12), "fl": r(F.min, "low", 12), "ml": r(F.min, "low", 48, 12), "peak": r(F.max, "high", 60), "breakout_dist": F.try_divide(F.col("close"), r(F.max, "high", 12, 1)) - 1,
    })
    retrace = F.greatest(F.try_divide(F.col("peak") - F.col("fl"), F.col("peak") - F.col("ml")), F.lit(0.0))
    return b.withColumns({"flag_range_12h": F.try_divide(F.col("fh") - F.col("fl"), F.col("fl")), "flag_retrace": F.when((F.col("peak") - F.col("ml")).isNull(), None).otherwise(retrace), "ts": F.col("ts") + F.expr("INTERVAL 1 HOUR")})
