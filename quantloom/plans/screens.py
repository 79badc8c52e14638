"""Registered queries of the screening and research pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import crosssec as cs
from ..operators import joins as jn
from ..operators import scoring as sc
from ..operators import timeseries as ts
from ..sources import frames as fr
from .catalog import _G, RANKS, RETS, SYM, _filled, _rets, _W, query


@query("f1_above_rising_average", "symbol ~close passes", fr.FILLED + f", s AS (SELECT symbol, date, close, {_G('avg', 200, 200)} AS sma FROM filled), l AS (SELECT *, lag(sma, 126) OVER {SYM}) AS before, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM s)", "SELECT symbol, close, coalesce(close > sma AND sma > before, false) AS passes FROM l WHERE r = 1")
def f1(spark, d):
    """Last close above its 200-day mean, which is above its value 126 days before; too short a history fails."""
    f = _filled(spark, d).withColumn("sma", ts.rolling(F.avg, "close", "symbol", "date", 200))
    f = f.withColumn("before", F.lag("sma", 126).over(ts.by("symbol", "date")))
    last = f.groupBy("symbol").agg(F.max_by(F.struct("close", "sma", "before"), "date").alias("x")).select("symbol", "x.*")
    return last.withColumn("passes", sc.holds((F.col("close") > F.col("sma")) & (F.col("sma") > F.col("before"))))


@query("f3_period_returns", "symbol ~half ~whole", fr.DAILY + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM daily)", "SELECT symbol, max(close) FILTER (r = 1) / max(close) FILTER (r = 126) - 1 AS half, max(close) FILTER (r = 1) / arg_min(close, date) - 1 AS whole FROM n GROUP BY symbol HAVING count(*) >= 130")
def f3(spark, d):
    """Return since the 126th row from the end and since the first, for histories of 130 rows or more."""
    n = fr.daily_close(spark, d).withColumn("r", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))))
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("close")))
    return n.groupBy("symbol").agg((at(1) / at(126) - 1).alias("half"), (at(1) / F.min_by("close", "date") - 1).alias("whole"), F.count("*").alias("n")).where("n >= 130")


@query("f12_extremes", "symbol #extremes #rows", RETS, "SELECT symbol, count(*) FILTER (ret > 0.0005 OR ret < -0.0003) AS extremes, count(ret) AS rows FROM rets GROUP BY 1")
def f12(spark, d):
    return _rets(spark, d).groupBy("symbol").agg(F.count_if((F.col("ret") > 0.0005) | (F.col("ret") < -0.0003)).alias("extremes"), F.count("ret").alias("rows"))


@query("a4_buys_and_sells", "c_custkey #buys #sells #net recent", "", "SELECT c_custkey, count(*) FILTER (o_orderstatus = 'O') AS buys, count(*) FILTER (o_orderstatus = 'F') AS sells, count(*) FILTER (o_orderstatus = 'O') - count(*) FILTER (o_orderstatus = 'F') AS net, coalesce(bool_or(o_orderdate >= TIMESTAMP '2000-01-01'), false) AS recent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a4(spark, d):
    j = fr.table(spark, d, "customer").select("c_custkey").join(fr.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    buys, sells = F.count_if(F.col("o_orderstatus") == "O"), F.count_if(F.col("o_orderstatus") == "F")
    return j.groupBy("c_custkey").agg(buys.alias("buys"), sells.alias("sells"), (buys - sells).alias("net"), F.coalesce(F.bool_or(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")), F.lit(False)).alias("recent"))


@query("a7_yearly_worst_drawdown", "symbol #year ~worst", RETS + ", e AS (SELECT symbol, date, product(1 + ret) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM rets WHERE ret IS NOT NULL), dd AS (SELECT symbol, date, eq / max(eq) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)", "SELECT symbol, year(date) AS year, min(dd) AS worst FROM dd GROUP BY 1, 2")
def a7(spark, d):
    return ts.drawdown(_rets(spark, d).where("ret is not null"), "ret", "symbol", "date").groupBy("symbol", F.year("date").alias("year")).agg(F.min("drawdown").alias("worst"))


@query("a13_a14_sign_agreement", "same", RANKS + ", y AS (SELECT year(date) AS year, avg(ic) AS ic FROM ic WHERE n >= 20 GROUP BY 1)", "SELECT count(*) FILTER (sign(ic) = sign((SELECT avg(ic) FROM ic WHERE n >= 20)))::VARCHAR || '/' || count(*)::VARCHAR AS same FROM y")
def a13(spark, d):
    """In how many years the mean rank correlation has the sign of the whole."""
    ic = cs.ic_masked(fr.panel(spark, d), "date", "revenue", "fwd_ret")
    y = ic.groupBy(F.year("date").alias("year")).agg(F.avg("ic").alias("ic"), F.sum("ic").alias("s"), F.count("ic").alias("n"))
    y = y.withColumn("all", F.sum("s").over(W.partitionBy()) / F.sum("n").over(W.partitionBy()))  # one row a year
    return y.agg(F.concat_ws("/", F.count_if(F.signum("ic") == F.signum("all")).cast("string"), F.count("*").cast("string")).alias("same"))


@query("a21_pearson", "lang ~corr", "", "SELECT lang, CASE WHEN var_pop(n_chars) > 0 AND var_pop(quality) > 0 THEN corr(n_chars, quality) END AS corr FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a21(spark, d):
    return fr.table(spark, d, "documents").join(fr.table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.try_divide(F.covar_pop("n_chars", "quality"), F.stddev_pop("n_chars") * F.stddev_pop("quality")).alias("corr"))


@query("w3_contiguous_lag", "key #year ~growth", "y AS (SELECT o_custkey AS key, year(o_orderdate) AS year, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)", "SELECT key, year, CASE WHEN lag(year) OVER w = year - 1 THEN v / lag(v) OVER w - 1 END AS growth FROM y WINDOW w AS (PARTITION BY key ORDER BY year)")
def w3(spark, d):
    """Growth against the year before, NULL where that year is missing."""
    y = fr.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    w = W.partitionBy("key").orderBy("year")
    return y.withColumn("growth", F.when(F.lag("year").over(w) == F.col("year") - 1, F.col("v") / F.lag("v").over(w) - 1))


@query("w8_ratio_of_sums", "symbol date ~ratio", fr.FILLED, f"SELECT symbol, date, CASE WHEN count(close) OVER {_W(7)} = 7 THEN sum(CASE WHEN trading THEN close ELSE 0 END) OVER {_W(7)} / sum(close) OVER {_W(7)} END AS ratio FROM filled")
def w8(spark, d):
    f = _filled(spark, d).withColumn("traded", F.when(F.col("trading"), F.col("close")).otherwise(0.0))
    return f.select("symbol", "date", F.try_divide(ts.rolling(F.sum, "traded", "symbol", "date", 7), ts.rolling(F.sum, "close", "symbol", "date", 7)).alias("ratio"))


@query("u3_keep_last", "o_custkey #o_orderkey", "", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def u3(spark, d):
    return jn.first_of(fr.table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("u4_u5_sets", "key side", "", "SELECT key, CASE WHEN a AND b THEN 'both' WHEN a THEN 'a' ELSE 'b' END AS side FROM (SELECT coalesce(x.k, y.k) AS key, x.k IS NOT NULL AS a, y.k IS NOT NULL AS b FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000) x FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) y ON x.k = y.k)")
def u4(spark, d):
    """Union of two key sets with which side each key is from: intersection, differences both ways."""
    x = fr.table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("key")).distinct().withColumn("a", F.lit(True))
    y = fr.table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).distinct().withColumn("b", F.lit(True))
    return x.join(y, "key", "full").withColumn("side", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "a").otherwise("b"))


@query("t8_limit_per_key", "o_custkey #o_orderkey #r", "", "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def t8(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return fr.table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 5")


@query("j9_limited_fill", "symbol date ~close", fr.FILLED, f"SELECT symbol, date, CASE WHEN date - max(CASE WHEN trading THEN date END) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) <= 2 THEN close END AS close FROM filled")
def j9(spark, d):
    """Closes carried forward for two days at most."""
    f = _filled(spark, d).withColumn("seen", F.max(F.when(F.col("trading"), F.col("date"))).over(ts.upto("symbol", "date")))
    return f.select("symbol", "date", F.when(F.date_diff("date", "seen") <= 2, F.col("close")).alias("close"))


@query("m14_neutral_ranks", "date ticker ~rank_fwd_ret", fr.PANEL, "SELECT date, ticker, CASE WHEN fwd_ret IS NULL THEN 0 ELSE r / n - 0.5 END AS rank_fwd_ret FROM (SELECT *, rank() OVER (PARTITION BY date, fwd_ret IS NULL ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY date, fwd_ret) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY date, fwd_ret IS NULL) AS n FROM panel)")
def m14(spark, d):
    return cs.neutral_ranks(fr.panel(spark, d), "date", ["fwd_ret"])


SPREAD = fr.PANEL + ", s AS (SELECT date, avg(fwd_ret) FILTER (discount > 0.05) - avg(fwd_ret) AS spread FROM panel WHERE fwd_ret IS NOT NULL GROUP BY 1)"


@query("m15_flag_spread", "#n ~spread ~t", SPREAD, "SELECT count(spread) AS n, avg(spread) AS spread, avg(spread) / stddev_samp(spread) * sqrt(count(spread)) AS t FROM s")
def m15(spark, d):
    """Mean return of flagged rows less the mean of all, per date; then its mean and t."""
    s = fr.panel(spark, d).where("fwd_ret is not null").groupBy("date").agg((F.avg(F.when(F.col("discount") > 0.05, F.col("fwd_ret"))) - F.avg("fwd_ret")).alias("s"))
    return s.agg(F.count("s").alias("n"), F.avg("s").alias("spread"), (F.avg("s") / F.stddev_samp("s") * F.sqrt(F.count("s"))).alias("t"))


FACTOR = fr.PANEL + """, ranked AS (SELECT date, ticker, fwd_ret, revenue, row_number() OVER (PARTITION BY date ORDER BY revenue DESC, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM panel),
top AS (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM ranked WHERE r <= greatest(1, floor(n * 0.1))),
turn AS (SELECT a.date, avg(coalesce(a.fwd_ret, 0)) AS long, avg(CASE WHEN b.ticker IS NULL THEN 1.0 ELSE 0.0 END) AS turnover FROM top a LEFT JOIN top b ON a.ticker = b.ticker AND a.k = b.k + 1 GROUP BY 1),
mean AS (SELECT date, avg(fwd_ret) AS m FROM panel GROUP BY 1)"""


@query("q_factor_backtest", "date ~long ~turnover ~vs_universe", FACTOR, "SELECT date, long, turnover, long - 2 * turnover * 0.001 - m AS vs_universe FROM turn JOIN mean USING (date)")
def q_factor(spark, d):
    """Top decile by score each month: mean return (missing 0), turnover, and the excess over the universe after costs."""
    p = fr.panel(spark, d)
    dates = p.select("date").distinct().withColumn("k", F.row_number().over(W.orderBy("date")))  # one row a month
    own = W.partitionBy("date")
    p = p.withColumns({"r": F.row_number().over(own.orderBy(F.desc("revenue"), "ticker")), "n": F.count("*").over(own)})
    p = p.withColumn("top", F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).join(F.broadcast(dates), "date")
    # a pick is new unless the ticker's last pick was in the month before
    last = F.max(F.when(F.col("top"), F.col("k"))).over(W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, -1))
    p = p.withColumn("new", F.coalesce(last != F.col("k") - 1, F.lit(True)).cast("double"))
    picked = lambda x: F.avg(F.when(F.col("top"), x))
    r = p.groupBy("date").agg(picked(F.coalesce("fwd_ret", F.lit(0.0))).alias("long"), picked(F.col("new")).alias("turnover"), F.avg("fwd_ret").alias("m"))
    return r.withColumn("vs_universe", F.col("long") - 2 * F.col("turnover") * 0.001 - F.col("m"))


@query("q_final_scores", "c_custkey ~score #place", "o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1), e AS (SELECT user_id, count(*) AS k FROM events GROUP BY 1), s AS (SELECT c_custkey, least(10, (coalesce(n, 0) >= 10)::INT * 5 + (coalesce(v, 0) > 1500000)::INT * 2 + (coalesce(k, 0) > 5)::INT * 1 + (c_acctbal > 5000)::INT * 2) AS score FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id)", "SELECT c_custkey, score, row_number() OVER (ORDER BY score DESC, c_custkey) AS place FROM s ORDER BY score DESC, c_custkey LIMIT 50")
def q_final(spark, d) -> DataFrame:
    """Signals joined to the universe with zeros for what is missing, scored, the best 50 in order."""
    o = fr.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    e = fr.table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("k"))
    u = fr.table(spark, d, "customer").join(o, "c_custkey", "left").join(e, "c_custkey", "left").fillna(0, ["n", "v", "k"])
    u = u.withColumn("score", sc.points((F.col("n") >= 10, 5), (F.col("v") > 1500000, 2), (F.col("k") > 5, 1), (F.col("c_acctbal") > 5000, 2)))
    top = sc.top_k(u, 50, "score", "c_custkey")
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "c_custkey")))  # 50 rows


@query("q_ew_buy_and_hold", "date ~ret", RETS, "SELECT date, avg(coalesce(ret, 0)) AS ret FROM rets GROUP BY 1")
def q_ew(spark, d):
    return _rets(spark, d).groupBy("date").agg(F.avg(F.coalesce("ret", F.lit(0.0))).alias("ret"))
