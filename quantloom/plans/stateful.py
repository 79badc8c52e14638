"""Registered queries of the order-dependent operators and the trading pipelines built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds as fo
from ..operators import quantiles as qu
from ..operators import scoring as sc
from ..operators import stateful as so
from ..operators import stats as st
from ..operators import timeseries as ts
from ..sources import frames as fr
from .catalog import HOURS, RETS, SYM, _filled, _rets, _W, query

#: Daily closes of each symbol, scaled, in order; the oracles go through them row by row.
DAYS = fr.DAILY + ", n AS MATERIALIZED (SELECT symbol, date, round(close / 300000, 9) AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM daily)"
#: Rows of a chunk in these queries: a few hundred, so that every symbol's years are cut into several.
CHUNK = 256


def _days(spark, d) -> DataFrame:
    return fr.daily_close(spark, d).select("symbol", "date", fr.rounded(F.col("close") / 300000, 9).alias("x"))


@query("o1_apply_band", "symbol date ~held", "RECURSIVE " + DAYS + ", f AS (SELECT symbol, date, k, CASE WHEN x = 0 OR abs(x) > 0.1 THEN x ELSE 0 END AS held FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.date, n.k, CASE WHEN n.x = 0 OR abs(n.x - f.held) > 0.1 THEN n.x ELSE f.held END FROM f JOIN n ON n.symbol = f.symbol AND n.k = f.k + 1)", "SELECT * FROM f")
def o1(spark, d):
    return fo.apply_band(_days(spark, d), "symbol", "date", "x", 0.1, rows=CHUNK)


@query("o2_state_machine", "symbol date #state", "RECURSIVE " + DAYS + ", f AS (SELECT symbol, date, k, (x > 0.62)::INT AS state FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.date, n.k, CASE WHEN f.state = 1 THEN (NOT (n.x < 0.58 OR n.x > 0.66))::INT ELSE (n.x > 0.62)::INT END FROM f JOIN n ON n.symbol = f.symbol AND n.k = f.k + 1)", "SELECT * FROM f")
def o2(spark, d):
    """A day above 0.66 is an entry and an exit."""
    x = F.col("x")
    return fo.state_machine(_days(spark, d).withColumns({"enter": x > 0.62, "leave": (x < 0.58) | (x > 0.66)}), "symbol", "date", "enter", "leave", rows=CHUNK)


@query("o4_rsi", "symbol date ~rsi", "RECURSIVE " + DAYS + ", g AS MATERIALIZED (SELECT symbol, date, k, greatest(x - lag(x) OVER (PARTITION BY symbol ORDER BY k), 0) AS up, greatest(lag(x) OVER (PARTITION BY symbol ORDER BY k) - x, 0) AS down FROM n), f AS (SELECT symbol, date, k, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS d FROM g WHERE k = 1 UNION ALL SELECT g.symbol, g.date, g.k, CASE WHEN f.u IS NULL THEN g.up ELSE f.u * 13 / 14 + g.up / 14 END, CASE WHEN f.d IS NULL THEN g.down ELSE f.d * 13 / 14 + g.down / 14 END FROM f JOIN g ON g.symbol = f.symbol AND g.k = f.k + 1)", "SELECT symbol, date, CASE WHEN d > 0 THEN 100 - 100 / (1 + u / d) ELSE 100 END AS rsi FROM f")
def o4(spark, d):
    return fo.rsi(_days(spark, d), "symbol", "date", "x", 14, rows=CHUNK)


@query("w17_rolling_max_drawdown", "symbol date ~max_drawdown", RETS + ", r AS (SELECT symbol, date, ret * 100 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, sum(ln(1 + ret * 100)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM rets WHERE ret IS NOT NULL), c AS (SELECT a.symbol, a.date, min(exp(z.s - y.s) - 1) AS m FROM r a JOIN r y ON y.symbol = a.symbol AND y.k BETWEEN a.k - 9 AND a.k JOIN r z ON z.symbol = a.symbol AND z.k BETWEEN y.k AND a.k WHERE a.k >= 10 GROUP BY 1, 2)", "SELECT r.symbol, r.date, c.m AS max_drawdown FROM r LEFT JOIN c ON r.symbol = c.symbol AND r.date = c.date")
def w17(spark, d):
    r = _rets(spark, d).where("ret is not null").withColumn("ret", F.col("ret") * 100)
    return fo.rolling_max_drawdown(r, "symbol", "date", "ret", 10, rows=CHUNK)


@query("o8_weekly_hold", "symbol date ~w", RETS, f"SELECT symbol, date, CASE WHEN close < CASE WHEN count(close) OVER {_W(200)} = 200 THEN avg(close) OVER {_W(200)} END THEN 0 ELSE coalesce(last_value(CASE WHEN dayofweek(date) = 0 THEN close / 500000 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0) END AS w FROM filled")
def o8(spark, d):
    f = _filled(spark, d).withColumns({"w": F.col("close") / 500000, "slow": ts.rolling(F.avg, "close", "symbol", "date", 200)})
    return so.weekly_hold(f, "symbol", "date", "w", F.col("close") < F.col("slow"))


BRACKET = "RECURSIVE " + HOURS + """, b AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS n,
         count(*) OVER w = 3 AND close > max(high) OVER w AS entry FROM filled_hours WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
x AS (SELECT s.symbol, s.k, min(j.k) AS e FROM b s JOIN b j ON s.symbol = j.symbol AND j.k > s.k AND s.entry
        AND (least(j.open, j.low) <= s.close * (1 - 0.5) OR greatest(j.open, j.high) >= s.close * (1 + 0.8) OR j.k - s.k >= 72 OR j.k = j.n) GROUP BY 1, 2),
y AS (SELECT a.symbol, a.k, a.e, min(z.k) AS following FROM x a LEFT JOIN x z ON a.symbol = z.symbol AND z.k >= a.e GROUP BY 1, 2, 3),
f AS (SELECT y.* FROM y JOIN (SELECT symbol, min(k) AS k FROM y GROUP BY 1) USING (symbol, k) UNION ALL SELECT y.* FROM f JOIN y ON y.symbol = f.symbol AND y.k = f.following),
t AS (SELECT f.symbol, i.ts + INTERVAL 1 HOUR AS entry_ts, o.ts + INTERVAL 1 HOUR AS exit_ts, i.close AS entry_price, f.e - f.k AS bars,
             CASE WHEN o.open <= i.close * (1 - 0.5) THEN o.open WHEN o.low <= i.close * (1 - 0.5) THEN i.close * (1 - 0.5)
                  WHEN o.open >= i.close * (1 + 0.8) THEN o.open WHEN o.high >= i.close * (1 + 0.8) THEN i.close * (1 + 0.8) ELSE o.close END AS exit_price,
             CASE WHEN least(o.open, o.low) <= i.close * (1 - 0.5) THEN 'stop' WHEN greatest(o.open, o.high) >= i.close * (1 + 0.8) THEN 'target' WHEN f.e - f.k >= 72 THEN 'time' ELSE 'end' END AS reason
      FROM f JOIN b i ON i.symbol = f.symbol AND i.k = f.k JOIN b o ON o.symbol = f.symbol AND o.k = f.e)"""


def _bracket(spark, d) -> DataFrame:
    b = ts.fill_hours(fr.bars_1h(spark, d))
    b = b.withColumn("entry", sc.holds(F.col("close") > ts.rolling(F.max, "high", "symbol", "ts", 3, lag=1)))
    return b.withColumns({"stop_pct": F.lit(0.5), "target_pct": F.lit(0.8)})


@query("o3_simulate_trades", "symbol entry_ts exit_ts ~entry_price ~exit_price #bars reason ~pnl", BRACKET, "SELECT *, exit_price / entry_price * pow(1 - 0.003, 2) - 1 AS pnl FROM t")
def o3(spark, d):
    return so.simulate_trades(_bracket(spark, d))


@query("o3_trade_returns", "symbol ts ~ret", BRACKET, """SELECT symbol, ts, mark / before * CASE WHEN first THEN 1 - 0.003 ELSE 1 END * CASE WHEN last THEN 1 - 0.003 ELSE 1 END - 1 AS ret
FROM (SELECT t.symbol, b.ts, CASE WHEN b.ts + INTERVAL 1 HOUR = t.exit_ts THEN t.exit_price ELSE b.close END AS mark, b.ts = t.entry_ts AS first, b.ts + INTERVAL 1 HOUR = t.exit_ts AS last,
             CASE WHEN b.ts = t.entry_ts THEN t.entry_price ELSE lag(b.close) OVER (PARTITION BY t.symbol, t.entry_ts ORDER BY b.ts) END AS before
      FROM t JOIN b ON b.symbol = t.symbol AND b.ts >= t.entry_ts AND b.ts < t.exit_ts)""")
def o3_returns(spark, d):
    return so.trade_returns(_bracket(spark, d)).where("ret is not null")


@query("a10_profit_factor", "symbol #trades ~profit_factor", HOURS + ", x AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pnl FROM filled_hours)", "SELECT symbol, count(*) AS trades, coalesce(sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0), 'inf'::DOUBLE) AS profit_factor FROM x WHERE pnl IS NOT NULL GROUP BY 1")
def a10(spark, d):
    b = ts.fill_hours(fr.bars_1h(spark, d)).withColumn("pnl", ts.pct_change("close", "symbol", "ts")).where("pnl is not null")
    return st.profit_factor(b, "symbol", "pnl")


VOTES = ", ".join(f"(close / lag(close, {n}) OVER {SYM}) - 1 > 0)::INT" for n in (20, 60, 120, 250))
TREND = fr.FILLED + f", v AS (SELECT symbol, date, close, [{VOTES}] AS votes FROM filled)"


def trend_signal(df: DataFrame, horizons: tuple[int, ...] = (20, 60, 120, 250)) -> DataFrame:
    """Mean of the horizons' votes (1 if the close has risen); NULL until all have one."""
    votes = [(ts.pct_change("close", "symbol", "date", n) > 0).cast("int").cast("double") for n in horizons]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return df.withColumn("signal", total / len(horizons))


@query("q_b_trend_ensemble", "symbol date ~signal", TREND, "SELECT symbol, date, (votes[1] + votes[2] + votes[3] + votes[4]) / 4 AS signal FROM v")
def q_b(spark, d):
    return trend_signal(_filled(spark, d))


@query("q_trend_backtest", "symbol #days ~total ~sharpe ~max_drawdown")
def q_trend(spark, d):
    """Trend ensemble scaled to a target volatility, in a band, with fees: order-dependent, so without SQL."""
    f = trend_signal(_rets(spark, d))
    vol = ts.rolling(F.stddev_samp, "ret", "symbol", "date", 30) * F.sqrt(F.lit(365.0))
    f = f.withColumn("target", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("signal") * 0.4, vol))))
    f = fo.apply_band(f.select("symbol", "date", "ret", "target"), "symbol", "date", "target")
    f = f.withColumn("next", F.lead("ret").over(ts.by("symbol", "date"))).where("next is not null")
    return st.metrics(st.strategy_returns(f, "symbol", "date", "held", "next", 0.001), "symbol", "date", "net")


#: Returns of two kinds: the first two symbols gain on two days of three, the others lose.
GATED = RETS + """, g AS (SELECT symbol, date, abs(ret) * CASE WHEN symbol > '3' OR day(date) % 3 = 0 THEN -0.1 ELSE 1 END AS ret FROM rets WHERE ret IS NOT NULL),
e AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM g),
dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS down FROM e),
m AS (SELECT symbol, avg(ret) / stddev_samp(ret) * sqrt(365.0) AS sharpe, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t, min(down) AS worst,
             avg((ret > 0)::INT) AS hit_rate, coalesce(sum(greatest(ret, 0)) / nullif(sum(greatest(-ret, 0)), 0), 'inf'::DOUBLE) AS profit_factor FROM dd GROUP BY 1)"""


@query("m3_gate", "symbol ~hit_rate ~profit_factor passes passes_v2", GATED, f"SELECT symbol, hit_rate, profit_factor, sharpe > 1.5 AND worst > -0.15 AND hit_rate > 0.55 AND t > {st.t_threshold(11)!r} AS passes, sharpe > 1.5 AND worst > -0.2 AND profit_factor > 1.5 AND t > {st.t_threshold(16)!r} AS passes_v2 FROM m")
def m3(spark, d):
    """Both gates over every symbol's daily returns, each of which counts as a trade."""
    sign = F.when((F.col("symbol") > "3") | (F.dayofmonth("date") % 3 == 0), -0.1).otherwise(1.0)
    r = _rets(spark, d).where("ret is not null").withColumn("ret", F.abs("ret") * sign)
    m = st.metrics(r, "symbol", "date", "ret").join(st.hit_rate(r, "symbol", "ret"), "symbol").join(st.profit_factor(r, "symbol", "ret").drop("trades"), "symbol")
    return st.gate_v2(st.gate(m, 11), 16)


REGIME = RETS + f""", t AS (SELECT symbol, date, ret, close / lag(close, 60) OVER {SYM}) - 1 AS trend FROM rets),
v AS (SELECT *, CASE WHEN count(ret) OVER {_W(30)} = 30 THEN round(stddev_samp(ret) OVER {_W(30)}, 9) END AS vol FROM t),
l AS (SELECT symbol, date, ret, CASE WHEN trend > 0.1 THEN 'up' WHEN trend < -0.1 THEN 'down' ELSE 'range' END
             || CASE WHEN count(vol) OVER w >= 180 AND vol > quantile_cont(vol, 0.5) OVER w THEN '/high' ELSE '/low' END AS label
      FROM v WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
k AS (SELECT symbol, ret, lag(label) OVER {SYM}) AS regime FROM l)"""


@query("m4_regimes", "symbol regime #days ~annual ~sharpe", REGIME, "SELECT symbol, regime, count(*) AS days, pow(product(1 + ret), 365.0 / count(*)) - 1 AS annual, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(365.0) END AS sharpe FROM k WHERE regime IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2")
def m4(spark, d):
    """Days, annual return and Sharpe of each trend and volatility regime, known the day before: volatility is high
    above its expanding median of 180 values at least; a missing value counts as range and low."""
    k = ("symbol", "date")
    f = _rets(spark, d).withColumn("trend", ts.pct_change("close", *k, 60))
    f = f.withColumn("vol", fr.rounded(ts.rolling(F.stddev_samp, "ret", *k, 30), 9))
    f = qu.expanding_quantile(f.select(*k, "ret", "trend", "vol"), *k, "vol", 0.5, 180, "median")
    high = sc.holds(F.col("vol") > F.col("median"))
    trend = F.when(F.col("trend") > 0.1, "up").when(F.col("trend") < -0.1, "down").otherwise("range")
    f = f.withColumn("label", F.concat(trend, F.when(high, "/high").otherwise("/low")))
    f = f.withColumn("regime", F.lag("label").over(ts.by(*k))).where("regime is not null and ret is not null")
    sd = F.stddev_samp("ret")
    return f.groupBy("symbol", "regime").agg(F.count("*").alias("days"), (F.pow(st.compounded("ret") + 1, 365.0 / F.count("*")) - 1).alias("annual"), F.when(sd > 0, F.avg("ret") / sd * F.sqrt(F.lit(365.0))).alias("sharpe"))
