"""Registered queries of the research side: price features of a monthly panel, evaluation of forecasts and positions, the crowding filter, the ensemble filter."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import crosssec as cs
from ..operators import forecast as fc
from ..operators import quantiles as qu
from ..operators import research as rs
from ..operators import scoring as sc
from ..operators import stats as st
from ..operators import timeseries as ts
from ..sources import frames as fr
from .catalog import RETS, SYM, _filled, _rets, _W, query

PRICES = fr.DAILY + f""", x AS (SELECT *, close / lag(close) OVER {SYM}) - 1 AS r, min(date) OVER (PARTITION BY symbol) AS begun FROM daily),
z AS (SELECT symbol, date, begun, lag(close, 21) OVER {SYM}) / lag(close, 252) OVER {SYM}) - 1 AS momentum, CASE WHEN count(close) OVER {_W(252)} >= 200 THEN close / max(close) OVER {_W(252)} END AS near_high,
             CASE WHEN count(r) OVER {_W(252)} >= 200 THEN stddev_samp(r) OVER {_W(252)} * sqrt(252.0) END AS volatility, close / lag(close, 21) OVER {SYM}) - 1 AS month_return,
             CASE WHEN count(close) OVER {_W(200)} = 200 THEN (avg(close) OVER {_W(50)} > avg(close) OVER {_W(200)})::INT END AS above, row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date DESC) AS back FROM x)"""


@query("q_panel_prices", "symbol date ~momentum ~near_high ~volatility ~month_return #above", PRICES, "SELECT * FROM z WHERE back = 1 AND date >= begun + 380")
def q_panel(spark, d):
    """Price features at each symbol's last day of a month, from 380 days after its first day on: one sort per symbol and one per month."""
    k = ("symbol", "date")
    c = fr.daily_close(spark, d)
    c = c.withColumns({"r": ts.pct_change("close", *k), "begun": F.first("date").over(ts.upto(*k))})
    r = lambda agg, col, n, m: ts.rolling(agg, col, *k, n, m)
    c = c.withColumns({
        "momentum": F.try_divide(F.lag("close", 21).over(ts.by(*k)), F.lag("close", 252).over(ts.by(*k))) - 1,
        "near_high": F.col("close") / r(F.max, "close", 252, 200), "volatility": r(F.stddev_samp, "r", 252, 200) * F.sqrt(F.lit(252.0)),
        "month_return": ts.pct_change("close", *k, 21), "above": (r(F.avg, "close", 50, 50) > r(F.avg, "close", 200, 200)).cast("int"),
        "following": F.lead("date").over(ts.by(*k)),
    })
    last = sc.holds(F.trunc("following", "month") == F.trunc("date", "month"))
    return c.where(~last & (F.col("date") >= F.date_add("begun", 380)))


@query("m18_monthly_stats", "symbol #months ~annual ~sharpe ~t_stat ~max_drawdown ~positive", RETS + ", m AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS date, product(1 + ret) - 1 AS ret FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2), e AS (SELECT *, product(1 + ret) OVER w AS eq FROM m WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, eq / max(eq) OVER w - 1 AS down FROM e WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))", "SELECT symbol, count(*) AS months, pow(product(1 + ret), 12.0 / count(*)) - 1 AS annual, avg(ret) / stddev_samp(ret) * sqrt(12.0) AS sharpe, avg(ret) / stddev_samp(ret) * sqrt(count(*)) AS t_stat, min(down) AS max_drawdown, avg((ret > 0)::INT) AS positive FROM dd GROUP BY 1")
def m18(spark, d):
    m = _rets(spark, d).where("ret is not null").groupBy("symbol", F.trunc("date", "month").alias("date")).agg(st.compounded("ret").alias("ret"))
    return st.monthly_stats(m, "symbol", "date", "ret")


POSITIONS = RETS + f""", p AS (SELECT symbol, date, ret, CASE WHEN lag(ret) OVER {SYM}) > 0 THEN 1.0 WHEN lag(ret) OVER {SYM}) < 0 THEN -1.0 ELSE 0 END AS pos FROM rets WHERE ret IS NOT NULL),
n AS (SELECT *, coalesce(pos - lag(pos) OVER {SYM}), pos) AS c, pos * ret - coalesce(abs(pos - lag(pos) OVER {SYM})), abs(pos)) * 0.0005 AS net FROM p),
e AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM n),
dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS down FROM e)"""


@query("m6_m10_performance", "symbol #active ~hit_rate ~gross ~net ~sharpe ~volatility ~max_drawdown #trades ~exposure ~turnover", POSITIONS, "SELECT symbol, count(*) FILTER (pos <> 0) AS active, count(*) FILTER (pos <> 0 AND sign(pos) = sign(ret)) / count(*) FILTER (pos <> 0) AS hit_rate, product(1 + pos * ret) - 1 AS gross, product(1 + net) - 1 AS net, avg(net) / stddev_samp(net) * sqrt(365.0) AS sharpe, stddev_samp(net) * sqrt(365.0) AS volatility, min(down) AS max_drawdown, count(*) FILTER (c <> 0) AS trades, avg(abs(pos)) AS exposure, sum(abs(c)) * 365.0 / count(*) AS turnover FROM dd GROUP BY 1")
def m6(spark, d):
    """Momentum: yesterday's direction, after fees of 5 basis points of the turnover."""
    r = _rets(spark, d).where("ret is not null")
    return st.performance(r.withColumn("pos", F.signum(F.lag("ret").over(ts.by("symbol", "date")))), "symbol", "date", "pos", "ret", 0.0005)


@query("m7_calibration", "symbol #n ~risen ~forecast ~brier ~brier_constant ~corr", RETS + ", p AS (SELECT symbol, date, ret, abs(sin(row_number() OVER (PARTITION BY symbol ORDER BY date) * 1.7)) AS p, (ret > 0)::INT AS up FROM rets WHERE ret IS NOT NULL)", "SELECT symbol, count(*) AS n, avg(up) AS risen, avg(p) AS forecast, avg((p - up) ** 2) AS brier, avg(up) - avg(up) * avg(up) AS brier_constant, corr(p, ret) AS corr FROM p GROUP BY 1")
def m7(spark, d):
    r = _rets(spark, d).where("ret is not null")
    return st.calibration(r.withColumn("p", F.abs(F.sin(F.row_number().over(ts.by("symbol", "date")) * 1.7))), "symbol", "p", "ret")


@query("q_j_crowded", "symbol date crowded", fr.FILLED + f", a AS (SELECT symbol, date, CASE WHEN count(close) OVER {_W(7)} = 7 THEN round(avg(close) OVER {_W(7)}, 4) END AS x FROM filled)", f"SELECT symbol, date, coalesce(CASE WHEN count(x) OVER {_W(365)} >= 180 THEN x > quantile_cont(x, 0.9) OVER {_W(365)} END, false) AS crowded FROM a")
def q_j(spark, d):
    """Whether a week's mean stands in the top tenth of the past year's; false until half a year is known."""
    k = ("symbol", "date")
    a = _filled(spark, d).select(*k, fr.rounded(ts.rolling(F.avg, "close", *k, 7), 4).alias("x"))
    return qu.rolling_quantile(a, *k, "x", 0.9, 365, 180, "q", rows=1000).withColumn("crowded", sc.holds(F.col("x") > F.col("q")))


@query("o5_ensemble_filter", "symbol ts ~p_up ~mu ~mu_spread ~variance ~h_spread ~position")
def o5(spark, d):
    """The filter over every symbol's hours with a window of ten days, and the position that follows from it: draws random numbers, so without SQL."""
    b = ts.fill_hours(fr.bars_1h(spark, d)).withColumn("high", F.col("high") * 1.0001)
    f = fc.ensemble_filter(b, settings=fc.Filter(window=240)).where("p_up is not null")
    return f.withColumn("position", fc.filter_position(F.col("mu"), F.col("mu_spread"), F.col("h_spread")))


#: Ten series of one asset, published a few days late and with holes; the asset's own price is the 28-day mean of one symbol's closes.
LAGS = {"1-URGENT": 1, "2-HIGH": 0, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1, "5-LOW": 0, "A": 3, "N": 1, "R": 0, "O": 2, "F": 0}
_LAG = "CASE name " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in LAGS.items()) + " END"
#: Which of them stands for which block.
BLOCKS = {"funding": "1-URGENT", "implied": "2-HIGH", "addresses": "3-MEDIUM", "transfers": "4-NOT SPECIFIED", "hashes": "5-LOW", "mvrv": "A", "inflow": "N", "outflow": "R", "stable": "O", "locked": "F", "fear": "1-URGENT", "stocks": "A", "dollar": "N", "bonds": "R", "gold": "3-MEDIUM"}
SERIES = fr.FILLED + f""", own AS (SELECT date, avg(close) OVER w AS close FROM filled WHERE symbol = '1-URGENT' WINDOW w AS (ORDER BY date ROWS 27 PRECEDING)),
raw AS (SELECT o_orderpriority AS name, CAST(o_orderdate AS DATE) AS date, o_totalprice AS v FROM orders UNION ALL SELECT l_returnflag, CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem UNION ALL SELECT l_linestatus, CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem),
entries AS (SELECT name, date + {_LAG} AS avail, CASE WHEN day(date) <> 13 THEN sqrt(avg(v)) END AS value FROM raw WHERE NOT (month(date) IN (3, 9) AND day(date) BETWEEN 10 AND 21) AND dayofweek(date) BETWEEN 1 AND 5 GROUP BY name, date),
seen AS (SELECT o.date, name, value, avail, (SELECT count(*) FROM own x WHERE x.date > e.avail AND x.date <= o.date) AS since FROM (SELECT date, name FROM own, (SELECT DISTINCT name FROM entries)) o ASOF LEFT JOIN entries e USING (name, date >= avail))"""
SERIES = SERIES.replace("ASOF LEFT JOIN entries e USING (name, date >= avail))", "ASOF LEFT JOIN entries e ON o.name = e.name AND o.date >= e.avail)").replace("SELECT o.date, name, value", "SELECT o.date, o.name, value")
SERIES += f""", known AS (SELECT date, name, CASE WHEN since <= 5 THEN value END AS value FROM seen),
d AS (SELECT 'x' AS asset, own.date, own.close, {', '.join(f"(max(value) FILTER (name = '{k}')) AS {b}" for b, k in BLOCKS.items())} FROM own LEFT JOIN known ON own.date = known.date GROUP BY 1, 2, 3)"""
_O = "(ORDER BY date"
_A = lambda agg, c, n, m: f"CASE WHEN count({c}) OVER (ORDER BY date ROWS {n - 1} PRECEDING) >= {m} THEN {agg}({c}) OVER (ORDER BY date ROWS {n - 1} PRECEDING) END"
_L = lambda c, n: f"lag({c}, {n}) OVER (ORDER BY date)"
_GROW = lambda c, n: f"{c} / nullif({_L(c, n)}, 0) - 1"
RESEARCH = SERIES + f""", d1 AS (SELECT *, ln(close / {_L('close', 1)}) AS r, inflow - outflow AS flow, inflow + outflow AS both_ FROM d),
d2 AS (SELECT *, {_A('avg', 'funding', 7, 7)} AS funding_7, {_A('stddev_samp', 'r', 30, 30)} * sqrt(365.0) AS price_vol_30, {', '.join(f"{_A('avg', c, 7, 7)} AS s_{c}" for c in ('addresses', 'transfers', 'hashes'))}, {_A('sum', 'flow', 7, 7)} / nullif({_A('sum', 'both_', 7, 7)}, 0) AS net_flow FROM d1),
f AS (SELECT asset, date, close, {_GROW('close', 30)} AS price_mom_30, {_GROW('close', 90)} AS price_mom_90, price_vol_30, funding_7, (funding_7 - {_A('avg', 'funding_7', 365, 180)}) / nullif({_A('stddev_samp', 'funding_7', 365, 180)}, 0) AS funding_z, implied, implied - {_L('implied', 7)} AS implied_change, implied / 100 - price_vol_30 AS premium,
  {', '.join(f"{_GROW(f's_{c}', 30)} AS {c}_growth" for c in ('addresses', 'transfers', 'hashes'))}, mvrv, net_flow, {_GROW('stable', 30)} AS stable_growth, {_GROW('locked', 30)} AS locked_growth, fear, fear - {_L('fear', 7)} AS fear_change, {', '.join(f"{_GROW(c, 20)} AS {c}_mom" for c in ('stocks', 'dollar', 'bonds', 'gold'))} FROM d2)"""


def _own(spark, d):
    f = _filled(spark, d).where("symbol = '1-URGENT'")
    return f.select("date", F.avg("close").over(W.orderBy("date").rowsBetween(-27, 0)).alias("close"))  # one asset's days


def _known(spark, d, own):
    """Each series' values on the asset's days."""
    o, li = fr.table(spark, d, "orders"), fr.table(spark, d, "lineitem")
    raw = o.select(F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("v"))
    raw = raw.unionByName(li.select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("name"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("v")))
    raw = raw.where(~(F.month("date").isin(3, 9) & F.dayofmonth("date").between(10, 21)) & F.dayofweek("date").between(2, 6))
    entries = raw.groupBy("name", "date").agg(F.sqrt(F.avg("v")).alias("a")).select("name", "date", F.when(F.dayofmonth("date") != 13, F.col("a")).alias("value"))
    return rs.asof_entries(own, entries, "name", "date", 5, LAGS)


def _research(spark, d):
    own = _own(spark, d)
    known = rs.wide(_known(spark, d, own), "name", sorted(set(BLOCKS.values())), "date")
    wide = own.join(known, "date", "left").select(F.lit("x").alias("asset"), "date", "close", *[F.col(f"`{k}`").alias(b) for b, k in BLOCKS.items()])
    return rs.features(wide, "asset", "date")


@query("j9_asof_entries", "date name ~value", SERIES, "SELECT date, name, value FROM known")
def j9(spark, d):
    """Series at each day of an asset, five days after their last entry at most, each published a few days late."""
    return _known(spark, d, _own(spark, d))


@query("q_res_features", "date " + " ".join(f"~{c}" for c in rs.FEATURES), RESEARCH, "SELECT * FROM f")
def q_res(spark, d):
    """The 21 research features of every day."""
    return _research(spark, d)


#: Days of the target, and the first day that the development period must not see.
HORIZON, OUT = 7, "2000-01-01"
_IC = " UNION ALL ".join(f"SELECT '{c}' AS feature, date, round({c}, 9) AS x, round(y, 9) AS y FROM z" for c in rs.FEATURES)
RES_IC = RESEARCH + f""", z AS (SELECT *, ln(lead(close, {HORIZON}) OVER (ORDER BY date) / close) AS y FROM f), long AS ({_IC}), first AS (SELECT feature, min(date) FILTER (x IS NOT NULL) AS since FROM long WHERE date < DATE '{OUT}' - {HORIZON} GROUP BY 1),
p AS (SELECT * FROM long WHERE x IS NOT NULL AND y IS NOT NULL AND dayofweek(date) = 0 AND date < DATE '{OUT}' - {HORIZON}),
k AS (SELECT feature, rank() OVER a + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER b + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM p WINDOW a AS (PARTITION BY feature ORDER BY x), b AS (PARTITION BY feature ORDER BY y)),
c AS (SELECT feature, count(*) AS weeks, corr(rx, ry) AS ic FROM k GROUP BY 1 HAVING count(*) >= 20),
ky AS (SELECT feature, year(date) AS year, rank() OVER a + (count(*) OVER (PARTITION BY feature, year(date), x) - 1) / 2.0 AS rx, rank() OVER b + (count(*) OVER (PARTITION BY feature, year(date), y) - 1) / 2.0 AS ry FROM p WINDOW a AS (PARTITION BY feature, year(date) ORDER BY x), b AS (PARTITION BY feature, year(date) ORDER BY y)),
cy AS (SELECT feature, year, corr(rx, ry) AS ic FROM ky GROUP BY 1, 2 HAVING count(*) >= 20),
s AS (SELECT c.feature, weeks, c.ic, c.ic * sqrt((weeks - 2) / (1 - c.ic * c.ic)) AS t, count(cy.ic) AS years, count(*) FILTER (sign(cy.ic) = sign(c.ic)) AS same FROM c LEFT JOIN cy USING (feature) GROUP BY 1, 2, 3)"""


@query("q_res_ic", "feature since #weeks ~ic ~t #same #years #place", RES_IC, "SELECT s.*, since, row_number() OVER (ORDER BY abs(round(t, 9)) DESC, feature) AS place FROM s JOIN first USING (feature)")
def q_res_ic(spark, d):
    """Rank correlation of each feature with the next week's return on the Sundays of the development period, whose targets end
    before it does; years with the same sign; most telling first."""
    z = rs.forward(_research(spark, d), "asset", "date", HORIZON, "y").where(F.col("date") < F.date_sub(F.lit(OUT).cast("date"), HORIZON))
    long = z.unpivot(["date", "y"], list(rs.FEATURES), "feature", "x").withColumns({"x": fr.rounded("x", 9), "y": fr.rounded("y", 9), "year": F.year("date")})  # ties stay ties
    since = long.where("x is not null").groupBy("feature").agg(F.min("date").alias("since"))
    sundays = long.where(F.dayofweek("date") == 1)
    ic = cs.ic_masked(sundays, "feature", "x", "y", 20)
    keyed = sundays.withColumn("both", F.struct("feature", "year"))
    years = cs.ic_masked(keyed, "both", "x", "y", 20).select(F.col("both.feature").alias("of"), F.col("ic").alias("year_ic"))
    s = ic.join(years, ic["feature"] == years["of"], "left").groupBy("feature", F.col("n").alias("weeks"), "ic", "t").agg(F.count("year_ic").alias("years"), F.count_if(F.signum("year_ic") == F.signum("ic")).alias("same"))
    return s.join(since, "feature").withColumn("place", F.row_number().over(W.orderBy(F.desc(F.abs(fr.rounded("t", 9))), "feature")))  # a row a feature
