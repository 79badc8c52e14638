"""Registered queries of evaluation: significance of signals, forecasts against baselines, bands of normality, sweeps over parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import crosssec as cs
from ..operators import replay as rp
from ..operators import scoring as sc
from ..operators import stats as st
from ..operators import sweeps as sw
from ..operators import timeseries as ts
from .catalog import RETS, SYM, _filled, _rets, _W, query
from .companies import SIGNALS, _signals

#: Student's t by its finite series; r: correlation, n: pairs.
T_P = """CASE WHEN abs(r) >= 1 THEN 0.0 WHEN n % 2 = 0 THEN 1 - abs(r) * coalesce(list_sum(list_transform(range(0, CAST((n - 2) // 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - 0.5 * ln(pi()) + j * ln(1 - r * r)))), 0)
  ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * coalesce(list_sum(list_transform(range(0, CAST((n - 3) // 2 AS BIGINT)), lambda j: exp(0.5 * ln(pi()) - ln(2) + lgamma(j + 1.0) - lgamma(j + 1.5) + j * ln(1 - r * r)))), 0)) END"""

#: Signals of the table; yes-no ones count as 1 and 0.
SIGNAL_COLUMNS = ("revenue_cagr", "eps_cagr", "peg", "pe", "profit_margin", "roe", "roa", "current_ratio", "retracement", "points", "final_score", "pattern_daily", "pattern_weekly", "insider_net_positive", "institutional_trend", "fundamental_pass", "only_some")
_LONG = " UNION ALL ".join(f"SELECT ticker, '{c}' AS signal, CAST({c} AS DOUBLE) AS x FROM z" for c in SIGNAL_COLUMNS)
IC_TABLE = SIGNALS + f""", y AS (SELECT s_suppkey AS ticker, ((s_suppkey * 7919) % 1009) / 100.0 + (s_suppkey % 19) AS ret FROM supplier WHERE s_suppkey % 10 > 0),
z AS (SELECT final.*, CASE WHEN ticker % 10 IN (1, 2) AND ticker < 45 THEN pe END AS only_some FROM final), long AS ({_LONG}), p AS (SELECT signal, x, ret FROM long JOIN y USING (ticker) WHERE x IS NOT NULL),
k AS (SELECT signal, rank() OVER (PARTITION BY signal ORDER BY x) + (count(*) OVER (PARTITION BY signal, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY signal ORDER BY ret) + (count(*) OVER (PARTITION BY signal, ret) - 1) / 2.0 AS ry FROM p),
c AS (SELECT signal, corr(rx, ry) AS r, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 10 AND count(DISTINCT rx) > 1),
t AS (SELECT *, round_even({T_P}, 4) AS p, round_even(r, 4) AS ic FROM c)"""


@query("q_ics_table", "signal ~ic ~p #n significant label #place", IC_TABLE, "SELECT signal, ic, p, n, p < 0.05 AS significant, CASE WHEN abs(ic) >= 0.1 AND p < 0.05 THEN 'strong' WHEN p < 0.05 THEN 'weak' ELSE 'none' END AS label, row_number() OVER (ORDER BY ic DESC, signal) AS place FROM t")
def q_ics(spark, d):
    """Rank correlation of every signal of the screener with what followed, its p value and label: signals are unpivoted,
    so that one job ranks all; ones with less than ten pairs or a single value have none."""
    s = _signals(spark, d).withColumn("only_some", F.when((F.col("ticker") % 10).isin(1, 2) & (F.col("ticker") < 45), F.col("pe")))
    s = s.select("ticker", *[F.col(c).cast("double").alias(c) for c in SIGNAL_COLUMNS])
    k = F.col("ticker")
    s = s.withColumn("ret", F.when(k % 10 > 0, (k * 7919) % 1009 / 100.0 + k % 19))
    return cs.ic_table(s.unpivot(["ticker", "ret"], list(SIGNAL_COLUMNS), "signal", "x"), "signal", "x", "ret")


#: A forecast of rises that knows a little: the sine of the day and the day's own return.
FORECAST = RETS + f""", f AS (SELECT symbol, date, ret, lag(ret) OVER {SYM}) AS before, 0.5 + 0.12 * sin(row_number() OVER (PARTITION BY symbol ORDER BY date) * 1.7) + 0.02 * sign(ret) AS p FROM rets WHERE ret IS NOT NULL),
s AS (SELECT symbol, date, ret, unnest([{{'s': 'above 0.00', 'p': (p > 0.5)::INT - (p < 0.5)::INT}}, {{'s': 'above 0.02', 'p': (p > 0.52)::INT - (p < 0.48)::INT}}, {{'s': 'above 0.05', 'p': (p > 0.55)::INT - (p < 0.45)::INT}}, {{'s': 'above 0.10', 'p': (p > 0.6)::INT - (p < 0.4)::INT}},
      {{'s': 'hold', 'p': 1}}, {{'s': 'momentum', 'p': coalesce(sign(before), 0)::INT}}, {{'s': 'reversal', 'p': -coalesce(sign(before), 0)::INT}}]) AS u FROM f),
n AS (SELECT symbol, date, ret, u.s AS strategy, u.p AS pos, coalesce(u.p - lag(u.p) OVER w, u.p) AS c FROM s WINDOW w AS (PARTITION BY symbol, u.s ORDER BY date)),
e AS (SELECT *, pos * ret - abs(c) * 0.0005 AS net, product(1 + pos * ret - abs(c) * 0.0005) OVER (PARTITION BY symbol, strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM n),
dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol, strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS down FROM e),
m AS (SELECT symbol, strategy, count(*) AS days, count(*) FILTER (pos <> 0) AS active, count(*) FILTER (pos <> 0 AND sign(pos) = sign(ret)) AS hits, product(1 + pos * ret) - 1 AS gross, product(1 + net) - 1 AS net, avg(net) / nullif(stddev_samp(net), 0) * sqrt(365.0) AS sharpe,
      min(down) AS max_drawdown, count(*) FILTER (c <> 0) AS trades, pow(product(1 + net), 365.0 / count(*)) - 1 AS cagr FROM dd GROUP BY 1, 2)"""
#: erfc by Simpson's rule is too rough; the sum of the binomial's normal tail by its series.
ERFC = "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: pow(-1, k) * exp((2 * k + 1) * ln(z) - lgamma(k + 1.0)) / (2 * k + 1)))"


@query("m7_forecast_evaluation", "symbol strategy #active ~hit_rate ~p_value ~gross ~net ~sharpe ~max_drawdown #trades ~cagr ~calmar", FORECAST + f", z AS (SELECT *, abs(hits - active / 2.0) / sqrt(active / 4.0) / sqrt(2.0) AS z FROM m)", f"SELECT symbol, strategy, active, hits / nullif(active, 0) AS hit_rate, CASE WHEN active > 0 THEN CASE WHEN z = 0 THEN 1.0 WHEN z > 4 THEN 0 ELSE {ERFC} END END AS p_value, gross, net, sharpe, max_drawdown, trades, cagr, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) END AS calmar FROM z")
def m7_evaluation(spark, d):
    """A forecast at four thresholds, and what holding, momentum and reversal give on the same days: positions are columns of one row, so prices are read and sorted once."""
    k = ("symbol", "date")
    r = _rets(spark, d).where("ret is not null")
    day = F.row_number().over(ts.by(*k))
    r = r.withColumns({"before": F.lag("ret").over(ts.by(*k)), "p": 0.5 + 0.12 * F.sin(day * 1.7) + 0.02 * F.signum("ret")})
    way = F.coalesce(F.signum("before"), F.lit(0.0))
    positions = {f"above {x:.2f}": (F.col("p") > 0.5 + x).cast("double") - (F.col("p") < 0.5 - x).cast("double") for x in (0.0, 0.02, 0.05, 0.10)}
    return st.performances(r, *k, positions | {"hold": F.lit(1.0), "momentum": way, "reversal": -way}, "ret", 0.0005)


#: Prices that move by a few per cent a day: the mean of the last 28 days' closes.
PRICE = RETS + f""", price AS (SELECT symbol, date, c AS close, c / lag(c) OVER {SYM}) - 1 AS day FROM (SELECT symbol, date, avg(close) OVER {_W(28)} AS c, count(close) OVER {_W(28)} AS n FROM filled) WHERE n = 28)"""


def _prices(spark, d) -> DataFrame:
    f = _filled(spark, d).select("symbol", "date", ts.rolling(F.avg, "close", "symbol", "date", 28).alias("close"))
    return f.where("close is not null")


PERIODS = {"early": ("1995-06-01", "1997-01-01"), "unseen": ("1997-01-01", "1999-06-01"), "recent": ("1999-06-01", None), "total": ("1995-06-01", None)}
SIZES = [sw.Variant(f"{t:.2f}", target=t, guarded=True) for t in (0.19, 0.25, 0.30, 0.40, 0.60, 0.80)]
VARIANTS = [sw.Variant("G"), sw.Variant("G1", lookbacks=(14, 30, 60, 90)), sw.Variant("G2", guarded=True), sw.Variant("G3", top=2), sw.Variant("I", top=3)]


def _sweep_sql(variants) -> str:
    rows = ", ".join(f"('{v.name}', {v.top}, {v.target}::DOUBLE, {v.guarded}, {'true' if len(v.lookbacks) > 1 else 'false'})" for v in variants)
    spans = " UNION ALL ".join(f"SELECT '{n}' AS period, DATE '{a}' AS a, DATE '{b or '9999-01-01'}' AS b" for n, (a, b) in PERIODS.items())
    back = lambda n: f"close / lag(close, {n}) OVER {SYM}) - 1"
    return PRICE + f""", v(variant, top, target, guarded, wide) AS (VALUES {rows}), spans AS ({spans}),
m AS (SELECT symbol, date, close, day, {back(30)} AS m0, ({back(14)} + {back(30)} + {back(60)} + {back(90)}) / 4 AS m1, CASE WHEN count(day) OVER {_W(30)} = 30 THEN stddev_samp(day) OVER {_W(30)} * sqrt(365.0) END AS vol,
             symbol = '1-URGENT' AND coalesce(close < CASE WHEN count(close) OVER {_W(200)} = 200 THEN avg(close) OVER {_W(200)} END, false) AS low FROM price),
x AS (SELECT m.*, v.*, CASE WHEN wide THEN m1 ELSE m0 END AS mom, bool_or(low) OVER (PARTITION BY date, variant) AS off FROM m, v),
k AS (SELECT *, row_number() OVER (PARTITION BY date, variant ORDER BY mom DESC NULLS LAST, symbol) AS rank FROM x),
s AS (SELECT *, CASE WHEN rank <= top AND mom > 0 AND vol > 0 THEN least(target / vol, 1) / top ELSE 0 END AS w FROM k),
h AS (SELECT *, CASE WHEN guarded AND off THEN 0 ELSE coalesce(last_value(CASE WHEN dayofweek(date) = 0 THEN w END IGNORE NULLS) OVER (PARTITION BY symbol, variant ORDER BY date ROWS UNBOUNDED PRECEDING), 0) END AS held FROM s),
p AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY symbol, variant ORDER BY date), 0) AS pos FROM h),
n AS (SELECT *, pos * coalesce(day, 0) - abs(coalesce(pos - lag(pos) OVER (PARTITION BY symbol, variant ORDER BY date), pos)) * 0.003 AS net FROM p),
f AS (SELECT date, variant, sum(net) AS net, sum(pos) AS pos FROM n GROUP BY 1, 2),
g AS (SELECT period, variant, date, net, pos, product(1 + net) OVER (PARTITION BY period, variant ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM f JOIN spans ON date >= a AND date < b),
dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY period, variant ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS down FROM g),
r AS (SELECT period, variant, count(*) AS days, avg(pos) AS exposure, pow(product(1 + net), 365.0 / count(*)) - 1 AS annual, avg(net) / nullif(stddev_samp(net), 0) * sqrt(365.0) AS sharpe, avg(net) / nullif(stddev_samp(net), 0) * sqrt(count(*)) AS t_stat, min(down) AS max_drawdown FROM dd GROUP BY 1, 2),
i AS (SELECT *, sum(CASE WHEN pos > 0 AND coalesce(before, 0) <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, variant ORDER BY date ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, lag(pos) OVER (PARTITION BY symbol, variant ORDER BY date) AS before FROM n)),
t AS (SELECT symbol, variant, seg, min(date) AS entry, product(1 + net) - 1 AS pnl FROM i WHERE pos > 0 GROUP BY 1, 2, 3),
u AS (SELECT period, variant, count(*) AS trades, avg((pnl > 0)::INT) AS hit_rate, coalesce(sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0), 'inf'::DOUBLE) AS profit_factor FROM t JOIN spans ON entry >= a AND entry < b GROUP BY 1, 2)"""


_SWEEP = "SELECT r.*, coalesce(trades, 0) AS trades, hit_rate, profit_factor, max_drawdown > -0.2 AS shallow FROM r LEFT JOIN u USING (period, variant)"
_SPEC = "period variant #days ~exposure ~annual ~sharpe ~t_stat ~max_drawdown #trades ~hit_rate ~profit_factor shallow"


def _swept(spark, d, variants) -> DataFrame:
    p = _prices(spark, d)
    low = (F.col("symbol") == "1-URGENT") & sc.holds(F.col("close") < ts.rolling(F.avg, "close", "symbol", "date", 200))
    r = sw.rotations(p.withColumn("low", low), variants, F.col("low"))
    return sw.accounts(r, variants, PERIODS).withColumn("shallow", F.col("max_drawdown") > -0.2)


@query("q_g2_sizes", _SPEC, _sweep_sql(SIZES), _SWEEP)
def q_g2_sizes(spark, d):
    """The guarded rotation at six target volatilities, judged in four periods."""
    return _swept(spark, d, SIZES)


@query("q_g_variants", _SPEC, _sweep_sql(VARIANTS), _SWEEP)
def q_g_variants(spark, d):
    """The rotation itself, over several horizons, guarded, and with two and three symbols."""
    return _swept(spark, d, VARIANTS)


WINDOWS = {"month": 30, "quarter": 91, "half": 182}
_BANDS = " UNION ALL ".join(f"""SELECT symbol, '{s}' AS span, measure, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, avg((value < -1e-12)::INT) AS negative
FROM (SELECT symbol, 'ret' AS measure, l / lag(l, {n}) OVER {SYM}) - 1 AS value FROM levels UNION ALL SELECT symbol, 'drawdown', CASE WHEN k >= {n} THEN list_min(list_transform(range(1, {n + 1}), lambda i: w{n}[i] / list_max(w{n}[1:i]) - 1)) END FROM levels) WHERE value IS NOT NULL GROUP BY 1, 3""" for s, n in WINDOWS.items())
LEVELS = PRICE + f""", lv AS (SELECT symbol, date, product(1 + coalesce(day, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS l, row_number() OVER {SYM}) AS k FROM price WHERE date >= DATE '1997-01-01'),
levels AS (SELECT *, {', '.join(f"list(l) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) AS w{n}" for n in WINDOWS.values())} FROM lv), b AS ({_BANDS})"""


def _bands(spark, d) -> DataFrame:
    p = _prices(spark, d).withColumn("day", ts.pct_change("close", "symbol", "date")).where("date >= DATE '1997-01-01'")
    return sw.bands(p, "symbol", "date", "day", WINDOWS, rows=256)


@query("m21_normality_bands", "symbol span measure ~p5 ~p25 ~p50 ~p75 ~p95 ~negative", LEVELS, "SELECT * FROM b")
def m21(spark, d):
    """Returns and deepest drawdowns of all windows of a month, a quarter and half a year since 1997."""
    return _bands(spark, d)


@query("m22_band_verdict", "symbol #days ~perf span ~p5 ~p95 verdict", LEVELS + ", live AS (SELECT symbol, count(*) AS days, product(1 + coalesce(day, 0)) - 1 AS perf FROM price WHERE date >= DATE '2001-05-01' AND (symbol < '4' OR date >= DATE '2001-07-10') GROUP BY 1)", "SELECT live.symbol, days, perf, s AS span, p5, p95, CASE WHEN perf < p5 THEN 'below' WHEN perf > p95 THEN 'above' ELSE 'inside' END AS verdict FROM (SELECT *, CASE WHEN days <= 30 THEN 'month' WHEN days <= 91 THEN 'quarter' ELSE 'half' END AS s FROM live) live LEFT JOIN b ON b.symbol = live.symbol AND span = s AND measure = 'ret'")
def m22(spark, d):
    """Where the last weeks' result stands in the bands of windows of its length."""
    p = _prices(spark, d).withColumn("day", ts.pct_change("close", "symbol", "date")).where("date >= DATE '2001-05-01' AND (symbol < '4' OR date >= DATE '2001-07-10')")
    live = p.groupBy("symbol").agg(F.count("*").alias("days"), (F.product(1 + F.coalesce("day", F.lit(0.0))) - 1).alias("perf"))
    return sw.band_verdict(live, _bands(spark, d), "symbol", "days", "perf", WINDOWS)


CUTS = ("1996-02-29", "1997-07-31", "1999-01-17", "2000-06-30", "2001-03-31")
REPLAY = PRICE + f""", cuts AS (SELECT unnest([{', '.join(f"DATE '{c}'" for c in CUTS)}, DATE '9999-01-01']) AS cut), seen AS (SELECT cut, symbol, date, close FROM price, cuts WHERE date <= cut),
both_ AS (SELECT 'honest' AS decider, * FROM seen UNION ALL SELECT 'peeking', cut, symbol, date, coalesce(lead(close) OVER (PARTITION BY cut, symbol ORDER BY date), close) FROM seen),
m AS (SELECT *, close / lag(close) OVER o - 1 AS day, close / lag(close, 30) OVER o - 1 AS mom FROM both_ WINDOW o AS (PARTITION BY decider, cut, symbol ORDER BY date)),
k AS (SELECT *, CASE WHEN count(day) OVER f = 30 THEN stddev_samp(day) OVER f * sqrt(365.0) END AS vol, row_number() OVER (PARTITION BY decider, cut, date ORDER BY mom DESC NULLS LAST, symbol) AS rank FROM m WINDOW f AS (PARTITION BY decider, cut, symbol ORDER BY date ROWS 29 PRECEDING)),
h AS (SELECT *, coalesce(last_value(CASE WHEN dayofweek(date) = 0 THEN CASE WHEN rank = 1 AND mom > 0 AND vol > 0 THEN least(0.4 / vol, 1) ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY decider, cut, symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS w FROM k),
x AS (SELECT a.decider, a.cut, a.date, bool_or(abs(a.w - b.w) > 1e-9) AS off FROM h a JOIN h b ON a.decider = b.decider AND a.symbol = b.symbol AND a.date = b.date AND b.cut = DATE '9999-01-01' AND a.cut < b.cut GROUP BY 1, 2, 3)"""


@query("m20_replay", "decider cut #days #different first", REPLAY, "SELECT decider, cut, count(*) AS days, count(*) FILTER (off) AS different, min(date) FILTER (off) AS first FROM x GROUP BY 1, 2")
def m20(spark, d):
    """The rotation's decisions replayed with the rows up to five days; and those of one that looks at the next day's price,
    whose cuts on Sundays give it away."""
    p = _prices(spark, d)
    cuts = spark.createDataFrame([(c,) for c in CUTS], "cut string")
    held = [F.col("symbol"), F.bround("h0", 9)]
    honest = lambda h: sw.rotations(h, [sw.Variant("G")], world="world")
    ahead = F.coalesce(F.lead("close").over(ts.by(["world", "symbol"], "date")), F.col("close"))
    runs = {"honest": honest, "peeking": lambda h: honest(h.withColumn("close", ahead))}
    out = [rp.replay(p, cuts, run, held).withColumn("decider", F.lit(name)) for name, run in runs.items()]
    return out[0].unionByName(out[1])
