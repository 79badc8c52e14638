"""One registered query per operator or pipeline, each with SQL that computes the same rows.

A query's columns are named by a spec: `~x` is a double rounded to 6 digits, `#x` a 64-bit integer, `x` as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import crosssec as cs
from ..operators import joins as jn
from ..operators import quantiles as qu
from ..operators import scoring as sc
from ..operators import stats as st
from ..operators import timeseries as ts
from ..shipping import ship
from ..sources import frames as fr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _shape(df: DataFrame, spec: str) -> DataFrame:
    kinds = {"~": lambda c: fr.rounded(F.col(c).cast("double"), 6).alias(c), "#": lambda c: F.col(c).cast("long").alias(c)}
    return df.select(*[kinds[c[0]](c[1:]) if c[0] in kinds else F.col(c) for c in spec.split()])


def query(name: str, spec: str, ctes: str = "", sql: str | None = None):
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return _shape(build(spark, sf_dir), spec)

        QUERIES[name] = run
        if sql:
            cols = ", ".join(f'round(CAST("{c[1:]}" AS DOUBLE), 6) AS "{c[1:]}"' if c[0] == "~" else f'CAST("{c[1:]}" AS BIGINT) AS "{c[1:]}"' if c[0] == "#" else f'"{c}"' for c in spec.split())
            ORACLES[name] = (f"WITH {ctes} " if ctes else "") + f"SELECT {cols} FROM ({sql})"
        return build

    return add


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.fill_days(fr.daily_close(spark, sf_dir))


SYM = "(PARTITION BY symbol ORDER BY date"

# ---- calendar and reshape


@query("c2_fill_calendar", "symbol date ~close trading", fr.FILLED, "SELECT * FROM filled")
def c2(spark, d):
    return _filled(spark, d)


HOURS = fr.BARS + """, hours AS (
  SELECT g.symbol, g.ts, b.open AS o, b.high AS h, b.low AS l, coalesce(b.volume, 0) AS volume, coalesce(b.taker, 0) AS taker,
         last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS close
  FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY symbol) g LEFT JOIN bars b USING (symbol, ts)),
filled_hours AS (SELECT symbol, ts, coalesce(o, close) AS open, coalesce(h, close) AS high, coalesce(l, close) AS low, close, volume, taker FROM hours)"""


@query("c1_fill_hours", "symbol ts ~open ~high ~low ~close ~volume ~taker", HOURS, "SELECT * FROM filled_hours")
def c1(spark, d):
    return ts.fill_hours(fr.bars_1h(spark, d))


@query("c6_month_end_offsets", "date me0 me1", "", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, last_day(CAST(o_orderdate AS DATE)) AS me0, CASE WHEN CAST(o_orderdate AS DATE) = last_day(CAST(o_orderdate AS DATE)) THEN last_day(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE)) ELSE last_day(CAST(o_orderdate AS DATE)) END AS me1 FROM orders")
def c6(spark, d):
    days = fr.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select("date", ts.month_end(F.col("date"), 0).alias("me0"), ts.month_end(F.col("date"), 1).alias("me1"))


@query("c7_gap_count", "symbol #gaps", fr.DAILY, f"SELECT symbol, count(*) FILTER (gap <> 1) AS gaps FROM (SELECT symbol, date - lag(date) OVER {SYM}) AS gap FROM daily) GROUP BY symbol")
def c7(spark, d):
    return ts.gaps(fr.daily_close(spark, d), "symbol", "date")


@query("a18_resample_week", "symbol week ~last ~high ~low ~mean #n", fr.DAILY, "SELECT symbol, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week, arg_max(close, date) AS last, max(close) AS high, min(close) AS low, avg(close) AS mean, count(close) AS n FROM daily GROUP BY 1, 2")
def a18(spark, d):
    return ts.resample(fr.daily_close(spark, d), "symbol", F.date_add(F.to_date(F.date_trunc("week", "date")), 6), "date", "close").withColumnRenamed("bucket", "week")


@query("a19_month_ends", "month last_date", fr.DAILY, "SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS last_date FROM daily GROUP BY 1")
def a19(spark, d):
    return fr.daily_close(spark, d).groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("last_date"))


# ---- windows


@query("w1_w4_lags_and_returns", "symbol date ~lag1 ~lead7 ~ret ~ret30 ~logret", fr.FILLED, f"SELECT symbol, date, lag(close) OVER w AS lag1, lead(close, 7) OVER w AS lead7, close / lag(close) OVER w - 1 AS ret, close / lag(close, 30) OVER w - 1 AS ret30, ln(close / lag(close) OVER w) AS logret FROM filled WINDOW w AS {SYM})")
def w1(spark, d):
    w = ts.by("symbol", "date")
    return _filled(spark, d).select("symbol", "date", F.lag("close").over(w).alias("lag1"), F.lead("close", 7).over(w).alias("lead7"), ts.pct_change("close", "symbol", "date").alias("ret"), ts.pct_change("close", "symbol", "date", 30).alias("ret30"), ts.log_return("close", "symbol", "date").alias("logret"))


_W = lambda n: f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_G = lambda agg, n, m: f"CASE WHEN count(close) OVER {_W(n)} >= {m} THEN {agg}(close) OVER {_W(n)} END"


@query("w5_w9_rolling_stats", "symbol date ~mean20 ~std30 ~std30m10 ~sum7 ~max20 ~min10 #n30", fr.FILLED, f"SELECT symbol, date, {_G('avg', 20, 20)} AS mean20, {_G('stddev_samp', 30, 30)} AS std30, {_G('stddev_samp', 30, 10)} AS std30m10, {_G('sum', 7, 7)} AS sum7, {_G('max', 20, 20)} AS max20, {_G('min', 10, 10)} AS min10, count(close) OVER {_W(30)} AS n30 FROM filled")
def w5(spark, d):
    r = lambda agg, n, m=None: ts.rolling(agg, "close", "symbol", "date", n, m)
    return _filled(spark, d).select("symbol", "date", r(F.avg, 20).alias("mean20"), r(F.stddev_samp, 30).alias("std30"), r(F.stddev_samp, 30, 10).alias("std30m10"), r(F.sum, 7).alias("sum7"), r(F.max, 20).alias("max20"), r(F.min, 10).alias("min10"), F.count("close").over(ts.last_n("symbol", "date", 30)).alias("n30"))


@query("w9_lagged_frame_max", "symbol date ~high20", fr.FILLED, "SELECT symbol, date, CASE WHEN count(close) OVER f = 20 THEN max(close) OVER f END AS high20 FROM filled WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def w9(spark, d):
    return _filled(spark, d).select("symbol", "date", ts.rolling(F.max, "close", "symbol", "date", 20, lag=1).alias("high20"))


@query("w10_rolling_quantile", "symbol date ~q90", fr.FILLED, f"SELECT symbol, date, CASE WHEN count(close) OVER {_W(60)} >= 30 THEN quantile_cont(close, 0.9) OVER {_W(60)} END AS q90 FROM filled")
def w10(spark, d):
    return qu.rolling_quantile(_filled(spark, d).select("symbol", "date", "close"), "symbol", "date", "close", 0.9, 60, 30, "q90", rows=1000)


@query("w11_rolling_diff_variance", "symbol date ~var24", fr.FILLED, f"SELECT symbol, date, CASE WHEN count(x) OVER f = 24 THEN var_samp(x) OVER f END AS var24 FROM (SELECT symbol, date, (close - lag(close) OVER {SYM})) / 1e5 AS x FROM filled) WINDOW f AS {_W(24)}")
def w11(spark, d):
    x = _filled(spark, d).withColumn("x", (F.col("close") - F.lag("close").over(ts.by("symbol", "date"))) / 1e5)
    return x.select("symbol", "date", ts.rolling(F.var_samp, "x", "symbol", "date", 24).alias("var24"))


@query("w13_expanding_median", "symbol date ~median", fr.DAILY, "SELECT symbol, date, CASE WHEN count(close) OVER w >= 12 THEN quantile_cont(close, 0.5) OVER w END AS median FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)")
def w13(spark, d):
    """Over all days: a symbol's years are cut into several chunks and blocks."""
    return qu.expanding_quantile(fr.daily_close(spark, d), "symbol", "date", "close", 0.5, 12, "median", rows=512)


RETS = fr.FILLED + f", rets AS (SELECT *, (close / lag(close) OVER {SYM}) - 1) / 1000 AS ret FROM filled)"


def _rets(spark, d):
    return _filled(spark, d).withColumn("ret", ts.pct_change("close", "symbol", "date") / 1000)


@query("w15_w16_equity_drawdown", "symbol date ~equity ~drawdown", RETS, "SELECT symbol, date, equity, equity / max(equity) OVER w - 1 AS drawdown FROM (SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM rets WHERE ret IS NOT NULL) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)")
def w15(spark, d):
    return ts.drawdown(_rets(spark, d).where("ret is not null"), "ret", "symbol", "date")


@query("w18_islands", "symbol #island #active first_date last_date #days", fr.FILLED, f"SELECT symbol, island, active, min(date) AS first_date, max(date) AS last_date, count(*) AS days FROM (SELECT *, sum(change) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN active = lag(active) OVER {SYM}) THEN 0 ELSE 1 END AS change FROM (SELECT symbol, date, trading::INT AS active FROM filled))) GROUP BY ALL")
def w18(spark, d):
    i = ts.islands(_filled(spark, d), F.col("trading"), "symbol", "date")
    return i.groupBy("symbol", "island", F.col("_active").alias("active")).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("days"))


@query("w21_first_rank", "date symbol #rank", fr.DAILY, "SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS rank FROM daily")
def w21(spark, d):
    return ts.first_rank(fr.daily_close(spark, d), "date", "close", "symbol")


@query("w22_average_and_pct_rank", "date ticker ~rank ~pct", fr.PANEL, "SELECT date, ticker, CASE WHEN fwd_ret IS NOT NULL THEN r END AS rank, CASE WHEN fwd_ret IS NOT NULL THEN r / n END AS pct FROM (SELECT *, rank() OVER (PARTITION BY date, fwd_ret IS NULL ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY date, fwd_ret) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY date, fwd_ret IS NULL) AS n FROM panel)")
def w22(spark, d):
    p = ts.average_rank(fr.panel(spark, d), "date", "fwd_ret")
    return ts.average_rank(p, "date", "fwd_ret", "pct", pct=True)


# ---- joins


@query("j1_inner_qualified", "s_suppkey n_name r_name", "", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0")
def j1(spark, d):
    t = lambda n: fr.table(spark, d, n)
    return t("supplier").where("s_acctbal > 0").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query("j2_left_chain", "c_custkey #orders #events ~value", "", "SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(events, 0) AS events, coalesce(value, 0) AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN (SELECT user_id, count(*) AS events, sum(value) AS value FROM events GROUP BY 1) ON c_custkey = user_id")
def j2(spark, d):
    t = lambda n: fr.table(spark, d, n)
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    e = t("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return t("customer").select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left").fillna(0, ["orders", "events", "value"])


PROBE = fr.FACTS + ", months AS (SELECT DISTINCT last_day(avail) AS month FROM facts), keys AS (SELECT DISTINCT key FROM facts), probe AS (SELECT key, month FROM keys CROSS JOIN months), best AS (SELECT key, avail, arg_max(value, ord) AS value FROM facts GROUP BY key, avail)"


def _months(facts):
    return facts.agg(F.sort_array(F.collect_set(F.last_day("avail"))))  # one array of a few dozen dates


def _probe(spark, d):
    f = fr.facts(spark, d)
    return f.select("key").distinct().select("key", F.explode(_months(f).scalar()).alias("month"))


@query("j7_asof_backward", "key month ~value", PROBE, "SELECT p.key, p.month, CASE WHEN p.month - b.avail <= 450 THEN b.value END AS value FROM probe p ASOF LEFT JOIN best b ON p.key = b.key AND p.month >= b.avail")
def j7(spark, d):
    f = fr.facts(spark, d)
    return jn.asof_dates(f, _months(f), "key", "month", "avail", "value", "ord", stale_days=450)


@query("j8_asof_year_earlier", "key month ~value", PROBE, "SELECT p.key, p.month, b.value FROM probe p ASOF LEFT JOIN best b ON p.key = b.key AND p.month - 365 >= b.avail")
def j8(spark, d):
    f = fr.facts(spark, d)
    return jn.asof_dates(f, _months(f), "key", "month", "avail", "value", "ord", lag_days=365)


@query("j10_previous_day", "symbol ts ~w", fr.BARS + ", days AS (SELECT symbol, CAST(ts AS DATE) AS date, max(high) / 400 AS w FROM bars GROUP BY 1, 2)", "SELECT b.symbol, b.ts, greatest(0, least(1, coalesce(d.w, 0))) AS w FROM bars b LEFT JOIN days d ON b.symbol = d.symbol AND CAST(b.ts AS DATE) = d.date + 1")
def j10(spark, d):
    b = fr.bars_1h(spark, d)
    days = b.groupBy("symbol", F.to_date("ts").alias("date")).agg((F.max("high") / 400).alias("w"))
    return jn.previous_day(b, days, "symbol", "ts", "date", "w")


@query("j12_interval_window", "key month #filings #owners ~value", PROBE + ", filings AS (SELECT o_custkey AS key, o_orderpriority AS owner, o_totalprice AS value, CAST(o_orderdate AS DATE) AS day FROM orders)", "SELECT p.key, p.month, count(*) AS filings, count(DISTINCT owner) AS owners, sum(value) AS value FROM probe p JOIN filings f ON p.key = f.key AND f.day <= p.month AND f.day > p.month - 90 GROUP BY 1, 2")
def j12(spark, d):
    f = fr.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("owner"), F.col("o_totalprice").alias("value"), F.to_date("o_orderdate").alias("day"))
    return jn.in_window(_probe(spark, d), f, "key", "month", "day", 90).groupBy("key", "month").agg(F.count("*").alias("filings"), F.count_distinct("owner").alias("owners"), F.sum("value").alias("value"))


@query("j13_product_of_later_ratios", "key ord ~factor", fr.FACTS + ", splits AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day, 1.1::DOUBLE AS ratio FROM orders WHERE o_orderstatus = 'P')", "SELECT f.key, f.ord, coalesce(product(s.ratio), 1) AS factor FROM facts f LEFT JOIN splits s ON f.key = s.key AND f.avail < s.day GROUP BY 1, 2")
def j13(spark, d):
    s = fr.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day"), F.lit(1.1).alias("ratio"))
    return jn.product_after(fr.facts(spark, d), s, "key", "avail", "day", "ratio")


@query("j14_semi", "c_custkey", "", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j14(spark, d):
    return fr.table(spark, d, "customer").join(fr.table(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("j15_anti", "c_custkey", "", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def j15(spark, d):
    return fr.table(spark, d, "customer").join(fr.table(spark, d, "orders").where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("j16_common_index", "symbol date ~close", fr.DAILY, "SELECT symbol, date, close FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM daily) WHERE n = 5")
def j16(spark, d):
    return jn.common_index(fr.daily_close(spark, d), "symbol", "date", 5)


@query("j17_full_outer", "date ~a ~b", fr.DAILY, "SELECT coalesce(x.date, y.date) AS date, x.close AS a, y.close AS b FROM (SELECT * FROM daily WHERE symbol = '1-URGENT') x FULL JOIN (SELECT * FROM daily WHERE symbol = '5-LOW') y ON x.date = y.date")
def j17(spark, d):
    c = fr.daily_close(spark, d)
    side = lambda s, n: c.where(F.col("symbol") == s).select("date", F.col("close").alias(n))
    return side("1-URGENT", "a").join(side("5-LOW", "b"), "date", "full")


@query("j18_coalesce_priority", "key ~value", "", "SELECT o_custkey AS key, arg_min(o_totalprice, (o_orderpriority, o_orderkey)) AS value FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def j18(spark, d):
    o = fr.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("value"), F.struct("o_orderpriority", "o_orderkey").alias("p"))
    return jn.coalesced(o, "key", "value", "p")


@query("j20_pair_correlation", "a b ~corr", RETS, "SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS corr FROM rets x JOIN rets y USING (date) WHERE x.symbol < y.symbol GROUP BY 1, 2")
def j20(spark, d):
    r = _rets(spark, d).select("symbol", "date", "ret")
    return r.select(F.col("symbol").alias("a"), "date", F.col("ret").alias("x")).join(r.select(F.col("symbol").alias("b"), "date", F.col("ret").alias("y")), "date").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


# ---- aggregates, sets, top-k


@query("a1_a2_sector_medians", "c_mktsegment ~median ~mean #n", "", "SELECT c_mktsegment, median(c_acctbal) AS median, avg(c_acctbal) AS mean, count(*) AS n FROM customer GROUP BY 1")
def a1(spark, d):
    return fr.table(spark, d, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", F.lit(0.5)).alias("median"), F.avg("c_acctbal").alias("mean"), F.count("*").alias("n"))


@query("a3_a5_owner_summary", "o_custkey #owners #urgent ~urgent_value has_open", "", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS owners, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, coalesce(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0) AS urgent_value, bool_or(o_orderstatus = 'O') AS has_open FROM orders GROUP BY 1")
def a3(spark, d):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return fr.table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("owners"), F.count_if(urgent).alias("urgent"), F.sum(F.when(urgent, F.col("o_totalprice")).otherwise(0.0)).alias("urgent_value"), F.bool_or(F.col("o_orderstatus") == "O").alias("has_open"))


@query("a6_compound_by_year", "symbol #year ~ret", RETS, "SELECT symbol, year(date) AS year, product(1 + ret) - 1 AS ret FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2")
def a6(spark, d):
    return _rets(spark, d).where("ret is not null").groupBy("symbol", F.year("date").alias("year")).agg(st.compounded("ret").alias("ret"))


@query("a11_quantile_bands", "symbol ~p5 ~p50 ~p95", RETS, "SELECT symbol, quantile_cont(ret, 0.05) AS p5, quantile_cont(ret, 0.5) AS p50, quantile_cont(ret, 0.95) AS p95 FROM rets GROUP BY 1")
def a11(spark, d):
    p = F.percentile("ret", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return _rets(spark, d).groupBy("symbol").agg(p.alias("p")).select("symbol", F.get("p", F.lit(0)).alias("p5"), F.get("p", F.lit(1)).alias("p50"), F.get("p", F.lit(2)).alias("p95"))


@query("a15_reliability_bins", "#bin #n ~forecast ~observed", "cal AS (SELECT least(1.0, n_chars / 5000.0) AS p, quality AS up FROM documents JOIN labels USING (doc_id))", "SELECT CASE WHEN p <= 0.4 THEN 1 WHEN p <= 0.45 THEN 2 WHEN p <= 0.5 THEN 3 WHEN p <= 0.55 THEN 4 WHEN p <= 0.6 THEN 5 ELSE 6 END AS bin, count(*) AS n, avg(p) AS forecast, avg(up) AS observed FROM cal WHERE p > 0 GROUP BY 1")
def a15(spark, d):
    c = fr.table(spark, d, "documents").select("doc_id", "n_chars").join(fr.table(spark, d, "labels"), "doc_id")
    return st.reliability(c.select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"), F.col("quality").alias("up")), "p", "up")


@query("a16_coverage", "event_type first last #n", "", "SELECT event_type, min(ts) AS first, max(ts) AS last, count(value) AS n FROM events GROUP BY 1")
def a16(spark, d):
    return fr.table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("value").alias("n"))


@query("a20_beta", "symbol ~beta", RETS + ", base AS (SELECT date, avg(ret) AS m FROM rets GROUP BY 1)", "SELECT symbol, covar_samp(ret, m) / var_samp(m) AS beta FROM rets JOIN base USING (date) WHERE ret IS NOT NULL GROUP BY 1")
def a20(spark, d):
    r = _rets(spark, d).where("ret is not null")
    return r.withColumn("m", F.avg("ret").over(W.partitionBy("date"))).groupBy("symbol").agg((F.covar_samp("ret", "m") / F.var_samp("m")).alias("beta"))


@query("a22_zscore", "c_custkey ~zscore", "", "SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS zscore FROM customer")
def a22(spark, d):
    return sc.zscore(fr.table(spark, d, "customer"), "c_acctbal")


@query("a25_window_return", "symbol ~ret_pct", fr.DAILY, "SELECT symbol, (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 AS ret_pct FROM daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1 HAVING count(close) >= 2")
def a25(spark, d):
    c = fr.daily_close(spark, d).where("date between date'1996-01-01' and date'1996-12-31'").groupBy("symbol")
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    return c.agg(((last - first) / first * 100).alias("ret_pct"), F.count("close").alias("n")).where("n >= 2")


@query("t1_top_k", "c_custkey ~c_acctbal", "", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def t1(spark, d):
    return sc.top_k(fr.table(spark, d, "customer"), 20, "c_acctbal", "c_custkey")


@query("t2_top_fraction", "date ticker ~revenue", fr.PANEL, "SELECT date, ticker, revenue FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY revenue DESC, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM panel) WHERE r <= greatest(1, floor(n * 0.1))")
def t2(spark, d):
    return cs.top_fraction(fr.panel(spark, d), "date", "revenue", "ticker")


@query("t4_nearest_to_target", "o_custkey ~o_totalprice", "", "SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(age - 90), age, o_orderkey) AS r FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS age FROM orders) WHERE abs(age - 90) <= 20) WHERE r = 1")
def t4(spark, d):
    o = fr.table(spark, d, "orders").withColumn("age", F.date_diff(F.lit("1998-01-01").cast("date"), F.to_date("o_orderdate")))
    return sc.nearest(o, ["o_custkey"], "age", "o_totalprice", 90, 20, "o_orderkey")


@query("u1_u2_union_first_wins", "key ~value", "", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, value) AS r FROM (SELECT c_nationkey AS key, c_acctbal AS value, 1 AS src FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, s_acctbal, 2 FROM supplier)) WHERE r = 1")
def u1(spark, d):
    a = fr.table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit(1).alias("src"))
    b = fr.table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_acctbal").alias("value"), F.lit(2).alias("src"))
    return jn.first_of(a.unionByName(b), ["key"], "src", "value")


# ---- filters and scores


@query("f5_valuation_rule", "p_partkey valued", "f AS (SELECT p_partkey, p_brand AS sector, p_size / 10.0 AS peg, p_retailprice AS pe FROM part), m AS (SELECT sector, median(pe) AS med FROM f GROUP BY 1)", "SELECT p_partkey, coalesce(peg > 0 AND peg <= 2, false) OR coalesce(med <> 0 AND pe <= 1.5 * med, false) AS valued FROM f JOIN m USING (sector)")
def f5(spark, d):
    p = fr.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("sector"), (F.col("p_size") / 10.0).alias("peg"), F.col("p_retailprice").alias("pe"))
    return sc.pe_rule(p, "sector", "peg", "pe")


@query("f11_sundays", "symbol date ~close", fr.FILLED, "SELECT symbol, date, close FROM filled WHERE dayofweek(date) = 0")
def f11(spark, d):
    return _filled(spark, d).where(F.dayofweek("date") == 1)


@query("f14_token_match", "doc_id hit", "", "SELECT doc_id, contains(' ' || upper(text) || ' ', ' THE ') AS hit FROM documents")
def f14(spark, d):
    return fr.table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), F.upper("text"), F.lit(" ")).contains(" THE ").alias("hit"))


@query("p1_points_and_class", "c_custkey ~score grade", "", "SELECT c_custkey, score, CASE WHEN score >= 8 THEN 'high' WHEN score >= 6 THEN 'good' WHEN score >= 5 THEN 'fair' ELSE 'low' END AS grade FROM (SELECT c_custkey, least(10, (c_acctbal > 0)::INT * 2 + (c_acctbal > 3000)::INT * 2 + (c_acctbal > 6000)::INT * 3 + (c_mktsegment = 'BUILDING')::INT * 1 + (c_nationkey < 10)::INT * 2) AS score FROM customer)")
def p1(spark, d):
    c = F.col("c_acctbal")
    score = sc.points((c > 0, 2), (c > 3000, 2), (c > 6000, 3), (F.col("c_mktsegment") == "BUILDING", 1), (F.col("c_nationkey") < 10, 2))
    return fr.table(spark, d, "customer").select("c_custkey", score.alias("score")).withColumn("grade", sc.class_of(F.col("score")))


@query("p2_closeness", "p_partkey ~close", "", "SELECT p_partkey, CASE WHEN x BETWEEN 0.3 AND 0.5 THEN greatest(0, 1 - abs(x - 0.4) / 0.1) ELSE 0 END AS close FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part)")
def p2(spark, d):
    return fr.table(spark, d, "part").select("p_partkey", sc.closeness(F.col("p_size") / 50.0).alias("close"))


@query("x_cagr_and_falls", "key ~growth #falls", "y AS (SELECT o_custkey AS key, year(o_orderdate) AS year, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), l AS (SELECT *, (v < lag(v) OVER (PARTITION BY key ORDER BY year))::INT AS fall FROM y)", "SELECT key, CASE WHEN count(*) >= 4 THEN pow(arg_max(v, year) / arg_min(v, year), 1.0 / (count(*) - 1)) - 1 END AS growth, coalesce(sum(fall), 0) AS falls FROM l GROUP BY 1")
def x_cagr(spark, d):
    y = fr.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    l = y.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("year", "v"))), lambda x: x["v"]).alias("v"))
    growth, falls = sc.cagr(F.col("v"))
    return l.select("key", growth.alias("growth"), falls.alias("falls"))


@query("s17_json_series", "event_id #k", "", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s17(spark, d):
    return fr.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- evaluation


@query("m1_metrics", "symbol #days ~total ~annual ~sharpe ~t_stat ~max_drawdown ~active_days", RETS + ", e AS (SELECT symbol, ret, product(1 + ret) OVER w AS eq FROM rets WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)), q AS (SELECT symbol, date, ret, product(1 + ret) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM rets WHERE ret IS NOT NULL), dd AS (SELECT symbol, ret, eq / max(eq) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM q)", "SELECT symbol, count(*) AS days, product(1 + ret) - 1 AS total, pow(product(1 + ret), 365.0 / count(*)) - 1 AS annual, avg(ret) / stddev_samp(ret) * sqrt(365.0) AS sharpe, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t_stat, min(dd) AS max_drawdown, avg((ret <> 0)::INT) AS active_days FROM dd GROUP BY 1")
def m1(spark, d):
    return st.metrics(_rets(spark, d).where("ret is not null"), "symbol", "date", "ret")


@query("m5_strategy_returns", "symbol date ~net", RETS, f"SELECT symbol, date, pos * ret - coalesce(abs(pos - lag(pos) OVER {SYM})), abs(pos)) * 0.003 AS net FROM (SELECT *, CASE WHEN dayofweek(date) IN (1, 2) THEN 0.5 ELSE 1 END AS pos FROM rets)")
def m5(spark, d):
    r = _rets(spark, d).withColumn("pos", F.when(F.dayofweek("date").isin(2, 3), 0.5).otherwise(1.0))
    return st.strategy_returns(r, "symbol", "date", "pos", "ret", 0.003)


RANKS = fr.PANEL + """, ok AS (SELECT * FROM panel WHERE revenue IS NOT NULL AND fwd_ret IS NOT NULL),
r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY revenue) + (count(*) OVER (PARTITION BY date, revenue) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY date ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY date, fwd_ret) - 1) / 2.0 AS ry FROM ok),
ic AS (SELECT date, count(*) AS n, corr(rx, ry) AS ic FROM r GROUP BY 1)"""


@query("m12_ic_masked", "date #n ~ic ~t", RANKS, "SELECT date, n, ic, ic * sqrt((n - 2) / nullif(1 - ic * ic, 0)) AS t FROM ic WHERE n >= 20")
def m12(spark, d):
    return cs.ic_masked(fr.panel(spark, d), "date", "revenue", "fwd_ret")


@query("m13_ic_ranked_first", "date #n ~ic", fr.PANEL + """, r AS (SELECT date, fwd_ret, rank() OVER (PARTITION BY date ORDER BY revenue) + (count(*) OVER (PARTITION BY date, revenue) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY date, fwd_ret IS NULL ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY date, fwd_ret) - 1) / 2.0 AS ry FROM panel)""", "SELECT date, count(*) AS n, corr(rx, ry) AS ic FROM r WHERE fwd_ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 30")
def m13(spark, d):
    return cs.ic_ranked_first(fr.panel(spark, d), "date", "revenue", "fwd_ret")


@query("o13_turnover", "date ~turnover", fr.PANEL + ", picks AS (SELECT date, ticker FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY revenue DESC, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM panel) WHERE r <= greatest(1, floor(n * 0.1))), k AS (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM picks)", "SELECT a.date, avg(CASE WHEN b.ticker IS NULL THEN 1.0 ELSE 0.0 END) AS turnover FROM k a LEFT JOIN k b ON a.ticker = b.ticker AND a.k = b.k + 1 GROUP BY 1")
def o13(spark, d):
    return cs.turnover(cs.top_fraction(fr.panel(spark, d), "date", "revenue", "ticker"), "date", "ticker")


@query("m16_yearly_weights", "#year #months ~weight", RANKS, "SELECT y.year, count(*) AS months, avg(ic) AS weight FROM (SELECT unnest(range(min(year(date)), max(year(date)) + 2)) AS year FROM ic WHERE n >= 20) y JOIN ic ON year(last_day(ic.date + INTERVAL 1 MONTH)) < y.year AND ic.n >= 20 GROUP BY 1 HAVING count(*) >= 24")
def m16(spark, d):
    ic = cs.ic_masked(fr.panel(spark, d), "date", "revenue", "fwd_ret").withColumn("all", F.lit(1))
    return cs.expanding_mean_by_year(ic, "date", ["all"], "ic")


# ---- momentum rotation, end to end

ROTATION = RETS + f""", mom AS (SELECT symbol, date, close / lag(close) OVER {SYM}) - 1 AS day, close / lag(close, 30) OVER {SYM}) - 1 AS mom FROM filled),
vol AS (SELECT *, CASE WHEN count(day) OVER {_W(30)} = 30 THEN stddev_samp(day) OVER {_W(30)} * sqrt(365.0) END AS vol FROM mom),
picked AS (SELECT symbol, date, day, CASE WHEN mom > 0 AND vol > 0 AND mom IS NOT NULL AND row_number() OVER (PARTITION BY date, mom IS NULL ORDER BY mom DESC, symbol) <= 2 THEN least(0.4 / vol, 1) / 2 ELSE 0 END AS w FROM vol),
held AS (SELECT symbol, date, day, coalesce(last_value(CASE WHEN dayofweek(date) = 0 THEN w END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS w FROM picked),
lagged AS (SELECT *, coalesce(lag(w) OVER {SYM}), 0) AS pos FROM held)"""


def rotation(daily: DataFrame, lookback: int = 30, top: int = 2, target: float = 0.4) -> DataFrame:
    """symbol, date, day (return), pos: weekly weights of the `top` symbols by momentum, scaled to a target volatility,
    held from Sunday on and applied a day later."""
    from ..operators.stateful import weekly_hold

    w = ts.by("symbol", "date")
    d = daily.withColumns({"day": ts.pct_change("close", "symbol", "date"), "mom": ts.pct_change("close", "symbol", "date", lookback)})
    d = d.withColumn("vol", ts.rolling(F.stddev_samp, "day", "symbol", "date", 30) * F.sqrt(F.lit(365.0)))
    d = ts.first_rank(d, "date", "mom", "symbol")
    ok = sc.holds((F.col("rank") <= top) & (F.col("mom") > 0) & (F.col("vol") > 0))
    d = d.withColumn("w", F.when(ok, F.least(target / F.col("vol"), F.lit(1.0)) / top).otherwise(0.0))
    d = weekly_hold(d, "symbol", "date", "w")
    return d.withColumn("pos", F.coalesce(F.lag("w").over(w), F.lit(0.0)))


def portfolio_returns(positions: DataFrame, fee: float = 0.003) -> DataFrame:
    """date, ret: positions times returns less the fee on turnover, summed over symbols."""
    r = st.strategy_returns(positions.withColumn("day", F.coalesce("day", F.lit(0.0))), "symbol", "date", "pos", "day", fee, "ret")
    return r.groupBy("date").agg(F.sum("ret").alias("ret"))


@query("q_g_rotation", "date ~ret", ROTATION, f"SELECT date, sum(pos * coalesce(day, 0) - turn * 0.003) AS ret FROM (SELECT *, coalesce(abs(pos - lag(pos) OVER {SYM})), abs(pos)) AS turn FROM lagged) GROUP BY 1")
def q_g(spark, d):
    return portfolio_returns(rotation(_filled(spark, d)))


@query("q_snap_features", "symbol ts ~ret_1h ~ret_24h ~vol_24h ~taker_24h ~breakout", HOURS + ", x AS (SELECT *, ln(nullif(close / nullif(lag(close) OVER w, 0), 0)) AS r1, ln(nullif(close / nullif(lag(close, 24) OVER w, 0), 0)) AS r24 FROM filled_hours WINDOW w AS (PARTITION BY symbol ORDER BY ts))", "SELECT symbol, ts + INTERVAL 1 HOUR AS ts, r1 AS ret_1h, r24 AS ret_24h, CASE WHEN count(r1) OVER f = 24 THEN stddev_samp(r1) OVER f * sqrt(8760.0) END AS vol_24h, CASE WHEN count(*) OVER f = 24 THEN sum(taker) OVER f / nullif(sum(volume) OVER f, 0) END AS taker_24h, CASE WHEN count(high) OVER g = 12 THEN close / nullif(max(high) OVER g, 0) - 1 END AS breakout FROM x WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), g AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")
def q_snap(spark, d):
    b = ts.fill_hours(fr.bars_1h(spark, d))
    k = ("symbol", "ts")
    b = b.withColumns({"ret_1h": ts.log_return("close", *k), "ret_24h": ts.log_return("close", *k, 24)})
    b = b.withColumns(
        {
            "vol_24h": ts.rolling(F.stddev_samp, "ret_1h", *k, 24) * F.sqrt(F.lit(8760.0)),
            "taker_24h": F.try_divide(ts.rolling(F.sum, "taker", *k, 24), ts.rolling(F.sum, "volume", *k, 24)),
            "breakout": F.try_divide(F.col("close"), ts.rolling(F.max, "high", *k, 12, lag=1)) - 1,
        }
    )
    return b.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
