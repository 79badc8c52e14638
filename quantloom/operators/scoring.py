"""Scores, hard filters and top-k rules of the screener as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """The condition, false where a value is missing."""
    return F.coalesce(condition, F.lit(False))


def closeness(x: Column, centre: float = 0.4, width: float = 0.1, low: float = 0.3, high: float = 0.5) -> Column:
    """1 at the centre falling to 0 at `width` away, counted only within low..high."""
    return F.when(holds((x >= low) & (x <= high)), F.greatest(F.lit(0.0), 1 - F.abs(x - centre) / width)).otherwise(0.0)


def points(*rules: tuple[Column, float], cap: float = 10.0) -> Column:
    """Sum of the points of the rules that hold, capped."""
    total = F.lit(0.0)
    for condition, value in rules:
        total = total + F.when(holds(condition), F.lit(float(value))).otherwise(0.0)
    return F.least(total, F.lit(cap))


def pe_rule(df: DataFrame, sector: str, peg: str, pe: str, most_peg: float = 2.0, ratio: float = 1.5) -> DataFrame:
    """valued: 0 < peg <= 2, or where there is no such peg a pe of at most 1.5 times the sector's median."""
    medians = df.where(F.col(sector).isNotNull()).groupBy(sector).agg(F.percentile(pe, F.lit(0.5)).alias("_median"))
    d = df.join(medians, sector, "left")
    by_peg = (F.col(peg) > 0) & (F.col(peg) <= most_peg)
    by_pe = (F.col("_median") != 0) & (F.col(pe) <= ratio * F.col("_median"))
    return d.withColumn("valued", holds(by_peg) | holds(by_pe)).drop("_median")


def cagr(values: Column) -> tuple[Column, Column]:
    """Growth a year over an array's non-null values (four at least, first and last positive), and how often they fall."""
    v = F.filter(values, lambda x: x.isNotNull())
    n = F.size(v)
    first, last = F.get(v, F.lit(0)), F.get(v, n - 1)
    growth = F.when((n >= 4) & (first > 0) & (last > 0), F.pow(last / first, 1 / (n - 1).cast("double")) - 1)
    falls = F.size(F.filter(F.zip_with(v, F.slice(v, 2, F.greatest(n, F.lit(1))), lambda a, b: b < a), lambda x: x))
    return growth, falls


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k largest; earlier ties first, missing values never."""
    return df.where(F.col(by).isNotNull()).orderBy(F.desc(by), tie).limit(k)


def zscore(df: DataFrame, value: str, name: str = "zscore") -> DataFrame:
    """(value - mean) / std over all rows; 0 where all are equal. Mean and std come as one row to every task."""
    s = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(F.broadcast(s)).withColumn(name, F.when(F.col("_s") == 0, 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def class_of(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 6, "good").when(score >= 5, "fair").otherwise("low")


def nearest(df: DataFrame, keys: list[str], age: str, value: str, target: float, within: float, tie: str | None = None) -> DataFrame:
    """The value whose age is nearest to the target, at most `within` away; of equally near ones the smaller age, then the smaller `tie`."""
    d = df.withColumn("_d", F.abs(F.col(age) - target)).where(F.col("_d") <= within)
    w = W.partitionBy(*keys).orderBy("_d", age, *([tie] if tie else []))
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, value)


#: Least growth of revenue and earnings a year, net margin, return on equity and on assets, current ratio; most net debt to EBITDA and falls. Fixed values.
LEAST_REVENUE, LEAST_EARNINGS, LEAST_MARGIN, LEAST_ROE, LEAST_ROA, LEAST_CURRENT = 0.08, 0.10, 0.10, 0.15, 0.07, 1.0
MOST_DEBT, MOST_FALLS = 3.0, 1


def hard_filter(df: DataFrame) -> DataFrame:
    """checks (how many of the eight rules hold) and fundamental_pass (all do) from revenue_cagr, revenue_falls, eps_cagr, eps_falls, profit_margin,
    roe, roa, ev, mktcap, ebitda, current_ratio and valued (see pe_rule); a missing value fails its rule, missing falls are none."""
    debt = F.when(F.col("ebitda") != 0, (F.col("ev") - F.col("mktcap")) / F.col("ebitda"))
    few = lambda c: F.coalesce(c, F.lit(0)) <= MOST_FALLS
    rules = [
        (F.col("revenue_cagr") >= LEAST_REVENUE) & few("revenue_falls"),
        (F.col("eps_cagr") >= LEAST_EARNINGS) & few("eps_falls"),
        F.col("profit_margin") >= LEAST_MARGIN,
        F.col("roe") >= LEAST_ROE,
        F.col("roa") >= LEAST_ROA,
        debt <= MOST_DEBT,
        F.col("current_ratio") >= LEAST_CURRENT,
        F.col("valued"),
    ]
    held = sum((holds(r).cast("int") for r in rules[1:]), holds(rules[0]).cast("int"))
    return df.withColumn("checks", held).withColumn("fundamental_pass", F.col("checks") == len(rules))


def fundamental_points(df: DataFrame) -> Column:
    """2 for each growth, 2 for the return on equity, 1 for that on assets, 1 for the margin, 2 for the valuation; 10 at most."""
    return points((F.col("revenue_cagr") >= LEAST_REVENUE, 2), (F.col("eps_cagr") >= LEAST_EARNINGS, 2), (F.col("roe") >= LEAST_ROE, 2), (F.col("roa") >= LEAST_ROA, 1), (F.col("profit_margin") >= LEAST_MARGIN, 1), (F.col("valued"), 2))


def insider_signals(trades: DataFrame, key: str, today: Column, cluster_days: int = 30, net_days: int = 90) -> DataFrame:
    """key, buys, amount, cluster_buy, senior_buy, net (signed amounts of the last net_days), score from trades with
    day, code, owner, title, amount, signed. Only purchases (code P) score; without one all but net is 0."""
    buy = F.col("code") == "P"
    recent = buy & (F.col("day") >= F.date_sub(today, cluster_days))
    senior = F.lower("title").rlike("ceo|cfo|president|chief|chairman|director")
    a = trades.groupBy(key).agg(
        F.count_if(buy).alias("buys"),
        F.coalesce(F.sum(F.when(buy, F.col("amount"))), F.lit(0.0)).alias("amount"),
        F.coalesce(F.bool_or(buy & senior), F.lit(False)).alias("senior_buy"),
        (F.count_distinct(F.when(recent, F.col("owner"))) >= 2).alias("cluster_buy"),
        F.coalesce(F.sum(F.when(F.col("day") >= F.date_sub(today, net_days), F.col("signed"))), F.lit(0.0)).alias("net"),
    )
    score = points((F.col("buys") >= 1, 1), (F.col("buys") >= 3, 1), (F.col("amount") >= 100000, 1), (F.col("amount") >= 500000, 1), (F.col("senior_buy"), 2), (F.col("cluster_buy"), 3))
    return a.withColumn("score", score)


def short_points(share: Column, ratio: Column) -> Column:
    """2 from a short share of 10 % on, 1 more from 20 % on, 2 from 5 days to cover on; 5 at most."""
    return points((share >= 10, 2), (share >= 20, 1), (ratio >= 5, 2), cap=5.0)


def final_score(df: DataFrame) -> Column:
    """0 unless the hard filter and a daily or weekly pattern hold; else 5, closeness of the retracement to 40 %, half a point for each strong
    growth and one for insiders and for institutions, 10 at most, rounded half to even."""
    near = F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.col("retracement") - 0.40) / 0.10), F.lit(0.0))
    total = F.lit(5.0) + near + points((F.col("revenue_cagr") >= 0.16, 0.5), (F.col("eps_cagr") >= 0.20, 0.5), (F.col("insider_net_positive"), 1), (F.col("institutional_trend"), 1))
    ok = holds(F.col("fundamental_pass")) & (holds(F.col("pattern_daily")) | holds(F.col("pattern_weekly")))
    return F.when(ok, F.bround(F.least(total, F.lit(10.0)), 1)).otherwise(0.0)


def cap_bucket(mktcap: Column, large: float = 10e9) -> Column:
    return F.when(holds(mktcap > large), "large").otherwise("mid")


def ic_label(ic: Column, p: Column) -> Column:
    """Strong from 0.1 on if significant, weak if just significant, else none."""
    return F.when(holds((F.abs(ic) >= 0.1) & (p < 0.05)), "strong").when(holds(p < 0.05), "weak").otherwise("none")


def mast_and_flag(closes: DataFrame, key: str, ts: str, close: str, least: int, most: int, rally: float = 1.0, low: float = 0.30, high: float = 0.50, tight: float = 0.20) -> DataFrame:
    """key, mast_rally, retracement, consolidation, pattern of each key's closes in order.

    The mast rises from the lowest close before the first highest close to it; the flag begins at the first later
    close that is `low` under the peak. A pattern needs a rally of `rally`, a last close within low..high under
    the peak, `least` to `most` closes of flag and a range of `tight` in its last `least` ones. Keys with fewer
    than least + 20 closes or a peak among the first 5 are left out. One sort per key.
    """
    d = closes.where(F.col(close).isNotNull())
    own, seq = W.partitionBy(key), W.partitionBy(key).orderBy(ts)
    d = d.withColumns({"_k": F.row_number().over(seq) - 1, "_n": F.count("*").over(own)})
    d = d.withColumn("_top", F.max(F.struct(F.col(close).alias("c"), (-F.col("_k")).alias("k"))).over(own))
    d = d.withColumns({"_peak": F.col("_top.c"), "_at": -F.col("_top.k")}).where((F.col("_n") >= least + 20) & (F.col("_at") >= 5))
    after = F.col("_k") >= F.col("_at")
    d = d.withColumn("_flag", F.min(F.when(after & ((F.col("_peak") - F.col(close)) / F.col("_peak") >= low), F.col("_k"))).over(own))
    tail = F.col("_k") >= F.greatest(F.col("_flag"), F.col("_n") - least)
    a = d.groupBy(key).agg(
        F.first("_peak").alias("peak"), F.first("_n").alias("n"), F.first("_at").alias("at"), F.first("_flag").alias("flag"),
        F.min(F.when(F.col("_k") < F.col("_at"), F.col(close))).alias("low"),
        F.max(F.when(F.col("_k") == F.col("_n") - 1, F.col(close))).alias("last"),
        F.max(F.when(tail, F.col(close))).alias("hi"), F.min(F.when(tail, F.col(close))).alias("lo"),
    ).where("low > 0")
    mast, back, n = F.col("peak") / F.col("low") - 1, (F.col("peak") - F.col("last")) / F.col("peak"), F.col("n") - 1 - F.col("flag")
    long = (mast >= rally) & (F.col("n") - F.col("at") >= least)
    found = back.between(low, high) & n.between(least, most) & (F.col("lo") > 0) & ((F.col("hi") - F.col("lo")) / F.col("lo") <= tight)
    return a.select(key, F.bround(mast, 3).alias("mast_rally"), F.when(long, F.bround(back, 3)).alias("retracement"), F.when(long, n).alias("consolidation"), holds(long & found).alias("pattern"))


def trade_side(text: Column) -> Column:
    """1 for a purchase, -1 for a sale, else 0, from free text in any case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("purchase") | (F.btrim(t) == "buy"), 1).when(t.contains("sale") | t.contains("sell"), -1).otherwise(0)
