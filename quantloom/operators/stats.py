"""Evaluation of return series and trade lists, all strategies in one grouped job."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .special import share_p
from .timeseries import by, drawdown, upto

DAYS = 365


def compounded(ret: str) -> Column:
    return F.product(1 + F.col(ret)) - 1


def daily_returns(df: DataFrame, key: str, ts: str, ret: str) -> DataFrame:
    return df.groupBy(key, F.to_date(ts).alias("date")).agg(compounded(ret).alias("ret"))


def metrics(df: DataFrame, key: str, ts: str, ret: str) -> DataFrame:
    """days, total, annual, sharpe, t_stat, max_drawdown, hit_days of each key's daily returns."""
    d = drawdown(df, ret, key, ts)
    m = d.groupBy(key).agg(F.count(ret).alias("days"), compounded(ret).alias("total"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col(ret) != 0).cast("double")).alias("active_days"))
    ok = F.col("_s") > 0
    return m.select(
        key,
        "days",
        "total",
        F.when(F.col("total") > -1, F.pow(1 + F.col("total"), F.try_divide(F.lit(float(DAYS)), F.col("days"))) - 1).alias("annual"),
        F.when(ok, F.col("_m") / F.col("_s") * F.sqrt(F.lit(float(DAYS)))).alias("sharpe"),
        F.when(ok, F.col("_m") / (F.col("_s") / F.sqrt("days"))).alias("t_stat"),
        "max_drawdown",
        "active_days",
    )


def strategy_returns(df: DataFrame, key: str, ts: str, position: str, ret: str, fee: float, name: str = "net") -> DataFrame:
    """position * ret less the fee on turnover; the first row's turnover is its whole position."""
    turn = F.coalesce(F.abs(F.col(position) - F.lag(position).over(by(key, ts))), F.abs(position))
    return df.withColumn(name, F.col(position) * F.col(ret) - turn * fee)


def t_threshold(tests: int, base: float = 2.0) -> float:
    """The t value that keeps the family-wise error of `tests` tests at that of one at `base`."""
    n = NormalDist()
    return n.inv_cdf(1 - (1 - n.cdf(base)) / max(1, tests))


def hit_rate(trades: DataFrame, key: str, pnl: str) -> DataFrame:
    """trades and the share of them with a gain, of each key."""
    return trades.groupBy(key).agg(F.count("*").alias("trades"), F.avg((F.col(pnl) > 0).cast("double")).alias("hit_rate"))


def gate(m: DataFrame, tests: int, sharpe: float = 1.5, worst: float = -0.15, hits: float = 0.55) -> DataFrame:
    """Whether each row of metrics with hit_rate passes; a missing value fails."""
    ok = (F.col("sharpe") > sharpe) & (F.col("max_drawdown") > worst) & (F.col("hit_rate") > hits) & (F.col("t_stat") > t_threshold(tests))
    return m.withColumn("passes", F.coalesce(ok, F.lit(False)))


def gate_v2(m: DataFrame, tests: int, sharpe: float = 1.5, worst: float = -0.20, factor: float = 1.5) -> DataFrame:
    """As gate, by profit_factor instead of hit_rate and with a deeper drawdown allowed."""
    ok = (F.col("sharpe") > sharpe) & (F.col("max_drawdown") > worst) & (F.col("profit_factor") > factor) & (F.col("t_stat") > t_threshold(tests))
    return m.withColumn("passes_v2", F.coalesce(ok, F.lit(False)))


def profit_factor(trades: DataFrame, key: str, pnl: str) -> DataFrame:
    """Gains over losses of each key; infinite without a loss."""
    gains, losses = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0)), F.sum(F.when(F.col(pnl) < 0, -F.col(pnl)).otherwise(0.0))
    return trades.groupBy(key).agg(F.count("*").alias("trades"), F.coalesce(F.try_divide(gains, losses), F.lit(float("inf"))).alias("profit_factor"))


def reliability(df: DataFrame, p: str, up: str, edges: tuple[float, ...] = (0.0, 0.4, 0.45, 0.5, 0.55, 0.6, 1.0)) -> DataFrame:
    """n, mean forecast and observed share of each right-closed bin that has rows."""
    bin_ = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        bin_ = F.when((F.col(p) > edges[k - 1]) & (F.col(p) <= edges[k]), k).otherwise(bin_)
    return df.withColumn("bin", bin_).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("forecast"), F.avg(F.col(up).cast("double")).alias("observed"))


def monthly_stats(df: DataFrame, key: str, ts: str, ret: str) -> DataFrame:
    """months, annual, sharpe, t_stat, max_drawdown and share of positive months of each key's monthly returns."""
    d = drawdown(df.where(F.col(ret).isNotNull()), ret, key, ts)
    m, sd, n = F.avg(ret), F.stddev_samp(ret), F.count(ret)
    return d.groupBy(key).agg(
        n.alias("months"),
        (F.pow(F.product(1 + F.col(ret)), 12.0 / n) - 1).alias("annual"),
        F.when(sd > 0, m / sd * F.sqrt(F.lit(12.0))).alias("sharpe"),
        F.when(sd > 0, m / sd * F.sqrt(n)).alias("t_stat"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col(ret) > 0).cast("double")).alias("positive"),
    )


def performance(df: DataFrame, key: str, ts: str, position: str, ret: str, fee: float, periods: float = DAYS) -> DataFrame:
    """Of each key's positions: active rows, share of them in the right direction, gross and net return, net Sharpe, volatility, deepest
    drawdown, trades (rows on which the position changes, the first one included if it isn't 0), mean exposure and turnover a year."""
    d = df.withColumns({"_p": F.coalesce(F.col(position), F.lit(0.0)), "_r": F.col(ret)})
    d = strategy_returns(d, key, ts, "_p", "_r", fee, "_net")
    change = F.coalesce(F.col("_p") - F.lag("_p").over(by(key, ts)), F.col("_p"))
    d = drawdown(d.withColumn("_c", change), "_net", key, ts)
    active, sd, n = F.col("_p") != 0, F.stddev_samp("_net"), F.count("*")
    return d.groupBy(key).agg(
        F.count_if(active).alias("active"),
        F.try_divide(F.count_if(active & (F.signum("_p") == F.signum("_r"))), F.count_if(active)).alias("hit_rate"),
        (F.product(1 + F.col("_p") * F.col("_r")) - 1).alias("gross"),
        compounded("_net").alias("net"),
        F.when(sd > 0, F.avg("_net") / sd * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        (sd * F.sqrt(F.lit(float(periods)))).alias("volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.count_if(F.col("_c") != 0).alias("trades"),
        F.avg(F.abs("_p")).alias("exposure"),
        (F.sum(F.abs("_c")) * periods / n).alias("turnover"),
    )


def calibration(df: DataFrame, key: str, p: str, ret: str) -> DataFrame:
    """n, share of rises, mean forecast, Brier scores of the forecast and of the constant share, correlation of forecast and return."""
    d = df.where(F.col(p).isNotNull() & F.col(ret).isNotNull()).withColumn("_up", (F.col(ret) > 0).cast("double"))
    up = F.avg("_up")
    return d.groupBy(key).agg(F.count("*").alias("n"), up.alias("risen"), F.avg(p).alias("forecast"), F.avg(F.pow(F.col(p) - F.col("_up"), 2)).alias("brier"), (up - up * up).alias("brier_constant"), F.corr(p, ret).alias("corr"))


def performances(df: DataFrame, key: str, ts: str, positions: dict[str, Column], ret: str, fee: float, periods: float = DAYS, group: str | None = None) -> DataFrame:
    """key, (group,) strategy, days, active, hit_rate, p_value, gross, net, sharpe, volatility, max_drawdown, trades, exposure, turnover,
    cagr, calmar of every position at once.

    Positions are columns side by side: one sort per key serves all of them, and only their results are turned into rows.
    A missing position is 0. With `group`, a column that is constant on stretches of a key (a period, say), each of them
    is an account of its own, though the position held into it is not paid for again.
    """
    names, keys = list(positions), [key, *([group] if group else [])]
    d = df.withColumns({f"_p{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in enumerate(positions.values())})
    many, frame = range(len(names)), upto(keys, ts)
    d = d.withColumns({f"_c{k}": F.coalesce(F.col(f"_p{k}") - F.lag(f"_p{k}").over(by(key, ts)), F.col(f"_p{k}")) for k in many})
    d = d.withColumns({f"_n{k}": F.col(f"_p{k}") * F.col(ret) - F.abs(f"_c{k}") * fee for k in many})
    d = d.withColumns({f"_e{k}": F.product(1 + F.col(f"_n{k}")).over(frame) for k in many})
    d = d.withColumns({f"_d{k}": F.col(f"_e{k}") / F.max(f"_e{k}").over(frame) - 1 for k in many})

    def result(k: int) -> Column:
        p, net, active = F.col(f"_p{k}"), F.col(f"_n{k}"), F.col(f"_p{k}") != 0
        return F.struct(
            F.lit(names[k]).alias("strategy"), F.count(net).alias("days"), F.count_if(active).alias("active"), F.count_if(active & (F.signum(p) == F.signum(ret))).alias("hits"),
            (F.product(1 + p * F.col(ret)) - 1).alias("gross"), (F.product(1 + net) - 1).alias("net"), F.avg(net).alias("mean"), F.stddev_samp(net).alias("sd"), F.min(f"_d{k}").alias("max_drawdown"),
            F.count_if(F.col(f"_c{k}") != 0).alias("trades"), F.avg(F.abs(p)).alias("exposure"), F.sum(F.abs(f"_c{k}")).alias("turned"),
        )

    r = d.groupBy(*keys).agg(F.array(*[result(k) for k in many]).alias("r")).select(*keys, F.inline("r"))
    year = F.lit(float(periods))
    r = r.withColumns({
        "hit_rate": F.try_divide("hits", "active"), "p_value": share_p(F.col("hits"), F.col("active")), "sharpe": F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt(year)),
        "volatility": F.col("sd") * F.sqrt(year), "turnover": F.col("turned") * year / F.col("days"), "cagr": F.when(F.col("net") > -1, F.pow(1 + F.col("net"), year / F.col("days")) - 1),
    })
    return r.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown"))).drop("hits", "mean", "sd", "turned")
