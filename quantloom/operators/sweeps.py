"""Many parameter sets in one pass: each is a column beside the others, so prices are read, joined and sorted once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scoring as sc
from . import timeseries as ts
from .stats import DAYS


@dataclass(frozen=True)
class Variant:
    """A momentum rotation: the `top` symbols by the mean return over all lookbacks, if it is positive, scaled to a target
    volatility; `guarded`: out of the market the day after the guard's close."""

    name: str
    lookbacks: tuple[int, ...] = (30,)
    top: int = 1
    target: float = 0.4
    guarded: bool = False


def rotations(daily: DataFrame, variants: Sequence[Variant], guard: Column | None = None, fee: float = 0.003, key: str = "symbol", date: str = "date", close: str = "close", world: str | None = None) -> DataFrame:
    """(world,) key, date, day (return), and for the k-th variant h<k> (the weight decided at the day's close), p<k> (the position of the day) and n<k> (its net return).

    Weights are set on Sundays, held through the week and applied a day later. `guard` is a condition on a date's rows that
    holds for all of its symbols (or none), such as an index being low. Rows of different worlds, if there is such a column,
    know nothing of each other. All windows of a key share one sort, and all ranks of a date one.
    """
    apart = [world] if world else []
    own = ([*apart, key], date)
    w, cross = ts.by(*own), W.partitionBy(*apart, date)
    back = lambda n: ts.pct_change(close, *own, n)
    d = daily.withColumns({"day": ts.pct_change(close, *own), **{f"_r{n}": back(n) for n in sorted({n for v in variants for n in v.lookbacks})}})
    d = d.withColumn("_vol", ts.rolling(F.stddev_samp, "day", *own, 30) * F.sqrt(F.lit(float(DAYS))))
    looks = list(dict.fromkeys(v.lookbacks for v in variants))
    d = d.withColumns({f"_m{i}": sum((F.col(f"_r{n}") for n in look[1:]), F.col(f"_r{look[0]}")) / len(look) for i, look in enumerate(looks)})
    off = F.coalesce(F.bool_or(guard if guard is not None else F.lit(False)).over(cross), F.lit(False))
    ranks = {f"_k{i}": F.row_number().over(cross.orderBy(F.desc_nulls_last(f"_m{i}"), key)) for i in range(len(looks))}
    d = d.withColumns({**ranks, "_off": off})
    sunday = F.dayofweek(date) == 1

    def weight(v: Variant) -> Column:
        i = looks.index(v.lookbacks)
        ok = sc.holds((F.col(f"_k{i}") <= v.top) & (F.col(f"_m{i}") > 0) & (F.col("_vol") > 0))
        return F.when(sunday, F.when(ok, F.least(v.target / F.col("_vol"), F.lit(1.0)) / v.top).otherwise(0.0))

    d = d.withColumn("_w", F.array(*[weight(v) for v in variants]))
    d = d.withColumn("_w", F.last(F.when(sunday, F.col("_w")), ignorenulls=True).over(ts.upto(*own)))
    held = lambda k, v: F.when(F.col("_off"), 0.0).otherwise(F.coalesce(F.get("_w", F.lit(k)), F.lit(0.0))) if v.guarded else F.coalesce(F.get("_w", F.lit(k)), F.lit(0.0))
    d = d.withColumns({f"h{k}": held(k, v) for k, v in enumerate(variants)})
    d = d.withColumns({f"p{k}": F.coalesce(F.lag(f"h{k}").over(w), F.lit(0.0)) for k in range(len(variants))})
    turn = lambda k: F.abs(F.coalesce(F.col(f"p{k}") - F.lag(f"p{k}").over(w), F.col(f"p{k}")))
    d = d.withColumns({f"n{k}": F.col(f"p{k}") * F.coalesce("day", F.lit(0.0)) - turn(k) * fee for k in range(len(variants))})
    return d.select(*apart, key, date, "day", *[f"{c}{k}" for k in range(len(variants)) for c in "hpn"])


def periods_of(date: Column, periods: dict[str, tuple[str, str | None]]) -> Column:
    """Names of the periods [begin, end) that a date lies in."""
    inside = [F.when((date >= F.lit(a).cast("date")) & (F.lit(True) if b is None else date < F.lit(b).cast("date")), F.lit(n)) for n, (a, b) in periods.items()]
    return F.filter(F.array(*inside), lambda x: x.isNotNull())


def accounts(swept: DataFrame, variants: Sequence[Variant], periods: dict[str, tuple[str, str | None]], key: str = "symbol", date: str = "date") -> DataFrame:
    """period, variant, days, exposure, annual, sharpe, t_stat, max_drawdown, trades, hit_rate, profit_factor of the portfolio of all
    keys in each period; trades are stretches with a position, and belong to the period in which they begin."""
    many = range(len(variants))
    p = swept.groupBy(date).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in many], *[F.sum(f"p{k}").alias(f"p{k}") for k in many])
    p = p.withColumn("period", F.explode(periods_of(F.col(date), periods)))
    upto = ts.upto("period", date)
    p = p.withColumns({f"_e{k}": F.product(1 + F.col(f"n{k}")).over(upto) for k in many})
    p = p.withColumns({f"_d{k}": F.col(f"_e{k}") / F.max(f"_e{k}").over(upto) - 1 for k in many})

    def result(k: int) -> Column:
        net = F.col(f"n{k}")
        return F.struct(F.lit(variants[k].name).alias("variant"), F.count(net).alias("days"), F.avg(f"p{k}").alias("exposure"), (F.product(1 + net) - 1).alias("total"), F.avg(net).alias("_m"), F.stddev_samp(net).alias("_s"), F.min(f"_d{k}").alias("max_drawdown"))

    r = p.groupBy("period").agg(F.array(*[result(k) for k in many]).alias("_r")).select("period", F.inline("_r"))
    ok, year = F.col("_s") > 0, F.lit(float(DAYS))
    r = r.withColumns({"annual": F.when(F.col("total") > -1, F.pow(1 + F.col("total"), year / F.col("days")) - 1), "sharpe": F.when(ok, F.col("_m") / F.col("_s") * F.sqrt(year)), "t_stat": F.when(ok, F.col("_m") / (F.col("_s") / F.sqrt("days")))}).drop("_m", "_s")
    w = ts.by(key, date)
    t = swept.withColumns({f"_s{k}": ((F.col(f"p{k}") > 0) & ~F.coalesce(F.lag(f"p{k}").over(w) > 0, F.lit(False))).cast("int") for k in many})
    t = t.withColumns({f"_s{k}": F.sum(f"_s{k}").over(ts.upto(key, date)) for k in many})
    t = t.select(key, date, F.inline(F.array(*[F.struct(F.lit(v.name).alias("variant"), F.col(f"p{k}").alias("p"), F.col(f"n{k}").alias("n"), F.col(f"_s{k}").alias("s")) for k, v in enumerate(variants)]))).where("p > 0")
    t = t.groupBy(key, "variant", "s").agg(F.min(date).alias("entry"), (F.product(1 + F.col("n")) - 1).alias("pnl"))
    t = t.withColumn("period", F.explode(periods_of(F.col("entry"), periods)))
    gains, losses = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    t = t.groupBy("period", "variant").agg(F.count("*").alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"), F.coalesce(F.try_divide(gains, losses), F.lit(float("inf"))).alias("profit_factor"))
    return r.join(t, ["period", "variant"], "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


def bands(returns: DataFrame, key: str, date: str, ret: str, windows: dict[str, int], rows: int | None = None) -> DataFrame:
    """key, span, measure (ret or drawdown), p5, p25, p50, p75, p95, negative (share below 0 by more than rounding) over all windows of each length inside a key's history.

    A window's return comes from the running product (of n rows from the second row on, as a ratio of levels); its deepest drawdown from
    blocks (see folds.rolling_max_drawdown), so a window's length doesn't matter for the work.
    """
    from . import chunks as ch
    from . import folds as fo

    d = returns.select(key, date, F.coalesce(F.col(ret), F.lit(0.0)).alias("_x"))
    level = F.product(1 + F.col("_x")).over(ts.upto(key, date))
    out = None
    for span, n in windows.items():
        x = fo.rolling_max_drawdown(d, key, date, "_x", n, "drawdown", **({"rows": rows} if rows else {"rows": ch.ROWS}))
        x = x.withColumn("_l", level).withColumn("ret", F.try_divide("_l", F.lag("_l", n).over(ts.by(key, date))) - 1)
        x = x.unpivot([key], ["ret", "drawdown"], "measure", "value").where("value is not null")
        q = F.percentile("value", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
        x = x.groupBy(key, F.lit(span).alias("span"), "measure").agg(q.alias("q"), F.avg((F.col("value") < -1e-12).cast("double")).alias("negative"))
        out = x if out is None else out.unionByName(x)
    return out.select(key, "span", "measure", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], "negative")


def band_verdict(live: DataFrame, known: DataFrame, key: str, days: str, ret: str, windows: dict[str, int]) -> DataFrame:
    """live with span, p5, p50, p95 and verdict (below, inside, above): the shortest window that is as long as the live days, else the
    longest. NULL where a key has no bands."""
    order = sorted(windows.items(), key=lambda x: x[1])
    span = F.lit(order[-1][0])
    for name, n in reversed(order):
        span = F.when(F.col(days) <= n, F.lit(name)).otherwise(span)
    b = known.where("measure = 'ret'").select(key, "span", "p5", "p50", "p95")
    d = live.withColumn("span", span).join(b, [key, "span"], "left")
    return d.withColumn("verdict", F.when(F.col(ret) < F.col("p5"), "below").when(F.col(ret) > F.col("p95"), "above").when(F.col("p5").isNotNull() & F.col(ret).isNotNull(), "inside"))
