"""Daily research features of an asset from series that are published late and with holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import timeseries as ts


def asof_entries(targets: DataFrame, series: DataFrame, key: str, date: str, limit: int, lags: dict[str, int] | None = None) -> DataFrame:
    """key, date, value at every target date: a series' last entry, for `limit` target dates after it at most.

    targets: date. series: key, date, value; an entry of key k is known lags[k] days (default none) after its date. On the entry's own
    day it always counts; entries with a missing value are entries too. Of several on one day the greatest counts. Probes
    and entries are one table and one sort per key.
    """
    lag = F.create_map(*[x for k, n in (lags or {"": 0}).items() for x in (F.lit(k), F.lit(n))])
    s = series.select(key, F.date_add(F.col(date), F.coalesce(F.try_element_at(lag, F.col(key)), F.lit(0))).alias("at_"), F.col("value").cast("double").alias("value"))
    s = s.groupBy(key, "at_").agg(F.max("value").alias("value")).withColumn("probe_", F.lit(0))
    t = s.select(key).distinct().join(F.broadcast(targets.select(F.col(date).alias("at_")).distinct()))  # a row for each key and target date: what is returned
    u = s.unionByName(t.withColumns({"value": F.lit(None).cast("double"), "probe_": F.lit(1)}))
    w = W.partitionBy(key).orderBy("at_", "probe_").rowsBetween(W.unboundedPreceding, W.currentRow)
    entry = lambda *c: F.last(F.when(F.col("probe_") == 0, F.struct(*c)), ignorenulls=True).over(w)
    u = u.withColumn("last_", entry("at_", "value"))
    u = u.withColumn("carried_", F.sum(F.when((F.col("probe_") == 1) & (F.col("last_.at_") < F.col("at_")), 1).otherwise(0)).over(w))
    u = u.withColumn("since_", entry("carried_"))
    fresh = F.col("carried_") - F.col("since_.carried_") <= limit
    return u.where("probe_ = 1").select(key, F.col("at_").alias(date), F.when(fresh, F.col("last_.value")).alias("value"))


def wide(long: DataFrame, key: str, names: list[str], *by: str) -> DataFrame:
    """One row for each combination of `by`, a column for each name; missing cells are NULL, other names are left out."""
    return long.groupBy(*by).pivot(key, names).agg(F.first("value", ignorenulls=True))


def growth(col: Column, n: int, spec: tuple[str, str]) -> Column:
    return F.try_divide(col, F.lag(col, n).over(ts.by(*spec))) - 1


def features(d: DataFrame, key: str, date: str) -> DataFrame:
    """key, date, close and 21 features known at each day's close.

    d: close, funding, implied, addresses, transfers, hashes, mvrv, inflow, outflow, stable, locked, fear, stocks, dollar, bonds, gold, one
    row a day. Rolling means and sums need all their days, except the yearly ones (180).
    """
    own, w = (key, date), ts.by(key, date)
    roll = lambda agg, c, n, least=None: ts.rolling(agg, c, *own, n, least)
    d = d.withColumns({"_r": F.ln(F.try_divide("close", F.lag("close").over(w))), "_flow": F.col("inflow") - F.col("outflow"), "_both": F.col("inflow") + F.col("outflow")})
    d = d.withColumns({"funding_7": roll(F.avg, "funding", 7), "price_vol_30": roll(F.stddev_samp, "_r", 30) * F.sqrt(F.lit(365.0)), **{f"_{c}": roll(F.avg, c, 7) for c in ("addresses", "transfers", "hashes")}})
    change = lambda c, n: F.col(c) - F.lag(c, n).over(w)
    return d.select(
        key, date, "close",
        growth(F.col("close"), 30, own).alias("price_mom_30"), growth(F.col("close"), 90, own).alias("price_mom_90"), "price_vol_30", "funding_7",
        F.try_divide(F.col("funding_7") - roll(F.avg, "funding_7", 365, 180), roll(F.stddev_samp, "funding_7", 365, 180)).alias("funding_z"),
        "implied", change("implied", 7).alias("implied_change"), (F.col("implied") / 100 - F.col("price_vol_30")).alias("premium"),
        *[growth(F.col(f"_{c}"), 30, own).alias(f"{c}_growth") for c in ("addresses", "transfers", "hashes")],
        "mvrv", F.try_divide(roll(F.sum, "_flow", 7), roll(F.sum, "_both", 7)).alias("net_flow"), growth(F.col("stable"), 30, own).alias("stable_growth"), growth(F.col("locked"), 30, own).alias("locked_growth"),
        "fear", change("fear", 7).alias("fear_change"), *[growth(F.col(c), 20, own).alias(f"{c}_mom") for c in ("stocks", "dollar", "bonds", "gold")],
    )


FEATURES = ("price_mom_30", "price_mom_90", "price_vol_30", "funding_7", "funding_z", "implied", "implied_change", "premium", "addresses_growth", "transfers_growth", "hashes_growth", "mvrv", "net_flow", "stable_growth", "locked_growth", "fear", "fear_change", "stocks_mom", "dollar_mom", "bonds_mom", "gold_mom")


def forward(d: DataFrame, key: str, date: str, horizon: int, name: str = "forward") -> DataFrame:
    """Log return of close over the next `horizon` rows."""
    return d.withColumn(name, F.ln(F.try_divide(F.lead("close", horizon).over(ts.by(key, date)), F.col("close"))))
