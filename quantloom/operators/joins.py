"""Point-in-time joins as equi-joins, unions and windows, so that no operator compares all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(probe: DataFrame, facts: DataFrame, key: str, at: str, avail: str, value: str, order: str, stale_days: int | None = None) -> DataFrame:
    """probe with the last value of its key whose avail is not after `at`; NULL where that is older than stale_days.

    Facts that lack the key, value or date don't count; of one day's facts the last by `order` wins. Both sides
    are put under one another and sorted once per key.
    """
    f = facts.na.drop(subset=[key, value, avail]).select(F.col(key), F.col(avail).alias("_t"), F.col(value).alias("_v"), F.col(avail).alias("_a"), F.lit(0).alias("_side"), F.col(order).cast("long").alias("_o"))
    p = probe.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"))
    both = p.unionByName(f, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("_t", "_side", "_o").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumns({"_lv": F.last("_v", ignorenulls=True).over(w), "_la": F.last("_a", ignorenulls=True).over(w)}).where("_side = 1")
    fresh = F.lit(True) if stale_days is None else F.date_diff(F.col(at), F.col("_la")) <= stale_days
    return both.withColumn(value, F.when(fresh, F.col("_lv"))).drop("_t", "_side", "_v", "_a", "_o", "_lv", "_la")


def asof_dates(facts: DataFrame, dates: DataFrame, key: str, at: str, avail: str, value: str, order: str, lag_days: int = 0, stale_days: int | None = None) -> DataFrame:
    """key, at, value of every key of facts at every one of dates (one row, one ascending array): the last value whose
    avail is not after at - lag_days; NULL where that is older than stale_days.

    As asof, but keys meet dates after the sort: facts are reduced to one for each date that sees it first, each holds until
    the next one's date, and these stretches are written out. What is dealt and sorted is at most facts, not keys times dates.
    """
    dates = F.broadcast(dates.toDF("_dates"))
    usable = F.col(key).isNotNull() & F.col(value).isNotNull() & F.col(avail).isNotNull()
    place = F.when(usable, F.size(F.filter("_dates", lambda d: F.date_sub(d, lag_days) < F.col(avail)))).otherwise(0)  # of a key that has nothing usable one row is left too
    f = facts.crossJoin(dates).select(F.col(key), place.alias("_from"), F.when(usable, F.struct(F.col(avail), F.col(order).cast("long"))).alias("_o"), F.struct(F.col(avail).alias("a"), F.col(value).alias("v")).alias("_x"))
    f = f.groupBy(key, "_from").agg(F.max_by("_x", "_o").alias("_x"))
    w = W.partitionBy(key).orderBy("_from")
    f = f.withColumns({"_begin": F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("_from")), "_until": F.lead("_from").over(w)})
    f = f.crossJoin(dates).withColumn("_d", F.explode(F.slice("_dates", F.col("_begin") + 1, F.coalesce("_until", F.size("_dates")) - F.col("_begin"))))
    fresh = F.lit(True) if stale_days is None else F.date_diff(F.date_sub("_d", lag_days), F.col("_x.a")) <= stale_days
    return f.select(F.col(key), F.col("_d").alias(at), F.when((F.date_sub("_d", lag_days) >= F.col("_x.a")) & fresh, F.col("_x.v")).alias(value))


def in_window(probe: DataFrame, facts: DataFrame, key: str, at: str, when: str, days: int) -> DataFrame:
    """Pairs of probe dates and facts of the key with when in (at - days, at]; each fact is dealt to the month ends
    that can see it, which makes the interval join an equi-join."""
    months = F.sequence(F.lit(0), F.lit(days // 28 + 1))
    dealt = facts.withColumn("_k", F.explode(months)).withColumn("_at", F.last_day(F.add_months(when, F.col("_k"))))
    return probe.join(dealt.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (F.col("_at") == F.last_day(at)) & (F.col(when) <= F.col(at)) & (F.col(when) > F.date_sub(F.col(at), days))).drop("_k", "_at", "_key")


def product_after(rows: DataFrame, events: DataFrame, key: str, end: str, when: str, ratio: str, name: str = "factor") -> DataFrame:
    """rows with the product of the ratios of later events of the key; 1 without any. Running products from the last
    event back and one as-of step replace a theta join."""
    back = W.partitionBy(key).orderBy(F.desc("_t"), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = events.select(F.col(key), F.col(when).alias("_t"), F.col(ratio).alias("_r"), F.lit(1).alias("_side"))
    r = rows.select("*", F.col(end).alias("_t"), F.lit(0).alias("_side"))
    both = r.unionByName(e, allowMissingColumns=True).withColumn(name, F.product(F.coalesce("_r", F.lit(1.0))).over(back))
    return both.where("_side = 0").drop("_t", "_r", "_side")


def previous_day(hours: DataFrame, days: DataFrame, key: str, ts: str, date: str, value: str) -> DataFrame:
    """hours with the value of the day before; 0 where missing, clipped to 0..1."""
    d = days.select(key, F.date_add(date, 1).alias("_d"), F.col(value))
    return hours.withColumn("_d", F.to_date(ts)).join(d, [key, "_d"], "left").withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))).drop("_d")


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def coalesced(df: DataFrame, key: str, value: str, priority: str) -> DataFrame:
    """key, value: the non-null value of the highest priority (smallest number)."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, priority).alias(value))


def common_index(df: DataFrame, key: str, index: str, n: int) -> DataFrame:
    """Rows whose index value all n keys have."""
    return df.withColumn("_n", F.size(F.collect_set(key).over(W.partitionBy(index)))).where(F.col("_n") == n).drop("_n")


def left_chain(base: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """base left-joined with each of `others` on key. A column that an earlier table has too comes out as <column>_<table>, so no name is
    there twice and no value is lost."""
    out = base
    for name, df in others.items():
        taken = set(out.columns) - {key}
        out = out.join(df.select(key, *[F.col(c).alias(f"{c}_{name}" if c in taken else c) for c in df.columns if c != key]), key, "left")
    return out


def at_decisions(decisions: DataFrame, signals: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """decisions with the signals of exactly their keys; where there are none, the defaults (NULL if not named)."""
    d = decisions.join(signals, keys, "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
