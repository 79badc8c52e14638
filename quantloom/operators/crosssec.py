"""Cross-sectional operators: windows partitioned by date over long panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scoring import ic_label
from .special import correlation_p
from .timeseries import average_rank


def top_fraction(df: DataFrame, date: str, score: str, tie: str, share: float = 0.1) -> DataFrame:
    """The best max(1, floor(n * share)) rows of each date; rows without a score don't count."""
    d = df.where(F.col(score).isNotNull())
    d = d.withColumns({"_n": F.count("*").over(W.partitionBy(date)), "_r": F.row_number().over(W.partitionBy(date).orderBy(F.desc(score), tie))})
    return d.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n", "_r")


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; NULL where a side has no variation."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ic_masked(df: DataFrame, group: str, x: str, y: str, least: int = 20) -> DataFrame:
    """Rank correlation per group after pairs with a missing side are dropped; t = ic * sqrt((n - 2) / (1 - ic^2))."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_rank(average_rank(d, group, x, "_rx"), group, y, "_ry")
    out = d.groupBy(group).agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("ic")).where(F.col("n") >= least)
    return out.withColumn("t", F.col("ic") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("ic") * F.col("ic"))))


def ic_table(long: DataFrame, signal: str, x: str, y: str, least: int = 10) -> DataFrame:
    """signal, ic, p, n, significant, label, place of each signal: rank correlation and its two-sided p value, both rounded to four
    digits. Pairs with a missing side don't count; signals with less than `least` pairs or without variation are left out."""
    ic = ic_masked(long, signal, x, y, least).where(F.col("ic").isNotNull() & ~F.isnan("ic"))
    t = ic.select(signal, F.bround("ic", 4).alias("ic"), F.bround(correlation_p(F.col("ic"), F.col("n")), 4).alias("p"), "n")
    t = t.withColumns({"significant": F.col("p") < 0.05, "label": ic_label(F.col("ic"), F.col("p"))})
    return t.withColumn("place", F.row_number().over(W.orderBy(F.desc("ic"), signal)))  # a row a signal


def ic_ranked_first(df: DataFrame, group: str, x: str, y: str, least: int = 30) -> DataFrame:
    """Rank correlation per group with each side ranked over its own non-null rows, before pairs are formed."""
    d = average_rank(average_rank(df, group, x, "_rx"), group, y, "_ry").where(F.col("_rx").isNotNull() & F.col("_ry").isNotNull())
    return d.groupBy(group).agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("ic")).where(F.col("n") >= least)


def neutral_ranks(df: DataFrame, date: str, cols: list[str]) -> DataFrame:
    """Each column's percentile rank per date less a half; missing is neutral, 0."""
    for c in cols:
        df = average_rank(df, date, c, f"rank_{c}", pct=True).withColumn(f"rank_{c}", F.coalesce(F.col(f"rank_{c}") - 0.5, F.lit(0.0)))
    return df


def turnover(picks: DataFrame, date: str, name: str) -> DataFrame:
    """Share of each date's names that the date before doesn't have; 1 on the first."""
    order = picks.select(date).distinct().withColumn("_k", F.row_number().over(W.orderBy(date)))  # one row a date
    p = picks.select(date, name).join(order, date)
    before = p.select((F.col("_k") + 1).alias("_k"), F.col(name), F.lit(1).alias("_held"))
    return p.join(before, ["_k", name], "left").groupBy(date).agg(F.avg(1.0 - F.coalesce("_held", F.lit(0))).alias("turnover"))


def expanding_mean_by_year(monthly: DataFrame, date: str, keys: list[str], value: str, least: int = 24) -> DataFrame:
    """For each year, up to the one after the last, the mean of the values of the months that are known before it, if there are `least`.

    date is a month end; the return that a value measures ends a month later, and only then is the value known.
    """
    span = monthly.groupBy(*keys).agg(F.min(F.year(date)).alias("_a"), F.max(F.year(date)).alias("_b"))
    years = span.select(*keys, F.explode(F.sequence("_a", F.col("_b") + 1)).alias("year"))
    known = F.year(F.last_day(F.add_months(date, 1)))
    y = monthly.groupBy(*keys, known.alias("year")).agg(F.sum(value).alias("_s"), F.count(value).alias("_v"), F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy("year").rowsBetween(W.unboundedPreceding, -1)
    y = years.join(y, [*keys, "year"], "left").withColumns({"_cs": F.sum("_s").over(w), "_cv": F.sum("_v").over(w), "months": F.coalesce(F.sum("_n").over(w), F.lit(0))})
    return y.where(F.col("months") >= least).select(*keys, "year", "months", F.try_divide("_cs", "_cv").alias("weight"))
