"""Window operators over long frames: one sort per key serves all of a select's columns.

Missing values are NULL, never NaN. A rolling value needs its full window unless min_periods says less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by(key: str | list[str], ts: str) -> WindowSpec:
    return W.partitionBy(key).orderBy(ts)


def upto(key: str | list[str], ts: str) -> WindowSpec:
    return by(key, ts).rowsBetween(W.unboundedPreceding, W.currentRow)


def last_n(key: str | list[str], ts: str, n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end `lag` rows before the current one."""
    return by(key, ts).rowsBetween(-(n - 1 + lag), -lag)


def guarded(value: Column, counted: Column | str, frame: WindowSpec, least: int) -> Column:
    """value over the frame where it has `least` non-null rows."""
    return F.when(F.count(counted).over(frame) >= least, value.over(frame))


def rolling(agg, col: str, key: str, ts: str, n: int, min_periods: int | None = None, lag: int = 0) -> Column:
    return guarded(agg(col), col, last_n(key, ts, n, lag), n if min_periods is None else min_periods)


def pct_change(col: str, key: str, ts: str, n: int = 1) -> Column:
    return F.try_divide(F.col(col), F.lag(col, n).over(by(key, ts))) - 1


def log_return(col: str, key: str, ts: str, n: int = 1) -> Column:
    return F.ln(F.try_divide(F.col(col), F.lag(col, n).over(by(key, ts))))


def ffill(col: str, key: str, ts: str) -> Column:
    return F.last(col, ignorenulls=True).over(upto(key, ts))


def equity(ret: str, key: str, ts: str) -> Column:
    """Running product of 1 + ret."""
    return F.product(1 + F.col(ret)).over(upto(key, ts))


def drawdown(df: DataFrame, ret: str, key: str, ts: str, name: str = "drawdown") -> DataFrame:
    df = df.withColumn("equity", equity(ret, key, ts))
    return df.withColumn(name, F.col("equity") / F.max("equity").over(upto(key, ts)) - 1)


def islands(df: DataFrame, active: Column, key: str, ts: str) -> DataFrame:
    """Adds island: a number that grows each time `active` changes."""
    df = df.withColumn("_active", active.cast("int"))
    change = F.coalesce((F.col("_active") != F.lag("_active").over(by(key, ts))).cast("int"), F.lit(1))
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(upto(key, ts))).drop("_change")


def grid(df: DataFrame, key: str, ts: str, step: str) -> DataFrame:
    """key, ts at every step between each key's first and last row."""
    ends = df.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return ends.select(key, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {step}"))).alias(ts))


def fill_days(df: DataFrame, key: str = "symbol", ts: str = "date", value: str = "close") -> DataFrame:
    """Every calendar day of each key: value carried forward, trading false on the added days."""
    full = grid(df, key, ts, "1 DAY").join(df.select(key, ts, value), [key, ts], "left")
    return full.withColumn("trading", F.col(value).isNotNull()).withColumn(value, ffill(value, key, ts))


def fill_hours(df: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Every hour of each key's bars: close carried forward, open, high and low set to it, volumes 0."""
    full = grid(df, key, ts, "1 HOUR").join(df, [key, ts], "left").withColumn("close", ffill("close", key, ts))
    full = full.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("volume", "taker") if c in df.columns})


def gaps(df: DataFrame, key: str, ts: str, days: int = 1) -> DataFrame:
    """How many steps of each key are not `days` days."""
    step = F.date_diff(F.col(ts), F.lag(ts).over(by(key, ts)))
    return df.withColumn("_s", step).groupBy(key).agg(F.count_if(F.col("_s") != days).alias("gaps"))


def resample(df: DataFrame, key: str, bucket: Column, ts: str, value: str) -> DataFrame:
    """Last, highest, lowest and mean value and row count of each bucket."""
    return df.groupBy(key, bucket.alias("bucket")).agg(F.max_by(value, ts).alias("last"), F.max(value).alias("high"), F.min(value).alias("low"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def month_end(ts: Column, n: int) -> Column:
    """Month-end offset: 0 rolls to this month's end, 1 does too unless the date is one, which moves to the next."""
    return F.last_day(ts) if n == 0 else F.when(ts == F.last_day(ts), F.last_day(F.add_months(ts, 1))).otherwise(F.last_day(ts))


def first_rank(df: DataFrame, partition: str, value: str, tie: str, name: str = "rank") -> DataFrame:
    """Rank by value, highest first, ties in the order of `tie`; NULL values stay unranked."""
    w = W.partitionBy(partition, F.col(value).isNull()).orderBy(F.desc(value), tie)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.row_number().over(w)))


def average_rank(df: DataFrame, partition: str | list[str], value: str, name: str = "rank", pct: bool = False) -> DataFrame:
    """Average rank of equal values, lowest first, over non-null values; as a share of their number if pct.

    Ties are counted in the ordered window, so the ranks of any number of columns share one partitioning.
    """
    keys = [partition] if isinstance(partition, str) else list(partition)
    own = W.partitionBy(*keys)
    ordered = own.orderBy(F.col(value).asc_nulls_last())
    rank = F.rank().over(ordered) + (F.count("*").over(ordered.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2
    return df.withColumn(name, F.when(F.col(value).isNotNull(), rank / F.count(value).over(own) if pct else rank.cast("double")))


def carried_while_closed(df: DataFrame, key: str, ts: str, position: str, trading: str) -> DataFrame:
    """position as it was on the last trading row where `trading` is false or missing; 0 before the first one."""
    open_ = F.coalesce(F.col(trading), F.lit(False))
    kept = F.last(F.when(open_, F.coalesce(F.col(position).cast("double"), F.lit(0.0))), ignorenulls=True).over(upto(key, ts))
    return df.withColumn(position, F.coalesce(kept, F.lit(0.0)))
