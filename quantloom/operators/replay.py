"""Replay by prefix: do decisions of the whole history stand when only the rows up to a day are known?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The world that knows all rows.
WHOLE = "whole"


def worlds(history: DataFrame, cuts: DataFrame, date: str = "date", world: str = "world") -> DataFrame:
    """history once as a whole and once for each cut (one row of `cut` each), with the rows up to it. There are as many copies as cuts."""
    c = F.broadcast(cuts.select(F.col("cut").cast("date").alias("cut_")).distinct())
    known = history.join(c, F.col(date) <= F.col("cut_")).withColumn(world, F.col("cut_").cast("string")).drop("cut_")
    return history.withColumn(world, F.lit(WHOLE)).unionByName(known)


def digests(decisions: DataFrame, date: str, cells: list[Column], world: str = "world") -> DataFrame:
    """world, date, day (a digest of the day's decisions, in any order of its rows) and chain (of all days up to it)."""
    d = decisions.groupBy(world, date).agg(F.bit_xor(F.xxhash64(F.col(date).cast("date"), *cells)).alias("day"))
    return d.withColumn("chain", F.bit_xor("day").over(W.partitionBy(world).orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)))


def replay(history: DataFrame, cuts: DataFrame, decide: Callable[[DataFrame], DataFrame], cells: list[Column], date: str = "date") -> DataFrame:
    """cut, days, different, first: for each cut, how many days' decisions differ from those of the whole history, and the first of
    them (NULL: the decision looks at no row after its day).

    decide works on a frame with a column `world`, whose worlds know nothing of each other, and returns world, date and
    what `cells` read. All worlds are decided in one job; then days are compared by their digests in one join, and days after
    the last one on which the chains agree are those to look at.
    """
    d = digests(decide(worlds(history, cuts, date)), date, cells)
    whole = d.where(F.col("world") == WHOLE).select(F.col(date).alias("at"), F.col("day").alias("day_"), F.col("chain").alias("chain_"))
    c = d.where(F.col("world") != WHOLE).join(whole, F.col(date) == F.col("at"))
    off = F.col("day") != F.col("day_")
    return c.groupBy(F.col("world").cast("date").alias("cut")).agg(F.count("*").alias("days"), F.count_if(off).alias("different"), F.min(F.when(F.col("chain") != F.col("chain_"), F.col("at"))).alias("first"))
