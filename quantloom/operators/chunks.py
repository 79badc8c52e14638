"""Work along a key's order in parallel: a long key is cut into chunks of time, whose summaries are composed by a prefix scan.

A chunk is a key and a stretch of its order, so windows and groups over (key, chunk) are tasks of bounded size, whatever
share of all rows one key has. A summary is one row a chunk; scanning the summaries of a key is the only work that
sees all of it, on as many rows as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows of a chunk, about.
ROWS = 100_000


def chunked(df: DataFrame, key: str, order: str, rows: int = ROWS, name: str = "chunk_") -> DataFrame:
    """df with the chunk of each row: 0 for a key of up to `rows` rows, else rising with `order` (a date, a time or a number).

    A long key's span is cut into stretches of equal length, eight a chunk on average, and a chunk takes stretches
    until it has `rows` rows; a stretch with more is a chunk. Only keys with more than `rows` rows have an entry in the
    table of sizes, and one for each stretch in that of stretches.
    """
    kind = df.schema[order].dataType.simpleString()
    place = {"date": F.unix_date(order), "timestamp": F.unix_micros(order), "timestamp_ntz": F.unix_micros(F.col(order).cast("timestamp"))}.get(kind, F.col(order)).cast("double")
    sizes = df.groupBy(F.col(key).alias("chunk_key_")).agg(F.count("*").alias("chunk_n_"), F.min(place).alias("chunk_lo_"), F.max(place).alias("chunk_hi_")).where(F.col("chunk_n_") > rows)
    width = (F.col("chunk_hi_") - F.col("chunk_lo_")) * rows / F.col("chunk_n_") / 8
    d = df.join(F.broadcast(sizes), F.col(key).eqNullSafe(F.col("chunk_key_")), "left")  # at most one for each `rows` rows of df
    d = d.withColumn("chunk_stretch_", F.when(F.col("chunk_n_").isNotNull(), F.floor(F.coalesce(F.try_divide(place - F.col("chunk_lo_"), width), F.lit(0.0)))))
    upto = W.partitionBy("chunk_key_").orderBy("chunk_stretch_").rowsBetween(W.unboundedPreceding, -1)
    counts = d.where("chunk_stretch_ is not null").groupBy(F.col(key).alias("chunk_key_"), "chunk_stretch_").agg(F.count("*").alias("chunk_many_"))
    counts = counts.select(F.col("chunk_key_").alias("chunk_of_"), F.col("chunk_stretch_").alias("chunk_at_"), F.floor(F.coalesce(F.sum("chunk_many_").over(upto), F.lit(0)) / rows).cast("int").alias(name))
    d = d.join(counts, F.col(key).eqNullSafe(F.col("chunk_of_")) & (F.col("chunk_stretch_") == F.col("chunk_at_")), "left")
    return d.withColumn(name, F.coalesce(name, F.lit(0))).drop("chunk_key_", "chunk_n_", "chunk_lo_", "chunk_hi_", "chunk_stretch_", "chunk_of_", "chunk_at_")


def inside(key: str, order: str, chunk: str = "chunk_") -> WindowSpec:
    """A chunk's rows in order."""
    return W.partitionBy(key, chunk).orderBy(order)


def upto(key: str, order: str, chunk: str = "chunk_") -> WindowSpec:
    return inside(key, order, chunk).rowsBetween(W.unboundedPreceding, W.currentRow)


def earlier(key: str, chunk: str = "chunk_") -> WindowSpec:
    """The summaries of a key's chunks before this one."""
    return W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)


def carried(df: DataFrame, key: str, summary: list[Column], start: dict[str, Column], chunk: str = "chunk_") -> DataFrame:
    """df with the columns `start`, which are computed for each chunk from the summaries of the earlier ones.

    summary: aggregates over a chunk's rows; start: columns over the summaries, with windows like earlier().
    """
    s = df.groupBy(key, chunk).agg(*summary).withColumns(start).select(F.col(key).alias("chunk_of_"), F.col(chunk).alias("chunk_at_"), *start)
    return df.join(s, F.col(key).eqNullSafe(F.col("chunk_of_")) & (F.col(chunk) == F.col("chunk_at_")), "left").drop("chunk_of_", "chunk_at_")


def numbered(df: DataFrame, key: str, order: str, name: str = "i_", chunk: str = "chunk_", tie: str | None = None) -> DataFrame:
    """df (chunked) with the place of each row in its key's order, from 0; rows of one `order` stand by `tie`."""
    d = carried(df, key, [F.count("*").alias("chunk_n_")], {"before_": F.coalesce(F.sum("chunk_n_").over(earlier(key, chunk)), F.lit(0))}, chunk)
    return d.withColumn(name, F.col("before_") + F.row_number().over(W.partitionBy(key, chunk).orderBy(order, *([tie] if tie else []))) - 1).drop("before_")


def previous(df: DataFrame, key: str, order: str, value: str, name: str, chunk: str = "chunk_") -> DataFrame:
    """df (chunked) with the last non-null value before each row."""
    own = F.last(value, ignorenulls=True).over(inside(key, order, chunk).rowsBetween(W.unboundedPreceding, -1))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("last_")
    d = carried(df, key, [last], {"carry_": F.last("last_", ignorenulls=True).over(earlier(key, chunk))}, chunk)
    return d.withColumn(name, F.coalesce(own, "carry_")).drop("carry_")


def overlapping(df: DataFrame, key: str, order: str, before: int, rows: int = ROWS) -> DataFrame:
    """df with i_ (place in the key's order), own_ (its stretch of `rows` places) and part_: a row stands in its own stretch and,
    if it is one of the last `before` there, in the next one as well. So whoever has a stretch has the rows before it too."""
    rows = max(rows, before)
    d = numbered(chunked(df, key, order, rows), key, order).drop("chunk_").withColumn("own_", F.floor(F.col("i_") / rows))
    again = F.when(F.col("i_") >= (F.col("own_") + 1) * rows - before, F.array("own_", F.col("own_") + 1)).otherwise(F.array("own_"))
    return d.withColumn("part_", F.explode(again))
