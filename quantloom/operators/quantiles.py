"""Exact quantiles of the rows up to each row, in sorted structures that are kept up row by row, and in parallel along a key."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import stored
from . import chunks as ch


def _at(q: float, n: int) -> tuple[int, float]:
    """Lower rank (from 0) of the quantile of n values and the weight of the next one."""
    at = q * (n - 1)
    return int(at), at - int(at)


def rolling_quantile(df: DataFrame, key: str, ts: str, value: str, q: float, n: int, min_periods: int, name: str = "quantile", rows: int = ch.ROWS) -> DataFrame:
    """df with the q-quantile (linear between ranks) of the last n rows' values; NULL with less than min_periods of them.

    Chunks of a key are worked on by themselves, each with the n - 1 rows before it: a sorted list of the window's values
    takes in one and lets one go a row. Rows of a key have different times; missing values count for nothing.
    """
    d = ch.overlapping(df, key, ts, n - 1, rows)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i_")
        held: list[float] = []
        window: list[tuple[int, float]] = []
        out, old = [], 0
        for i, x in zip(pdf["i_"].tolist(), pdf[value].astype(float).tolist(), strict=True):
            while old < len(window) and window[old][0] <= i - n:
                held.pop(bisect_left(held, window[old][1]))
                old += 1
            if x == x:
                insort(held, x)
                window.append((i, x))
            if len(held) >= max(1, min_periods):
                k, share = _at(q, len(held))
                out.append(held[k] + (share and share * (held[k + 1] - held[k])))
            else:
                out.append(None)
        own = (pdf["own_"] == pdf["part_"]).to_numpy()
        return pdf.assign(**{name: pd.Series(out, index=pdf.index, dtype=object)})[own][schema.fieldNames()]

    return d.groupBy(key, "part_").applyInPandas(run, schema)


def expanding_quantile(df: DataFrame, key: str, ts: str, value: str, q: float, min_periods: int, name: str = "quantile", rows: int = 50_000) -> DataFrame:
    """df with the q-quantile (linear between ranks) of all values up to each row; NULL with less than min_periods of them.

    A key of up to `rows` rows is one sorted list in one task. A longer one's values are ranked once and cut into blocks of `rows` ranks, its rows into chunks of `rows` times. How many values
    each chunk adds to each block gives, by prefix sums, how many every block has when a chunk begins. With these
    counts a chunk finds the block, and the rank inside it, that each of its rows asks for. A block then answers the rows
    of one chunk at a time, taking in its own values in order of time. A task sees `rows` values and as many questions,
    however long a key is. Rows of a key have different times; missing values count for nothing.
    """
    sizes = df.groupBy(F.col(key).alias("of_")).agg(F.count("*").alias("n_")).where(F.col("n_") > rows).select("of_")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        """A short key in one sorted list."""
        pdf = pdf.sort_values(ts)
        held: list[float] = []
        out: list[float | None] = []
        for x in pdf[value].astype(float).tolist():
            if x == x:
                insort(held, x)
            if len(held) >= max(1, min_periods):
                k, share = _at(q, len(held))
                out.append(held[k] + (share and share * (held[k + 1] - held[k])))
            else:
                out.append(None)
        return pdf.assign(**{name: pd.Series(out, index=pdf.index, dtype=object)})[schema.fieldNames()]

    if not sizes.take(1):
        return df.groupBy(key).applyInPandas(alone, schema)
    is_long = F.col(key).eqNullSafe(F.col("of_"))
    short = df.join(F.broadcast(sizes), is_long, "left_anti").groupBy(key).applyInPandas(alone, schema)
    return short.unionByName(_long(df.join(F.broadcast(sizes), is_long, "left_semi"), key, ts, value, q, min_periods, name, rows))


def _long(df: DataFrame, key: str, ts: str, value: str, q: float, min_periods: int, name: str, rows: int) -> DataFrame:
    """expanding_quantile() by chunks and blocks."""
    d = stored(ch.numbered(ch.chunked(df, key, ts, rows), key, ts).drop("chunk_"))
    v = d.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(key).alias("key_"), "i_", F.col(value).cast("double").alias("v_"))
    v = ch.numbered(ch.chunked(v, "key_", "v_", rows), "key_", "v_", "r_", tie="i_")
    v = stored(v.select("key_", "i_", "v_", F.floor(F.col("r_") / rows).alias("block_"), F.floor(F.col("i_") / rows).alias("part_")))
    kind = df.schema[key].dataType
    of = lambda *more: T.StructType([T.StructField("key_", kind), *[T.StructField(n, T.LongType()) for n in more]])
    # values of each block before each chunk that asks: from each chunk that adds some, up to the next one that does
    w = W.partitionBy("key_", "block_").orderBy("part_")
    last = d.groupBy(F.col(key).alias("of_")).agg(F.floor(F.max("i_") / rows).alias("last_"))
    c = v.groupBy("key_", "block_", "part_").agg(F.count("*").alias("n_")).withColumns({"upto_": F.sum("n_").over(w), "next_": F.lead("part_").over(w)})
    c = c.join(last, F.col("key_").eqNullSafe(F.col("of_")))
    c = c.withColumn("at_", F.explode(F.when(F.col("part_") < F.coalesce("next_", "last_"), F.sequence(F.col("part_") + 1, F.coalesce("next_", "last_"))).otherwise(F.array().cast("array<bigint>"))))
    counts = c.select(F.col("key_").alias("of_"), F.col("at_").alias("part_"), F.col("block_").alias("in_"), "upto_")
    asked = d.select(F.col(key).alias("of_"), F.col("i_").alias("at_")).join(v.select("key_", "i_", "block_"), F.col("key_").eqNullSafe(F.col("of_")) & (F.col("i_") == F.col("at_")), "left")
    asked = asked.drop("key_", "i_").select(F.col("of_").alias("key_"), F.col("at_").alias("i_"), "block_").select("key_", F.floor(F.col("i_") / rows).alias("part_"), "i_", "block_")

    def ask(events: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        """Block and rank of the lower and the upper value of each row's quantile."""
        out: list[tuple] = []
        if len(events):
            events = events.sort_values("i_")
            most = int(np.nanmax(np.append(events["block_"].fillna(-1).to_numpy(), before["in_"].max() if len(before) else -1)))
            have = np.zeros(most + 1, np.int64)
            have[before["in_"].to_numpy(int)] = before["upto_"].to_numpy(int)
            total = int(have.sum())
            for i, b in zip(events["i_"].tolist(), events["block_"].tolist(), strict=True):
                if b == b:
                    have[int(b)] += 1
                    total += 1
                if total >= max(1, min_periods):
                    k, share = _at(q, total)
                    upto = have.cumsum()
                    for rank, weight in ((k, 1 - share), (k + 1, share)):
                        if weight:
                            block = int(np.searchsorted(upto, rank, side="right"))
                            out.append((i, block, int(rank - (upto[block - 1] if block else 0)), weight))
        done = pd.DataFrame(out, columns=["i_", "block_", "rank_", "weight_"])
        done.insert(0, "key_", events["key_"].iloc[0] if len(events) else None)
        done.insert(1, "part_", events["part_"].iloc[0] if len(events) else -1)
        return done

    schema = T.StructType([*of("part_", "i_", "block_", "rank_").fields, T.StructField("weight_", T.DoubleType())])
    questions = asked.groupBy("key_", "part_").cogroup(counts.groupBy("of_", "part_")).applyInPandas(ask, schema)

    def answer(mine: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        mine, values = mine.sort_values("i_"), values.sort_values("came_")
        came, held, out, k = list(zip(values["came_"].tolist(), values["value_"].tolist(), strict=True)), [], [], 0
        for i, rank, weight in zip(mine["i_"].tolist(), mine["rank_"].tolist(), mine["weight_"].tolist(), strict=True):
            while k < len(came) and came[k][0] <= i:
                insort(held, came[k][1])
                k += 1
            out.append(weight * held[rank])
        return pd.DataFrame({"key_": mine["key_"], "i_": mine["i_"], "share_": out})

    wanted = questions.select(F.col("key_").alias("of_"), F.col("block_").alias("at_"), F.col("part_").alias("for_")).distinct()
    sent = v.drop("part_").join(wanted, F.col("key_").eqNullSafe(F.col("of_")) & (F.col("block_") == F.col("at_")) & (F.col("i_") < (F.col("for_") + 1) * rows)).select("of_", "at_", "for_", F.col("i_").alias("came_"), F.col("v_").alias("value_"))
    answers = questions.groupBy("key_", "block_", "part_").cogroup(sent.groupBy("of_", "at_", "for_")).applyInPandas(answer, T.StructType([*of("i_").fields, T.StructField("share_", T.DoubleType())]))
    answers = answers.groupBy(F.col("key_").alias("of_"), F.col("i_").alias("at_")).agg(F.sum("share_").alias(name))
    d = d.join(answers, F.col(key).eqNullSafe(F.col("of_")) & (F.col("i_") == F.col("at_")), "left")
    return d.select(*df.columns, name)
