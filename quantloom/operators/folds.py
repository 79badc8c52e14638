"""Order-dependent operators whose keys are worked on in chunks: each chunk gives its transition, transitions are composed
by a scan over the chunks, and rows are computed from their chunk's start. They equal the fold row by row.

Rows of a key have different times. The result doesn't depend on where chunks are cut (`rows` rows or so).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as ch


def state_machine(df: DataFrame, key: str, ts: str, enter: str, leave: str, name: str = "state", rows: int = ch.ROWS) -> DataFrame:
    """1 from an entry to the next exit; on one row an exit wins inside and an entry wins outside. Missing flags are false.

    A row is a map of two states: only an entry sets 1, only an exit sets 0, both exchange the states and neither keeps
    them. So a state is what was set last, exchanged as often as both have come since.
    """
    e, x = (F.coalesce(F.col(c), F.lit(False)) for c in (enter, leave))
    d = ch.chunked(df, key, ts, rows).withColumns({"set_": F.when(e & ~x, 1).when(~e & x, 0), "swap_": (e & x).cast("int")})
    w = ch.upto(key, ts)
    d = d.withColumns({"last_": F.last("set_", ignorenulls=True).over(w), "swaps_": F.sum("swap_").over(w)})
    d = d.withColumn("odd_", (F.col("swaps_") - F.coalesce(F.last(F.when(F.col("set_").isNotNull(), F.col("swaps_")), ignorenulls=True).over(w), F.lit(0))) % 2)
    # a chunk sets its end, or exchanges its start `odd_` times
    end = F.max_by(F.struct("last_", "odd_"), ts).alias("end_")
    own = F.when(F.col("end_.last_").isNotNull(), (F.col("end_.last_") + F.col("end_.odd_")) % 2)
    swaps = F.sum(F.when(own.isNull(), F.col("end_.odd_")).otherwise(0)).over(ch.earlier(key))
    before = F.struct(own.alias("v"), F.sum(F.when(own.isNull(), F.col("end_.odd_")).otherwise(0)).over(W.partitionBy(key).orderBy("chunk_").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("s"))
    last = F.last(F.when(own.isNotNull(), before), ignorenulls=True).over(ch.earlier(key))
    start = (F.coalesce(last["v"], F.lit(0)) + F.coalesce(swaps, F.lit(0)) - F.coalesce(last["s"], F.lit(0))) % 2
    d = ch.carried(d, key, [end], {"start_": start})
    state = (F.coalesce("last_", "start_") + F.col("odd_")) % 2
    return d.withColumn(name, state.cast("int")).drop("chunk_", "set_", "swap_", "last_", "swaps_", "odd_", "start_")


def smoothed(df: DataFrame, key: str, ts: str, values: list[str], alpha: float, rows: int = ch.ROWS) -> DataFrame:
    """df with each of `values` replaced by its exponential smoothing y' = (1 - alpha) y + alpha x, which starts at the first x.

    Rows where the first of `values` is null stay null and are no step. A chunk is an affine map of its start: tasks smooth
    it from 0, and (1 - alpha)^steps times the start is added.
    """
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in values else f.dataType) for f in df.schema.fields] + [T.StructField("chunk_", T.IntegerType()), T.StructField("steps_", T.LongType())])
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        there = pdf[values[0]].notna().to_numpy()
        for c in values:
            x = pdf[c].astype(float).to_numpy()
            x[there] = pd.Series(np.append(0.0, x[there])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
            pdf[c] = pd.Series(x, index=pdf.index).astype(object).where(there, None)
        return pdf.assign(steps_=there.cumsum())[names]

    first = F.min_by(F.struct(*values), F.when(F.col(values[0]).isNotNull(), F.col(ts))).alias("first_")
    d = ch.chunked(df, key, ts, rows)
    firsts = d.groupBy(F.col(key).alias("of_")).agg(first)
    d = d.groupBy(key, "chunk_").applyInPandas(run, schema)
    end = F.max_by(F.struct("steps_", *values), F.when(F.col(values[0]).isNotNull(), F.col(ts))).alias("end_")
    # starts: sum over earlier chunks of their ends, decayed by the steps since, and the decayed first value
    s = d.groupBy(key, "chunk_").agg(end).join(firsts, F.col(key).eqNullSafe(F.col("of_"))).drop("of_")
    past = F.collect_list(F.struct(F.coalesce(F.col("end_.steps_"), F.lit(0)).alias("n"), *[F.coalesce(F.col("end_")[c], F.lit(0.0)).alias(c) for c in values])).over(ch.earlier(key))
    keep = F.lit(1 - alpha)
    onto = lambda c: lambda y, p: F.pow(keep, p["n"]) * y + p[c]
    starts = {f"start_{k}": F.aggregate("past_", F.col("first_")[c].cast("double"), onto(c)) for k, c in enumerate(values)}
    s = s.withColumn("past_", past).withColumns(starts).select(F.col(key).alias("of_"), F.col("chunk_").alias("at_"), *starts)
    d = d.join(s, F.col(key).eqNullSafe(F.col("of_")) & (F.col("chunk_") == F.col("at_")), "left")
    d = d.withColumns({c: F.col(c) + F.pow(keep, F.col("steps_")) * F.col(f"start_{k}") for k, c in enumerate(values)})
    return d.drop("of_", "at_", "chunk_", "steps_", *starts)


def rsi(df: DataFrame, key: str, ts: str, close: str, n: int, name: str = "rsi", rows: int = ch.ROWS) -> DataFrame:
    """Relative strength with exponential smoothing of weight 1/n; 100 while nothing has fallen, also at a key's first row.
    A missing close counts as no change; before the first one there is none."""
    d = ch.previous(ch.chunked(df, key, ts, rows), key, ts, close, "before_").drop("chunk_")
    change = F.when(F.col("before_").isNotNull(), F.coalesce(F.col(close), "before_") - F.col("before_"))
    d = smoothed(d.withColumns({"up_": F.greatest(change, F.lit(0.0)), "down_": F.greatest(-change, F.lit(0.0))}).withColumns({c: F.when(change.isNotNull(), F.col(c)) for c in ("up_", "down_")}), key, ts, ["up_", "down_"], 1 / n, rows)
    return d.withColumn(name, F.when(F.col("down_") > 0, 100 - 100 / (1 + F.col("up_") / F.col("down_"))).otherwise(100.0)).drop("before_", "up_", "down_")


def _trades(target: float, held: float, band: float) -> bool:
    return target == 0 or abs(target - held) > band


def _transition(targets: list[float], band: float) -> tuple[list[float], list[float]]:
    """What a chunk makes of any position held before it: its first targets that could be traded, in order, and the
    position at the chunk's end if that one is the first. Only targets above or below all earlier ones can be, and
    none after a 0 or once two of them are more than twice the band apart."""
    lo, hi, at = float("inf"), float("-inf"), []
    for k, p in enumerate(targets):
        if not lo <= p <= hi or p == 0:
            at.append(k)
            lo, hi = min(lo, p), max(hi, p)
            if p == 0 or hi - lo > 2.001 * band:
                break
    end: dict[int, float] = {}

    def ends(k: int) -> float:
        path = []
        while k not in end:
            path.append(k)
            held = targets[k]
            k = next((j for j in range(k + 1, len(targets)) if _trades(targets[j], held, band)), -1)
            if k < 0:
                end[path[-1]] = held
                k = path[-1]
        for j in path:
            end[j] = end[k]
        return end[k]

    return [targets[k] for k in at], [ends(k) for k in at]


def apply_band(df: DataFrame, key: str, ts: str, position: str, band: float = 0.1, name: str = "held", rows: int = ch.ROWS) -> DataFrame:
    """Keeps the held position until the target is 0 or more than `band` away; missing targets are 0. Nothing is held at first."""
    d = ch.chunked(df, key, ts, rows).withColumn("target_", F.coalesce(F.col(position).cast("double"), F.lit(0.0)))
    key_field = d.schema[key]
    part = T.StructType([key_field, T.StructField("chunk_", T.IntegerType()), T.StructField("first_", T.ArrayType(T.DoubleType())), T.StructField("end_", T.ArrayType(T.DoubleType()))])

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        first, end = _transition(pdf.sort_values(ts, kind="stable")["target_"].tolist(), band)
        return pd.DataFrame({key: pdf[key].iloc[:1].to_numpy(), "chunk_": pdf["chunk_"].iloc[:1].to_numpy(), "first_": [first], "end_": [end]})

    def started(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, out = pdf.sort_values("chunk_"), 0.0, []
        for first, end in zip(pdf["first_"], pdf["end_"], strict=True):
            out.append(held)
            held = next((e for p, e in zip(first, end, strict=True) if _trades(p, held, band)), held)
        return pd.DataFrame({"of_": pdf[key], "at_": pdf["chunk_"], "start_": out})

    starts = d.select(key, "chunk_", ts, "target_").groupBy(key, "chunk_").applyInPandas(told, part)
    starts = starts.groupBy(key).applyInPandas(started, T.StructType([T.StructField("of_", key_field.dataType), T.StructField("at_", T.IntegerType()), T.StructField("start_", T.DoubleType())]))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        held, out = pdf["start_"].iat[0], []
        for p in pdf["target_"].tolist():
            held = p if _trades(p, held, band) else held
            out.append(held)
        return pdf.assign(**{name: out})[schema.fieldNames()]

    d = d.join(starts, F.col(key).eqNullSafe(F.col("of_")) & (F.col("chunk_") == F.col("at_")))
    return d.groupBy(key, "chunk_").applyInPandas(run, schema)


def rolling_max_drawdown(df: DataFrame, key: str, ts: str, ret: str, n: int, name: str = "max_drawdown", rows: int = ch.ROWS) -> DataFrame:
    """Deepest drawdown inside each full window of n returns, the first of which only sets the level; a missing return is 0.

    A key's rows are cut into blocks of n. A window is the end of one block and the beginning of the next: what
    has fallen inside either, or from the highest level of the one to the lowest of the other. All three are running
    extremes inside a block, forwards and backwards, so a row costs the same whatever n is.
    """
    d = ch.numbered(ch.chunked(df, key, ts, rows), key, ts).drop("chunk_")
    d = d.withColumns({"block_": F.floor(F.col("i_") / n), "f_": 1 + F.coalesce(F.col(ret).cast("double"), F.lit(0.0))})
    up, down = ch.upto(key, "i_", "block_"), W.partitionBy(key, "block_").orderBy(F.desc("i_")).rowsBetween(W.unboundedPreceding, W.currentRow)
    lost = F.col("f_") == 0  # a level of 0 is counted, not multiplied with: later levels are relative to one after it
    d = d.withColumns({"e_": F.product(F.when(lost, 1.0).otherwise(F.col("f_"))).over(up), "z_": F.sum(lost.cast("int")).over(up)})
    own = W.partitionBy(key, "block_").orderBy("i_").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = d.withColumns({"z0_": F.first("z_").over(own), "z1_": F.last("z_").over(own), "e1_": F.last("e_").over(own), "top_": F.max("e_").over(up), "floor_": F.min("e_").over(up), "later_": F.min("e_").over(down)})
    fell = F.when(F.col("z_") > F.col("z0_"), 0.0).otherwise(F.col("e_") / F.col("top_"))
    low = F.when(F.col("z1_") > F.col("z_"), 0.0).otherwise(F.col("later_") / F.col("e_"))
    tail = F.when(F.col("z1_") > F.col("z_"), 0.0).otherwise(F.col("e1_") / F.col("e_"))
    d = d.withColumns({"pre_": F.min(fell).over(up), "low_": F.when(F.col("z_") > 0, 0.0).otherwise(F.col("floor_")), "suf_": F.min(low).over(down), "ratio_": F.min(tail).over(down)})
    ends = d.select(F.col(key).alias("of_"), (F.col("i_") + n - 1).alias("at_"), "suf_", "ratio_")
    d = d.drop("suf_", "ratio_").join(ends, F.col(key).eqNullSafe(F.col("of_")) & (F.col("i_") == F.col("at_")), "left")
    worst = F.when((F.col("i_") + 1) % n == 0, F.col("pre_")).otherwise(F.least("pre_", "suf_", F.col("ratio_") * F.col("low_")))
    d = d.withColumn(name, F.when(F.col("i_") >= n - 1, worst - 1))
    return d.select(*df.columns, name)
