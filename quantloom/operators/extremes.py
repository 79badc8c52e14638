"""Sliding extremes with their places, and extremes of the segments that they cut a window into."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as ch
from . import scoring as sc
from . import timeseries as ts


class Table:
    """Least value of any stretch of an array in one step: minima of all stretches of 1, 2, 4, ... entries."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 ** len(self.levels) <= len(x):
            half, last = 2 ** (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of x[a..b]; inf where a > b."""
        out = np.full(len(a), np.inf)
        size = b - a + 1
        level = np.floor(np.log2(np.maximum(size, 1))).astype(int)
        for k in np.unique(level[size > 0]):
            at = np.flatnonzero((level == k) & (size > 0))
            x = self.levels[k]
            out[at] = np.minimum(x[a[at]], x[b[at] - 2**k + 1])
        return out


def highest(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the first of the highest entries among the last n up to each one."""
    place = np.arange(len(x))
    width, best = 1, place.copy()  # best[i]: of x[i .. i + width - 1]
    while width < n:
        step = min(width, n - width)
        later = np.minimum(place + step, len(x) - 1)
        best = np.where(x[best[later]] > x[best], best[later], best)
        width += step
    first = np.maximum(place - n + 1, 0)
    out = best[first]
    short = place < n - 1  # a window that is not full yet: the highest so far
    for i in np.flatnonzero(short):
        out[i] = int(np.argmax(x[: i + 1]))
    return out


def peaks(df: DataFrame, key: str, order: str, high: str, low: str, n: int, rows: int = ch.ROWS) -> DataFrame:
    """df with peak (the highest `high` of the last n rows), peak_age (rows since the first place of it), low_before (the
    lowest `low` of the window's rows up to and with the peak) and low_after (from the peak to the row). NULL while the window fills.

    Rows of a key have different values of `order` and no missing highs or lows. Chunks of a key are worked on by
    themselves, with the n - 1 rows before; highest places and segment minima come from tables of stretches of 1, 2, 4, ... rows,
    so the work grows with n only by its logarithm.
    """
    add = {"peak": T.DoubleType(), "peak_age": T.LongType(), "low_before": T.DoubleType(), "low_after": T.DoubleType()}
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, k) for c, k in add.items()]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i_")
        h, lo, i = (pdf[c].to_numpy(float) for c in (high, low, "i_"))
        place = np.arange(len(h))
        top, table = highest(h, n), Table(lo)
        full = i >= n - 1
        cols = {"peak": h[top], "peak_age": place - top, "low_before": table.least(np.maximum(place - n + 1, 0), top), "low_after": table.least(top, place)}
        own = (pdf["own_"] == pdf["part_"]).to_numpy()
        return pdf.assign(**{c: pd.Series(x, index=pdf.index).astype(object).where(full, None) for c, x in cols.items()})[own][schema.fieldNames()]

    return ch.overlapping(df, key, order, n - 1, rows).groupBy(key, "part_").applyInPandas(run, schema)


#: Bars of the flag and of the mast before it. Fixed values.
FLAG, MAST = 12, 48


def flag_setup(bars: DataFrame, mast_gain: float, flag_range: float, retrace: float, key: str = "symbol", order: str = "ts") -> DataFrame:
    """bars with entry, stop_pct and target_pct of the mast-and-flag rule: a close above the highs of the FLAG bars before it, after a
    mast of MAST bars that gained `mast_gain` at least and a flag of at most `flag_range` that gave back at most `retrace` of it.

    The stop lies at the flag's low, the target a mast's height above the close. A missing or impossible value is no entry.
    """
    k = (key, order)
    r = lambda agg, c, n, lag=0: ts.rolling(agg, c, *k, n, lag=lag)
    d = bars.withColumns({"_fh": r(F.max, "high", FLAG), "_fl": r(F.min, "low", FLAG), "_ml": r(F.min, "low", MAST, FLAG), "_pk": r(F.max, "high", MAST + FLAG), "_bh": r(F.max, "high", FLAG, 1), "_c": F.lag("close", FLAG).over(ts.by(*k))})
    over = lambda a, b: F.try_divide(a, b)
    given: Column = F.greatest(over(F.col("_pk") - F.col("_fl"), F.col("_pk") - F.col("_ml")), F.lit(0.0))
    ok = (over(F.col("close"), F.col("_bh")) > 1) & (over(F.col("_c"), F.col("_ml")) - 1 >= mast_gain) & (over(F.col("_fh") - F.col("_fl"), F.col("_fl")) <= flag_range) & (F.col("_pk") > F.col("_ml")) & (given <= retrace)
    d = d.withColumns({"entry": sc.holds(ok), "stop_pct": 1 - over(F.col("_fl"), F.col("close")), "target_pct": over(F.col("_pk") - F.col("_ml"), F.col("close"))})
    return d.drop("_fh", "_fl", "_ml", "_pk", "_bh", "_c")
