"""Trades of bracket strategies, one task per key, and weekly holding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COST = 0.003  # of a position's value, each side


def _exits(bars: pd.DataFrame, at: int, stop: float, target: float, most: int) -> tuple[int, float, str]:
    """Where a position opened at the close of row `at` ends, at which price and why: of the first row of each kind
    of exit the earliest counts, and on one row the kind that is named first."""
    o, h, low, c = (bars[x].to_numpy(float)[at + 1 : at + 1 + most] for x in ("open", "high", "low", "close"))
    price = float(bars["close"].iat[at])
    floor, roof = price * (1 - stop), price * (1 + target)
    kinds = [(o <= floor, o, "stop"), (low <= floor, np.full(len(o), floor), "stop"), (o >= roof, o, "target"), (h >= roof, np.full(len(o), roof), "target"), (np.arange(1, len(o) + 1) >= most, c, "time"), (np.arange(len(o)) == len(o) - 1, c, "end")]
    first = [int(hit.argmax()) if hit.any() else len(o) for hit, *_ in kinds]
    k = int(np.argmin(first))
    return at + 1 + first[k], float(kinds[k][1][first[k]]), kinds[k][2]


def _trades(pdf: pd.DataFrame, ts: str, entry: str, stop: str, target: str, most: int) -> tuple[pd.DataFrame, list[tuple[int, int, float, str]]]:
    """A key's rows in order, and its trades (entry row, exit row, exit price, reason): each signal from the last exit on opens the next."""
    bars = pdf.sort_values(ts, kind="stable").reset_index(drop=True)
    signals = np.flatnonzero(bars[entry].fillna(False).to_numpy(bool) & (bars[stop].to_numpy(float) > 0) & (bars[target].to_numpy(float) > 0))
    signals, trades, free = signals[signals < len(bars) - 1], [], 0
    while (k := int(np.searchsorted(signals, free))) < len(signals):
        at = int(signals[k])
        free, price, reason = _exits(bars, at, bars[stop].iat[at], bars[target].iat[at], most)
        trades.append((at, free, price, reason))
    return bars, trades


def simulate_trades(bars: DataFrame, key: str = "symbol", ts: str = "ts", entry: str = "entry", stop: str = "stop_pct", target: str = "target_pct", max_bars: int = 72, bar: str = "1h") -> DataFrame:
    """Trades of a long-only bracket strategy: key, entry_ts, exit_ts, entry_price, exit_price, bars, reason, pnl.

    A signal buys at its bar's close. Each later bar is asked in this order: open at or below the stop (out at
    the open), low at or below it (out at the stop), open at or above the target (out at the open), high at or
    above it (out at the target), max_bars held (out at the close), last bar of the key (out at the close). A
    signal without a positive stop and target is skipped; the bar of an exit may enter again. Times are those of
    the decisions, a bar after the bar's own; pnl is after COST on both sides.
    """
    schema = f"{key} string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, exit_price double, bars int, reason string, pnl double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, trades = _trades(pdf, ts, entry, stop, target, max_bars)
        if not trades:  # an empty frame's columns have no type that Arrow takes for strings
            return pd.DataFrame()
        i, j, price, reason = ([t[k] for t in trades] for k in range(4))
        held = rows["close"].to_numpy(float)[i]
        when = rows[ts] + pd.Timedelta(bar)
        pnl = np.array(price) / held * (1 - COST) ** 2 - 1
        return pd.DataFrame({key: rows[key].iloc[i].to_numpy(), "entry_ts": when.iloc[i].to_numpy(), "exit_ts": when.iloc[j].to_numpy(), "entry_price": held, "exit_price": price, "bars": np.subtract(j, i), "reason": reason, "pnl": pnl})

    return bars.groupBy(key).applyInPandas(run, schema)


def trade_returns(bars: DataFrame, key: str = "symbol", ts: str = "ts", entry: str = "entry", stop: str = "stop_pct", target: str = "target_pct", max_bars: int = 72) -> DataFrame:
    """key, ts, ret of every bar: the held position's return over the bar after the costs of a trade's first and last one, NULL outside of trades."""
    schema = f"{key} string, {ts} timestamp_ntz, ret double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, trades = _trades(pdf, ts, entry, stop, target, max_bars)
        close, ret = rows["close"].to_numpy(float), np.full(len(rows), np.nan)
        for i, j, price, _ in trades:
            path = np.append(close[i:j], price)
            path = path[1:] / path[:-1]
            path[0] *= 1 - COST
            path[-1] *= 1 - COST
            ret[i + 1 : j + 1] = path - 1
        return rows[[key, ts]].assign(ret=pd.Series(ret).astype(object).where(~np.isnan(ret), None))

    return bars.groupBy(key).applyInPandas(run, schema)


def weekly_hold(weights: DataFrame, key: str, date: str, weight: str, off: F.Column | None = None) -> DataFrame:
    """Sunday's weight held through the week, 0 before the first Sunday, and 0 on days that `off` marks."""
    from .timeseries import ffill

    w = weights.withColumn("_sunday", F.when(F.dayofweek(date) == 1, F.coalesce(F.col(weight), F.lit(0.0))))
    w = w.withColumn(weight, F.coalesce(ffill("_sunday", key, date), F.lit(0.0))).drop("_sunday")
    return w if off is None else w.withColumn(weight, F.when(F.coalesce(off, F.lit(False)), 0.0).otherwise(F.col(weight)))
