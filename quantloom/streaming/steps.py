"""Incremental steps: idempotent upserts, closed bars from a stream, and daily account steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import first_of

FEE = 0.0025


def insert_ignore(batch: DataFrame, existing: DataFrame | None, key: str, *order) -> DataFrame:
    """The rows of the batch whose key is new, one row a key."""
    rows = first_of(batch, [key], *(order or (F.lit(1),)))
    return rows if existing is None else rows.join(existing.select(key), key, "left_anti")


def closed_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly bars of a stream of (symbol, ts, value, event_id); a bar comes out once the watermark has passed its end."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "symbol")
    order = F.struct("ts", "event_id")
    bars = w.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def account_steps(days: DataFrame, sleeve: str = "sleeve", date: str = "date", capital: float = 5000.0, band: float = 0.1, kill: float = 0.2) -> DataFrame:
    """sleeve, date, cash, qty, equity, halted after each day of (sleeve, date, price, target weight).

    A day trades if the target is 0 while something is held, or is more than `band` of equity away from what is
    held; buying pays its fee in the asset, selling in cash. A drawdown of `kill` sells all and halts the sleeve for
    good; a day's loss of a quarter of that forbids buying. A date that was done already isn't done again.
    """
    schema = f"{sleeve} string, {date} date, cash double, qty double, equity double, halted boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, qty, peak, before, halted, rows = capital, 0.0, capital, capital, False, []
        for day, price, target in pdf.drop_duplicates(date).sort_values(date)[[date, "price", "target"]].itertuples(index=False):
            equity = cash + qty * price
            peak = max(peak, equity)
            halted = halted or equity / peak - 1 <= -kill
            want = 0.0 if halted or pd.isna(target) else max(0.0, target) * equity / price
            if equity / before - 1 <= -kill / 4:
                want = min(want, qty)
            if (want == 0 and qty > 0) or abs(want - qty) * price > band * equity:
                change = want - qty
                if change > 0:
                    change = min(change, cash / price)
                    cash, qty = cash - change * price, qty + change * (1 - FEE)
                else:
                    cash, qty = cash - change * price * (1 - FEE), want
            before = cash + qty * price
            rows.append((pdf[sleeve].iloc[0], day, cash, qty, before, halted))
        return pd.DataFrame(rows, columns=[sleeve, date, "cash", "qty", "equity", "halted"])

    return days.groupBy(sleeve).applyInPandas(run, schema)
