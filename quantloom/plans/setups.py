"""Registered queries of the flag set-ups: sliding peaks with their segments, entries, stops and targets at every hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extremes as ex
from ..operators import timeseries as ts
from ..sources import frames as fr
from .catalog import HOURS, query

N = 60
PEAKS = HOURS + f""", w AS (SELECT symbol, ts, list(high) OVER f AS h, list(low) OVER f AS l FROM filled_hours WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS {N - 1} PRECEDING)),
p AS (SELECT symbol, ts, l, list_max(h) AS peak, list_position(h, list_max(h)) AS pos FROM w WHERE len(h) = {N})"""


@query("a17_peaks_and_segments", "symbol ts ~peak #peak_age ~low_before ~low_after ~retrace", PEAKS, f"SELECT g.symbol, g.ts, peak, {N} - pos AS peak_age, list_min(l[1:pos]) AS low_before, list_min(l[pos:]) AS low_after, (peak - list_min(l[pos:])) / nullif(peak - list_min(l[1:pos]), 0) AS retrace FROM filled_hours g LEFT JOIN p ON g.symbol = p.symbol AND g.ts = p.ts")
def a17(spark, d):
    """The highest high of the last 60 hours, its age, the lows before and after it, and how much of the rise has been given back."""
    b = ts.fill_hours(fr.bars_1h(spark, d)).select("symbol", "ts", "high", "low")
    p = ex.peaks(b, "symbol", "ts", "high", "low", N, rows=200)
    return p.withColumn("retrace", F.try_divide(F.col("peak") - F.col("low_after"), F.col("peak") - F.col("low_before")))


_HR = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"
_R = lambda agg, n, lag=0: f"CASE WHEN count(*) OVER {_HR.format(n - 1 + lag, lag)} = {n} THEN {agg} OVER {_HR.format(n - 1 + lag, lag)} END"
FLAGS = HOURS + f""", f AS (SELECT *, {_R('max(high)', 12)} AS fh, {_R('min(low)', 12)} AS fl, {_R('min(low)', 48, 12)} AS ml, {_R('max(high)', 60)} AS pk, {_R('max(high)', 12, 1)} AS bh, lag(close, 12) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM filled_hours)"""


@query("f7_flag_setup", "symbol ts entry ~stop_pct ~target_pct", FLAGS, "SELECT symbol, ts, coalesce(close / nullif(bh, 0) > 1 AND c / nullif(ml, 0) - 1 >= 3 AND (fh - fl) / nullif(fl, 0) <= 40 AND pk > ml AND greatest((pk - fl) / nullif(pk - ml, 0), 0) <= 1.2, false) AS entry, 1 - fl / nullif(close, 0) AS stop_pct, (pk - ml) / nullif(close, 0) AS target_pct FROM f")
def f7(spark, d):
    """The rule's columns at every hour; these bars swing by hundreds of per cent, so masts and flags may too."""
    return ex.flag_setup(ts.fill_hours(fr.bars_1h(spark, d)), 3.0, 40.0, 1.2)
