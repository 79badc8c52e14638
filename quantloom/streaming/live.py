"""Bars, window features and late rows from a stream in any order, with state per key that a restart finds again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

HOUR = 3_600_000_000  # microseconds
#: kind: bar (all but value and event_id) or late (a row that came after its bar had been closed: ts, value, event_id).
OUT = "symbol string, kind string, ts timestamp, open double, high double, low double, close double, volume long, mean double, change double, value double, event_id long"
_NONE = {c: None for c in ("open", "high", "low", "close", "volume", "mean", "change", "value", "event_id")}


class Bars(StatefulProcessor):
    """Hourly bars of a key. An hour is closed once a row `delay` after its end has come; then its bar goes out and, as long as
    the key's stream runs, no row of it counts any more: such rows go out as late ones. A row that comes again (by
    event_id) while its hour is open counts once.

    State per key: each open hour's rows in brief, the closed border, and a ring of the last `window` closes.
    """

    def __init__(self, delay: int, window: int):
        self.delay, self.window = delay, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour long", "first array<long>, open double, high double, low double, last array<long>, close double, ids array<long>")
        self.border = handle.getValueState("border", "seen long, closed long")
        self.ring = handle.getValueState("ring", "closes array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        seen, closed = self.border.get() if self.border.exists() else (-(1 << 62), -(1 << 62))
        out: list[dict] = []
        for pdf in rows:
            for t, value, event_id in zip(pdf["us"].tolist(), pdf["value"].tolist(), pdf["event_id"].tolist(), strict=True):
                hour = t // HOUR * HOUR
                if hour < closed:
                    out.append({"kind": "late", "us": t, **_NONE, "value": value, "event_id": event_id})
                    continue
                self._add(hour, [t, event_id], value)
                seen = max(seen, t)
        border = (seen - self.delay) // HOUR * HOUR  # hours that end by then
        if border > closed:
            out += self._close(border)
            closed = border
        self.border.update((seen, closed))
        if out:
            yield pd.DataFrame({"symbol": key[0], "kind": [o["kind"] for o in out], "ts": pd.to_datetime([o["us"] for o in out], unit="us", utc=True), **{c: pd.Series([o[c] for o in out], dtype=object) for c in _NONE}})

    def _add(self, hour: int, place: list[int], value: float) -> None:
        if not self.hours.containsKey((hour,)):
            self.hours.updateValue((hour,), (place, value, value, value, place, value, [place[1]]))
            return
        first, opened, high, low, last, close, ids = self.hours.getValue((hour,))
        first, last, ids = list(first), list(last), list(ids)
        if place[1] in ids:
            return
        if place < first:
            first, opened = place, value
        if place > last:
            last, close = place, value
        self.hours.updateValue((hour,), (first, opened, max(high, value), min(low, value), last, close, [*ids, place[1]]))

    def _close(self, border: int) -> list[dict]:
        ring = list(self.ring.get()[0]) if self.ring.exists() else []
        done = sorted((k[0], v) for k, v in self.hours.iterator() if k[0] < border)
        out = []
        for hour, (_, opened, high, low, _, close, ids) in done:
            before = ring[-1] if ring else None
            ring = [*ring, close][-self.window :]
            mean = sum(ring) / self.window if len(ring) == self.window else None
            out.append({"kind": "bar", "us": hour, **_NONE, "open": opened, "high": high, "low": low, "close": close, "volume": len(ids), "mean": mean, "change": close / before - 1 if before else None})
            self.hours.removeKey((hour,))
        self.ring.update((ring,))
        return out

    def close(self) -> None:
        pass


def bars_and_late(events: DataFrame, delay_hours: float = 2.0, window: int = 3) -> DataFrame:
    """Columns OUT from a stream of (symbol, ts, value, event_id): each key's closed hours in order, with the mean of the last `window`
    closes and the change from the last one, and the rows that came too late for their bar.

    Every row is either in its hour's bar or comes out as late, so bars are those of the batch without the late rows. The
    stream needs the RocksDB state store. Rows without a time or a value are left out.
    """
    ship(events.sparkSession)
    e = events.where("ts is not null and value is not null and symbol is not null").selectExpr("symbol", "unix_micros(cast(ts as timestamp)) as us", "cast(value as double) as value", "cast(event_id as long) as event_id")
    return e.groupBy("symbol").transformWithStateInPandas(Bars(int(delay_hours * HOUR), window), OUT, outputMode="Append", timeMode="None")


def stale(latest: DataFrame, key: str, ts: str, now: object, hours: float) -> DataFrame:
    """latest (a row a key) with stale: whether its time is more than `hours` before now; a key without a time is stale."""
    from pyspark.sql import functions as F

    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / HOUR
    return latest.withColumn("stale", F.coalesce(age > hours, F.lit(True)))
