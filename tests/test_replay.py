"""A decision that looks ahead is found with its first day."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quantloom.operators import replay, sweeps
from quantloom.operators import timeseries as ts

DAY = dt.date(2020, 1, 1)


def history(spark):
    rng, rows = random.Random(3), []
    for s in ("a", "b"):
        x = 100.0
        for k in range(200):
            x *= 1 + rng.gauss(0, 0.02)
            rows.append((s, DAY + dt.timedelta(days=k), x))
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def test_planted_look_ahead(spark):
    h = history(spark)
    cuts = spark.createDataFrame([(DAY + dt.timedelta(days=k),) for k in (60, 100, 150)], "cut date")
    key = ["world", "symbol"]
    rise = lambda at: lambda d: d.withColumn("w", (F.col("close") > at).cast("int"))
    cells = [F.col("symbol"), F.col("w")]
    honest = {r.cut: r for r in replay.replay(h, cuts, rise(F.lag("close", 5).over(ts.by(key, "date"))), cells).collect()}
    assert len(honest) == 3 and all(r.different == 0 and r.first is None for r in honest.values())
    assert honest[DAY + dt.timedelta(days=100)].days == 101
    # looks three days ahead: the last three days before a cut can't know what the whole history does
    ahead = F.coalesce(F.lead("close", 3).over(ts.by(key, "date")), F.lit(1e9))
    for r in replay.replay(h, cuts, rise(ahead), cells).collect():
        assert 0 < r.different <= 3 and r.cut - dt.timedelta(days=2) <= r.first <= r.cut
    # a mean over the whole history: days differ from the first on which it matters
    mean = F.avg("close").over(ts.by(key, "date").rowsBetween(-(1 << 63), (1 << 63) - 1))
    assert all(r.different > 0 for r in replay.replay(h, cuts, rise(mean), cells).collect())


def test_worlds_know_nothing_of_each_other(spark):
    h = history(spark)
    cuts = spark.createDataFrame([(DAY + dt.timedelta(days=120),)], "cut date")
    got = sweeps.rotations(replay.worlds(h, cuts), [sweeps.Variant("x", lookbacks=(10,))], world="world")
    alone = sweeps.rotations(h.where(F.col("date") <= DAY + dt.timedelta(days=120)), [sweeps.Variant("x", lookbacks=(10,))])
    a = sorted((r.symbol, r.date, r.h0, r.n0) for r in got.where("world <> 'whole'").collect())
    assert a == sorted((r.symbol, r.date, r.h0, r.n0) for r in alone.collect())
