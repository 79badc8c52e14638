"""Live bars: any order of arrival gives the batch's bars or lists rows as late, across a restart."""

import datetime as dt
import random

import pytest

from quantloom.streaming import live

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def events(seed, late_share):
    """Rows of three keys over two days, some delivered hours late, some twice."""
    rng = random.Random(seed)
    rows = []
    for k in range(240):
        t = START + dt.timedelta(seconds=rng.randint(0, 2 * 86400))
        rows.append((rng.choice(["a", "a", "b", "c"]), t, float(rng.randint(1, 99)), k))
    arrival = sorted(rows, key=lambda r: (r[1] + dt.timedelta(hours=rng.choice([0, 0, 0.5, 1]) if rng.random() > late_share else rng.uniform(3, 20)), r[3]))
    return rows, arrival + rng.sample(arrival[-20:], 5)


def play(spark, folder, batches):
    """Runs the stream over what lies in the folder after each batch has been added: stops and starts again from its checkpoint."""
    schema = "symbol string, ts timestamp, value double, event_id long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = live.bars_and_late(stream, 2.0, 3).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(live.OUT).parquet(f"{folder}/out").collect()


def batch_bars(rows):
    out = {}
    for s, t, v, i in sorted(rows, key=lambda r: (r[1], r[3])):
        out.setdefault((s, t.replace(minute=0, second=0)), []).append(v)
    return {k: (v[0], max(v), min(v), v[-1], len(v)) for k, v in out.items()}


@pytest.mark.parametrize(("seed", "late_share"), [(1, 0.0), (2, 0.15)])
def test_every_row_is_in_its_bar_or_late(rocks, tmp_path, seed, late_share):
    rows, arrival = events(seed, late_share)
    cut = [arrival[k : k + 41] for k in range(0, len(arrival), 41)]
    got = play(rocks, tmp_path, cut)
    bars = [r for r in got if r.kind == "bar"]
    late = {r.event_id for r in got if r.kind == "late"}
    assert bars and (late_share == 0 or len(late) > 5)
    utc = lambda t: t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t
    keys = [(r.symbol, utc(r.ts)) for r in bars]
    assert len(set(keys)) == len(keys)  # each hour once
    want = batch_bars([r for r in rows if r[3] not in late])
    for r in bars:
        assert (r.open, r.high, r.low, r.close, r.volume) == want[r.symbol, utc(r.ts)]
    closed = {s: max(t for k, t in keys if k == s) for s in "abc"}
    assert {k for k in want if k[1] <= closed[k[0]]} == set(keys)  # none is missing up to the last closed one
    for s in "abc":  # what the ring of closes gives
        own = sorted((r for r in bars if r.symbol == s), key=lambda r: r.ts)
        for k, r in enumerate(own):
            assert r.change == (None if k == 0 else pytest.approx(r.close / own[k - 1].close - 1))
            assert r.mean == (None if k < 2 else pytest.approx(sum(x.close for x in own[k - 2 : k + 1]) / 3))


def test_stale(spark):
    d = spark.createDataFrame([("a", START), ("b", START - dt.timedelta(hours=30)), ("c", None)], "k string, ts timestamp")
    got = {r.k: r.stale for r in live.stale(d, "k", "ts", START + dt.timedelta(hours=1), 26).collect()}
    assert got == {"a": False, "b": True, "c": True}
