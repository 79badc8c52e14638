"""Embedding near-dedup: randomised-rotation binary codes with correction factors, bounds, exact recomputation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Half width of a confidence bound in standard deviations of the estimate.
EPSILON = 6.0


def rotations(dim: int, count: int, seed: int = 11) -> np.ndarray:
    """count random orthogonal matrices."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def tables(n: int, threshold: float, miss: float, per_bucket: int = 256) -> tuple[int, int]:
    """Bits of a bucket and number of tables: buckets hold about `per_bucket` unrelated vectors at any n, and a
    pair at the threshold shares none of its buckets with probability `miss`."""
    bits = max(4, math.ceil(math.log2(max(2, n) / per_bucket)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def estimate(codes: np.ndarray, factor: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of unit vectors, known by sign code and factor <code, vector>,
    with rotated unit queries; and the half width of their confidence bounds."""
    dim = codes.shape[1]
    est = (codes.astype(np.float32) * np.float32(2) - np.float32(1)) @ queries.T.astype(np.float32) / np.float32(math.sqrt(dim)) / factor[:, None]
    half = EPSILON * np.sqrt((1 - factor**2) / factor**2) / math.sqrt(max(1, dim - 1))
    return est, half[:, None]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links i - j."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            return low


def usable_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id, vector (array<double>, null where it isn't usable), same (a hash of the vector)."""
    v = vectors.select(F.col(key).alias("vec_id"), F.transform(F.col(column), lambda x: x.cast("double")).alias("vector"))
    fine = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) == F.lit(False)
    usable = F.coalesce(fine & F.exists("vector", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are the same coordinate
    v = v.withColumn("vector", F.when(usable, F.transform("vector", lambda x: x + F.lit(0.0))))
    return v.withColumn("same", F.sha2(F.array_join("vector", ","), 256))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = 0.95, miss: float = 1e-6, cell: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Equal vectors form classes; one of each class is compared and all copies count as links. Of each class are
    stored, once: the sign code of its rotated vector with its correction factor, the rotated vector in bytes, and
    its bucket in each of L tables (sign bits of random rotations), so that a pair at the threshold or above is
    missed with probability `miss`. What is dealt to the buckets are the codes: the code and factor of one
    side and the bytes of the other give an unbiased estimate with bounds, both ways round. Members without any
    pair whose upper bounds reach the threshold go there; only the others get their vectors, and only these exact
    values, in double precision, decide. A pair counts in the first table that holds both. A bucket of more
    than `cell` members is cut into blocks and each pair of blocks is a task's work of its own. Tasks return one
    row per member and block (links counted, smallest linked member), never pairs.

    Vectors that are null, zero or hold null or non-finite values have no links and are their own component.
    Vectors of different lengths don't link. Repeated rows of one vec_id, of the same or of different vectors, are
    one vector each and count as links of each other if they link. An empty table gives no rows; other columns are
    not looked at.
    """
    v = common.save(usable_vectors(vectors, key, column), "vectors")
    reps = v.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    reps = common.save(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    stats = reps.agg(F.count("*"), F.collect_set(F.size("vector"))).first()
    bits, count = tables(stats[0], threshold, miss)
    found = reps.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root")).limit(0)
    for dim in sorted(stats[1]):
        found = found.unionByName(_linked(reps.where(F.size("vector") == dim), dim, bits, count, threshold, cell))
    found = common.save(found, "near")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = common.components(found.where("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v")))
    c = reps.select("same", "node", "low", "copies").join(links, "node", "left").join(comp.withColumnRenamed("id", "node"), "node", "left")
    c = common.save(c.withColumn("component", F.coalesce("component", "node")), "linked")
    c = common.skew_join(c, c.groupBy("component").agg(F.min("low").alias("component_id")), ["component"])
    c = common.save(c.select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "classes")
    out = common.skew_join(v.select("vec_id", "same"), c, ["same"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def coded(reps: DataFrame, dim: int, bits: int, count: int) -> DataFrame:
    """node, code (sign bits), factor (<code, vector>), turned (the rotated vector in signed bytes), scale (of these), buckets of each class."""
    turn = rotations(dim, max(1, -(-bits * count // dim)))
    planes = turn.transpose(1, 0, 2).reshape(dim, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                x = np.array(b.column(1).to_pylist(), float).reshape(-1, dim)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                turned, sign = x @ turn[0], (x @ planes)[:, : bits * count] >= 0
                scale = np.abs(turned).max(1, keepdims=True) / 127
                cols = [np.packbits(turned >= 0, axis=1), np.rint(turned / scale).astype(np.int8)]
                buckets = (sign.reshape(len(x), count, bits) @ (1 << np.arange(bits))).astype(np.int32)
                code, small = (pa.array([r.tobytes() for r in c], pa.binary()) for c in cols)
                yield pa.RecordBatch.from_arrays([b.column(0), code, pa.array(np.abs(turned).sum(1) / math.sqrt(dim)), small, pa.array(scale[:, 0]), pa.array(list(buckets), pa.list_(pa.int32()))], ["node", "code", "factor", "turned", "scale", "buckets"])

    return reps.select("node", "vector").mapInArrow(run, "node long, code binary, factor double, turned binary, scale double, buckets array<int>")


def _blocks(t: pa.Table) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Table number, whether it is one block of a bucket with itself, and rows of each block."""
    cells = np.stack([t.column(k).to_numpy() for k in ("t", "bucket", "lo", "hi")])
    order = np.lexsort(cells)
    edge = np.flatnonzero(np.append(True, (cells[:, order][:, 1:] != cells[:, order][:, :-1]).any(0)))
    for member in np.split(order, edge[1:]):
        if len(member) > 1:
            yield int(cells[0, member[0]]), bool(cells[2, member[0]] == cells[3, member[0]]), member


def _apart(rows: np.ndarray, one: bool, side: np.ndarray) -> np.ndarray:
    """Which pairs of rows with all members are looked at: each once, from its smaller place; across blocks, from side 0 to side 1 only."""
    return (rows[:, None] < np.arange(len(side))) if one else (side[rows][:, None] == 0) & (side == 1)


def _linked(reps: DataFrame, dim: int, bits: int, count: int, threshold: float, cell: int) -> DataFrame:
    """node, links (copies of other classes linked), root, once per member and block with a link."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        code, turned = (np.frombuffer(b"".join(t.column(k).to_pylist()), d).reshape(t.num_rows, -1) for k, d in (("code", np.uint8), ("turned", np.int8)))
        factor, scale, side = (t.column(k).to_numpy() for k in ("factor", "scale", "side"))
        keep = np.zeros(t.num_rows, bool)
        for _, one, m in _blocks(t):
            signs, other, f = np.unpackbits(code[m], axis=1, count=dim), turned[m] * scale[m, None], factor[m]
            slack = math.sqrt(dim) / 2 * scale[m]  # of the bytes' rounding, before the division by a factor
            for at in range(0, len(m), 512):
                rows = np.arange(at, min(at + 512, len(m)))
                est, half = estimate(signs[rows], f[rows], other)
                near = est + half + slack / f[rows, None] >= threshold
                est, half = estimate(signs, f, other[rows])
                near &= (est + half + slack[rows] / f[:, None]).T >= threshold
                near &= _apart(rows, one, side[m])
                keep[m[rows[near.any(1)]]] = True
                keep[m[near.any(0)]] = True
        yield from t.select(["node", "t", "bucket", "lo", "hi", "side"]).filter(pa.array(keep)).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        node, copies, side = (t.column(k).to_numpy() for k in ("node", "copies", "side"))
        x = np.array(t.column("vector").to_pylist(), float).reshape(-1, dim)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        buckets = np.array(t.column("buckets").to_pylist()).reshape(-1, count)
        out: list[np.ndarray] = []
        for table, one, m in _blocks(t):
            y, links, left, right = x[m], np.zeros(len(m), np.int64), [], []
            for at in range(0, len(m), 512):
                rows = np.arange(at, min(at + 512, len(m)))
                i, j = np.nonzero((y[rows] @ y.T >= threshold - 1e-9) & _apart(rows, one, side[m]))
                i = rows[i]
                fresh = ~(buckets[m[i], :table] == buckets[m[j], :table]).any(1) if table else np.ones(len(i), bool)
                i, j = i[fresh], j[fresh]
                exact = np.einsum("ij,ij->i", y[i], y[j]) >= threshold
                left.append(i[exact])
                right.append(j[exact])
            i, j = np.concatenate(left), np.concatenate(right)
            if len(i):
                np.add.at(links, i, copies[m[j]])
                np.add.at(links, j, copies[m[i]])
                by_id = np.argsort(node[m], kind="stable")
                place = np.empty(len(m), np.int64)
                place[by_id] = np.arange(len(m))
                root = by_id[_roots(len(m), place[i], place[j])]
                k = np.flatnonzero(links)
                out.append(np.stack([node[m[k]], links[k], node[m[root[place[k]]]]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], ["node", "links", "root"])

    codes = common.save(coded(reps, dim, bits, count), "codes")
    d = codes.select("node", "code", "factor", "turned", "scale", F.posexplode("buckets").alias("t", "bucket"))
    hot = d.groupBy("t", "bucket").agg(F.count("*").alias("members")).where(F.col("members") > cell).withColumn("blocks", F.ceil(F.col("members") / cell).cast("int"))
    d = d.join(hot.select("t", "bucket", "blocks"), ["t", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    d = d.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = ["t", "bucket", "lo", "hi"]
    d = d.select("node", "code", "factor", "turned", "scale", "t", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    rows = codes.count() * count  # partitions are sized by the data: a task holds its own
    near = common.save(d.repartition(rows // 200_000 + 1, *cells).mapInArrow(screen, "node long, t int, bucket int, lo int, hi int, side int"), "open")
    rows = near.count()
    near = near.join(reps.select("node", "copies", "vector").join(codes.select("node", "buckets"), "node"), "node")
    return near.repartition(rows // 50_000 + 1, *cells).mapInArrow(compare, "node long, links long, root long")


def op9_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
