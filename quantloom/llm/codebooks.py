"""Vector code compression: product codes whose codebooks are trained by Yinyang Lloyd, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Components beyond this count as this: the squares of larger ones don't fit the result's longs.
MOST = 1 << 31
#: Below this, squared distances of a part are exact in 64 bits; beyond, tasks compute them in Python's integers.
EXACT = 1 << 26


def quantized(vectors: DataFrame, key: str, column: str, scale: int, *more: F.Column) -> DataFrame:
    """key_, more, v (array<long>: floor(scale * x) of each component) of the rows whose vector is neither null nor has null or non-finite components."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), F.lit(True))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), c * scale))).cast("long"))
    return vectors.where(fine).select(F.col(key).alias("key_"), *more, whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of int64 of an Arrow list column, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to all entries."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) >= EXACT:
        x, entries = x.astype(object), entries.astype(object)
    d = x[:, None, :] - entries
    return (d * d).sum(2) if d.shape[2] else np.zeros(d.shape[:2], np.int64)


def groups(entries: np.ndarray, count: int) -> np.ndarray:
    """A group number of each codebook entry: entries near to each other lie in one (a few rounds of Lloyd on the entries themselves)."""
    x = entries.astype(float)
    count = min(count, len(x))
    centres = x[:count].copy()
    for _ in range(5):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        for g in range(count):
            if (own == g).any():
                centres[g] = x[own == g].mean(0)
    return own


def nearest(x: np.ndarray, entries: np.ndarray, group: np.ndarray, own: np.ndarray, low: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each row of x (ties to the lower index), its squared distance, new bounds, and how many
    distances were computed.

    own: the entry of the round before. low[:, g]: no entry of group g but own was nearer than this then. drift: how
    far each entry has moved since. A group is scanned only where its bound, less the farthest that any entry of it has
    moved, isn't above the distance to own. Distances are compared as integers; bounds are rounded towards
    scanning, so that a tie is always scanned.
    """
    n, most = len(x), np.array([drift[group == g].max(initial=0) for g in range(low.shape[1])])
    low = low - most * (1 + 1e-6) - 1e-9
    best = np.zeros(n, object if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) >= EXACT else np.int64)
    for k in np.unique(own):
        best[own == k] = squared(x[own == k], entries[k : k + 1])[:, 0]
    start, old, asked = best.copy(), own, n
    own = own.copy()
    up = np.sqrt(best.astype(float)) * (1 + 1e-6) + 1e-9
    scans = []
    for g in range(low.shape[1]):
        rows, members = np.flatnonzero(low[:, g] <= up), np.flatnonzero(group == g)
        if not len(rows) or not len(members):
            continue
        d = squared(x[rows], entries[members])
        asked += d.size
        k = d.argmin(1)  # the first of equals, and members are in order
        near = d[np.arange(len(rows)), k]
        take = (near < best[rows]) | (near == best[rows]) & (members[k] < own[rows])
        best[rows[take]], own[rows[take]] = near[take], members[k[take]]
        scans.append((g, rows, members, d))
    for g, rows, members, d in scans:
        rest = np.where(members == own[rows][:, None], np.inf, np.sqrt(d.astype(float)) * (1 - 1e-6))
        low[rows, g] = rest.min(1)
    left = np.flatnonzero(own != old)  # what was own is one of its group's others now
    low[left, group[old[left]]] = np.minimum(low[left, group[old[left]]], np.sqrt(start[left].astype(float)) * (1 - 1e-6))
    return own, best, low, asked


def codes(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = 4096, parts: int = 8, size: int = 16, rounds: int = 6, group_count: int = 4) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """(key, label, code, error of every usable vector), the codebooks, and how many distances each pass computed.

    Rows whose vector is null or holds null or non-finite components are left out. Each component becomes
    floor(scale * x). A vector is cut into `parts` equal parts; ones of different lengths are filled up with zeros
    to the longest one, and that to a multiple of `parts`. A part's codebook starts as that part of the `size`
    rows with the smallest keys (null keys last, equal ones in the order of their vectors); with fewer rows there are
    fewer entries. Each round assigns every part to the nearest entry and moves each entry to the floor of the
    mean of its parts; unused ones stay. Repeated rows count as often as they stand there. An empty table gives no
    rows. Other columns are not looked at.

    A pass is one scan without a shuffle: it reads the vectors with their entries and bounds, assigns, and writes them
    with the new ones, and with one more row per task that holds its sums per entry. Only these rows' column is read
    to sum them up: parts * size * (1 + length) numbers, whatever the table's size, go to the driver.
    """
    spark = vectors.sparkSession
    q = common.save(quantized(vectors, key, column, scale, F.col(label).alias("label_")), "whole")
    rows, longest = q.agg(F.count("*"), F.max(F.size("v"))).first()
    width = -(-max(longest or 0, 1) // parts) * parts
    first = q.orderBy(F.col("key_").asc_nulls_last(), "v").limit(size).select("v").collect()  # at most `size` rows
    start = np.zeros((len(first), width), np.int64)
    for row, r in zip(start, first, strict=True):
        row[: len(r["v"])] = r["v"]
    books = [start[:, p * width // parts : (p + 1) * width // parts] for p in range(parts)]
    own_groups = [groups(b, group_count) if len(b) else np.zeros(0, int) for b in books]
    many = [int(g.max(initial=-1)) + 1 for g in own_groups]
    kinds = [q.schema[c].dataType.simpleString() for c in ("key_", "label_")]
    schema = f"key_ {kinds[0]}, label_ {kinds[1]}, v array<bigint>, own binary, low binary, error bigint, sums array<bigint>, asked bigint"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def pass_over(books: list[np.ndarray], drifts: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, asked = np.zeros((parts, len(start), width // parts + 1), np.int64), 0
            types = None
            for batch in batches:
                types = batch.schema
                for at in range(0, batch.num_rows, 4000):
                    b = batch.slice(at, 4000)
                    x, n = matrix(b.column(2), width), b.num_rows
                    fresh = b.num_columns == 3
                    own = np.zeros((n, parts), np.uint8) if fresh else np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, parts)
                    low = np.full((n, sum(many)), -np.inf) if fresh else np.frombuffer(b"".join(b.column(4).to_pylist()), np.float32).reshape(n, -1).astype(float)
                    new, bounds, error, to = [], [], np.zeros(n, object if max(np.abs(x).max(initial=0), *(np.abs(k).max(initial=0) for k in books)) >= EXACT else np.int64), 0
                    for p in range(parts):
                        part = x[:, p * width // parts : (p + 1) * width // parts]
                        o, d, l, c = nearest(part, books[p], own_groups[p], own[:, p].astype(int), low[:, to : to + many[p]], drifts[p])
                        to += many[p]
                        asked += c
                        new.append(o.astype(np.uint8))
                        bounds.append(np.nextafter(l.astype(np.float32), np.float32(-np.inf)))
                        error = error + d
                        for k in np.unique(o):
                            sums[p, k, 0] += (o == k).sum()
                            sums[p, k, 1:] += part[o == k].sum(0)
                    error = np.minimum(error, (1 << 63) - 1).astype(np.int64)
                    own, low = np.stack(new, 1), np.concatenate(bounds, 1)
                    bytes_of = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (own, low)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *bytes_of, pa.array(error), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names)
            if types is not None:
                one = [pa.nulls(1, types.field(0).type), pa.nulls(1, types.field(1).type), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())]
                yield pa.RecordBatch.from_arrays([*one, pa.array([sums.reshape(-1)], pa.list_(pa.int64())), pa.array([asked], pa.int64())], names)

        return run

    table, asked, still = q, [], [np.zeros(len(b)) for b in books]
    drifts = still
    for r in range(rounds + 1 if rows else 0):
        source = table if r == 0 else table.where("sums is null").select("key_", "label_", "v", "own", "low")
        new = common.save(source.mapInArrow(pass_over(books, drifts), schema), f"lloyd{r}")
        common.drop(table)
        table = new
        told = table.where("sums is not null").select("sums", "asked")
        asked.append(told.agg(F.sum("asked")).first()[0])
        if r < rounds:
            total = np.zeros(parts * len(start) * (width // parts + 1), object)
            for pos, value in told.select(F.posexplode("sums").alias("pos", "value")).groupBy("pos").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():  # as many as a codebook has numbers
                total[pos] = int(value)
            total = total.reshape(parts, len(start), -1)
            moved = [np.array([[s // c[0] for s in c[1:]] if c[0] else list(old) for c, old in zip(total[p], books[p], strict=True)], np.int64).reshape(books[p].shape) for p in range(parts)]
            drifts = [np.sqrt(((a - b).astype(float) ** 2).sum(1)) for a, b in zip(moved, books, strict=True)]
            books = moved
    if not rows:
        return spark.createDataFrame([], f"{key} {kinds[0]}, {label} {kinds[1]}, code string, error bigint"), books, asked
    out = table.where("sums is null").select(F.col("key_").alias(key), F.col("label_").alias(label), F.lower(F.hex("own")).alias("code"), "error")
    out.saved_path = table.saved_path
    return out, books, asked


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e).encode()).hexdigest()


def op11_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    c, books, _ = codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # nulls are a label together; a hot label's rows are salted
    c = c.select("vec_id", F.coalesce("label", F.lit(0)).alias("of"), F.col("label").isNull().alias("none"), "code", "error")
    sums = c.groupBy("of", "none").agg(F.sum("error").alias("label_error"))
    out = common.skew_join(c, sums, ["of", "none"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 8, size: int = 16, rounds: int = 6) -> str:
    """The same rows as SQL: one assignment and one move of the codebooks after the other."""
    ctes = [
        "q AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT k, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM q, range({parts}) t(p))",
        f"b0 AS (SELECT p, k - 1 AS e, x AS c FROM p WHERE k <= {size})",
    ]
    dist = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT k, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT k, p.p, x, e, {dist} AS d FROM p JOIN b{r} b ON p.p = b.p) GROUP BY 1, 2)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS c FROM (SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, len(x) + 1) t(i) GROUP BY 1, 2, 3))")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(l.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS c FROM m{r} GROUP BY 1, 2) l ON b.p = l.p AND b.e = l.e)")
    ctes.append(f"code AS (SELECT k, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    ctes.append(f"sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM b{rounds})")
    return "WITH " + ", ".join(ctes) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM q JOIN code USING (k), sha"


ORACLE_OP11 = _oracle()
