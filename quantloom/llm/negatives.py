"""Hard-negative mining: exact search over candidates sorted by norm, with Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .codebooks import matrix, quantized

#: Bytes of the vectors of a bucket, which a task holds; rows of a bucket that are compared at once.
BUCKET_BYTES, SLICE = 32 << 20, 4096
#: A key that stands for none; such rows come last.
NONE = (1 << 63) - 1
SMALL, LARGE = -(1 << 62), 1 << 62


def _kind(bound: float) -> type:
    """A number type in which inner products up to `bound`, and all their partial sums, are exact."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def _best(query: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's first k entries: higher scores first, then smaller keys, then rows."""
    order = np.lexsort((row, key, -score, query))
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


class Bucket:
    """Candidates in the order of falling norms."""

    def __init__(self, rows: list[pa.RecordBatch], width: int):
        t = pa.Table.from_batches(rows).combine_chunks()
        self.v = matrix(t.column("v").combine_chunks(), width)
        self.norm, self.node, self.key, self.label = (t.column(c).to_numpy() for c in ("norm", "node", "key_", "label_"))
        order = np.lexsort((self.node, -self.norm))
        self.v, self.norm, self.node, self.key, self.label = (x[order] for x in (self.v, self.norm, self.node, self.key, self.label))

    def search(self, anchors: pa.RecordBatch, width: int, k: int, same: bool) -> pa.RecordBatch:
        """The first k candidates of every anchor and window (lows, highs: limits that a score has to keep) in this
        bucket; floors: the k-th score that another bucket has for it already. same: of the anchor's label, else of another."""
        a, norm, node, label = matrix(anchors.column("v"), width), *(anchors.column(c).to_numpy() for c in ("norm", "node", "label_"))
        windows = [[np.array(x, np.int64) for x in anchors.column(c).to_pylist()] for c in ("lows", "highs", "floors")]
        many = np.array([len(x) for x in windows[0]])
        owner = np.repeat(np.arange(len(a)), many)  # of each window
        low, high, floor = (np.concatenate(x) if len(owner) else np.zeros(0, np.int64) for x in windows)
        floor = np.maximum(low, floor)
        found = [np.zeros(0, np.int64)] * 4  # window, score, key, candidate's place
        kind = _kind(float(norm.max(initial=0) * self.norm[0]) * 1.001)
        for at in range(0, len(self.node), SLICE):
            part = slice(at, at + SLICE)
            open_ = np.flatnonzero(norm[owner] * self.norm[at] * (1 + 1e-9) >= floor)  # Cauchy-Schwarz: no later one scores more
            if not len(open_):
                break
            theirs = self.v[part].astype(kind).T
            for w in np.array_split(open_, len(open_) // 512 + 1):
                rows, back = np.unique(owner[w], return_inverse=True)
                score = a[rows].astype(kind) @ theirs
                score = (np.clip(score, SMALL, LARGE) if kind is object else score).astype(np.int64)
                fits = (label[rows][:, None] == self.label[part]) == same
                if same:
                    fits &= node[rows][:, None] != self.node[part]
                score = np.where(fits, score, SMALL - 1)[back]
                score[(score < floor[w][:, None]) | (score > high[w][:, None])] = SMALL - 1
                if score.shape[1] > k:  # at most k above their k-th, and what ties with it
                    least = np.partition(score, -k, axis=1)[:, -k]
                    i, j = np.nonzero((score > SMALL - 1) & (score >= least[:, None]))
                else:
                    i, j = np.nonzero(score > SMALL - 1)
                found = [np.append(x, y) for x, y in zip(found, (w[i], score[i, j], self.key[part][j], j + at), strict=True)]
            best = _best(found[0], found[1], found[2], self.node[found[3]], k)
            found = [x[best] for x in found]
            full = np.flatnonzero(np.bincount(found[0], minlength=len(floor)) == k)
            worst = np.full(len(floor), LARGE)
            np.minimum.at(worst, found[0], found[1])
            floor[full] = np.maximum(floor[full], worst[full])
        first = np.cumsum(many) - many
        w, score, key, place = found
        cols = [node[owner[w]], w - first[owner[w]], score, key, self.node[place]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["anchor", "window", "score", "key", "node"])


def _search(bucketed: DataFrame, norms: list[float], width: int, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor, window, score, key, node of the first k candidates of every anchor's windows.

    anchors: node, key_, label_, norm, v, lows, highs. Buckets are numbered by falling norm. An anchor goes to the first
    eighth of the buckets, as far as the largest norms there allow its windows' lower limits, and then to those of the
    others that can still hold something above its k-th score. A task holds one bucket and streams anchors past it;
    what it returns is at most k rows for each anchor and window.
    """
    count = len(norms)
    head = -(-count // 8)

    def sent(a: DataFrame, begin: int, end: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            falling = -np.array(norms[begin:end])
            for b in batches:
                least = np.array([min((max(x, y) for x, y in zip(lo, fl, strict=True)), default=LARGE) for lo, fl in zip(b.column("lows").to_pylist(), b.column("floors").to_pylist(), strict=True)], float)
                own = b.column("norm").to_numpy() * (1 + 1e-9)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(least <= 0, 0, least / own)  # inf for a zero anchor that needs more than 0
                upto = np.searchsorted(falling, -need, side="right")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto.astype(np.int32))], [*b.schema.names, "upto"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in a.schema.fields)
        out = a.mapInArrow(run, f"{kinds}, upto int").where("upto > 0")
        return out.select(F.explode(F.sequence(F.lit(begin), F.col("upto") + F.lit(begin - 1))).alias("bucket"), F.lit(1).alias("side"), *a.columns)

    def wave(a: DataFrame, begin: int, end: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, bucket = None, [], None
            for b in batches:
                number, side = b.column("bucket").to_numpy(), b.column("side").to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0)) + 1), b.num_rows]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi == lo:
                        continue
                    if number[lo] != at:
                        at, held, bucket = number[lo], [], None
                    part = b.slice(lo, hi - lo)
                    if side[lo] == 0:
                        held.append(part)
                    elif held:
                        bucket = bucket or Bucket(held, width)
                        for k0 in range(0, part.num_rows, 2000):
                            yield bucket.search(part.slice(k0, 2000), width, k, same)

        none = F.lit(None).cast("array<bigint>")
        c = bucketed.where(F.col("bucket").between(begin, end - 1)).select("bucket", F.lit(0).alias("side"), "node", "key_", "label_", "norm", "v", none.alias("lows"), none.alias("highs"), none.alias("floors"))
        u = c.unionByName(sent(a, begin, end)).repartition(max(common.tasks(a.sparkSession), end - begin), "bucket").sortWithinPartitions("bucket", "side")
        found = u.mapInArrow(run, "anchor long, window long, score long, key long, node long")
        return common.save(found, "found")

    fresh = anchors.withColumn("floors", F.transform("lows", lambda x: F.lit(SMALL).cast("long")))
    one = wave(fresh, 0, head)
    if head < count:
        best = first_of(one, k).groupBy("anchor", "window").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        best = best.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("least"))  # one entry for each of its windows
        rest = anchors.join(best, anchors["node"] == best["anchor"], "left").drop("anchor")
        floors = F.transform("lows", lambda x, i: F.coalesce(F.try_element_at("least", i.cast("long")), F.lit(SMALL).cast("long")))
        two = wave(rest.withColumn("floors", floors).drop("least"), head, count)
        one = one.unionByName(two)
    return first_of(one, k)


def first_of(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "key", "node")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", column: str = "embedding", label: Column | str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor's, over floor(scale * x). Anchors are the rows where `anchor`
    (over the table's columns) holds. An anchor's positives are its first `positives` other rows of the same label; for
    each, the first `negatives` rows of other labels with least * positive <= 100 * score <= most * positive are
    returned. Higher scores come first, then smaller keys (null ones last).

    Candidates are sorted by norm and cut into buckets of bounded bytes; a bucket is asked only for anchors whose norm
    times its largest one reaches the window's lower limit and the k-th score so far. Exact: bounds only leave out
    what can't count, and products are computed in a type that holds them exactly (components are cut at +-2^31, scores
    at +-2^62).

    Rows with a null label or vector, or with null or non-finite components, take no part. Labels are whole numbers.
    Vectors of different lengths are filled up with zeros. Repeated rows are rows of their own: each is an anchor, and
    a positive or negative of others. An anchor without positives gives no rows. Empty tables give none; other
    columns are only looked at by `anchor` and `label`.
    """
    label = F.col(label) if isinstance(label, str) else label
    q = quantized(vectors, key, column, scale, label.cast("long").alias("label_"), F.coalesce(anchor, F.lit(False)).alias("anchor_")).where("label_ is not null")
    q = q.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    q = common.save(q.withColumn("key_", F.coalesce(F.col("key_").cast("long"), F.lit(NONE))), "scaled")
    rows, longest = q.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(longest or 0, 1)
    count = max(1, min(common.tasks(q.sparkSession), rows // SLICE), -(-rows * width * 8 // BUCKET_BYTES))
    # equal norms are cut as well: the order goes on by a hash
    b = q.repartitionByRange(count, F.desc("norm"), F.xxhash64("key_", "label_", "v")).withColumn("bucket", F.spark_partition_id()).withColumn("node", F.monotonically_increasing_id())
    b = common.save(b, "bucketed")
    norms = {r["bucket"]: r["norm"] for r in b.groupBy("bucket").agg(F.max("norm").alias("norm")).collect()}  # one number for each 32 MB of vectors
    falling: list[float] = []
    for k in range(max(norms, default=-1), -1, -1):
        falling.insert(0, max(norms.get(k, 0.0), falling[0] if falling else 0.0))
    own = ["node", "key_", "label_", "norm", "v"]
    anchors = b.where("anchor_").select(*own, F.array(F.lit(SMALL).cast("long")).alias("lows"), F.array(F.lit(LARGE).cast("long")).alias("highs"))
    cand = b.select("bucket", *own)
    if not falling:
        return q.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    near = common.save(_search(cand, falling, width, anchors, positives, True).select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("score").alias("positive_score"), F.col("key").alias("positive_id")), "positives")
    limits = near.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("window", "positive_score"))), lambda x: x["positive_score"]).alias("p"))  # at most `positives` each
    p = lambda c, share: F.expr(f"transform(p, x -> cast({c}(cast(x as decimal(38, 0)) * {share} / 100) as bigint))")
    windows = anchors.select(*own).join(limits, F.col("node") == F.col("anchor")).select(*own, p("ceil", least).alias("lows"), p("floor", most).alias("highs"))
    windows = common.save(windows, "windows")
    far = _search(cand, falling, width, windows, negatives, False).select("anchor", "window", "rank", F.col("score").alias("negative_score"), F.col("key").alias("negative_id"))
    ids = anchors.select(F.col("node").alias("anchor"), F.col("key_").alias("anchor_id"))
    out = far.join(near, ["anchor", "window"]).join(ids, "anchor")
    named = lambda c: F.nullif(F.col(c), F.lit(NONE)).alias(c)
    return out.select(named("anchor_id"), named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")


def op13_norm_bucketed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: anchors are the ids divisible by 100;
    where an id is divisible by 7, its label is the next one of ten."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(e, F.col("vec_id") % 100 == 0, label=label)


ORACLE_OP13 = """WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
