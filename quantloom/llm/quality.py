"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, hashing

#: A log ratio is held in units of 2**-20 as an integer, so that sums don't depend on their order.
UNIT = 1 << 20


def features(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and marks and of all pairs of neighbours in a text, and how many each text has."""
    h, count = hashing.words(texts, marks=True)
    end = np.cumsum(count)
    inner = np.ones(len(h), bool)
    inner[end[count > 0] - 1] = False
    pair = hashing.mixed(h[:-1] * hashing.GOLDEN + h[1:])[inner[:-1]] if len(h) else h
    doc = np.repeat(np.arange(len(texts)), count)
    both = np.concatenate([h, pair]) % np.uint64(buckets)
    order = np.argsort(np.concatenate([doc, doc[:-1][inner[:-1]] if len(h) else doc]), kind="stable")
    return both[order].astype(np.int64), np.maximum(2 * count - 1, 0)


def ratios(docs: DataFrame, labels: DataFrame, key: str, text: str, buckets: int, smooth: float = 4.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket in UNITs: target counts from the documents in `labels` (a
    column of distinct keys, few enough to broadcast), raw counts from all documents. `smooth` counts at even odds are added, so that
    buckets of which the target sample says little stay near 0. Only `buckets` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in (p for b in batches for p in hashing.parts(b, 0)):
            f, n = features(batch.column(0).to_pylist(), buckets)
            raw += np.bincount(f, minlength=buckets)
            target += np.bincount(f[np.repeat(np.array(batch.column(1).to_pylist(), bool), n)], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    labelled = labels.select(F.col(labels.columns[0]).alias("k"), F.lit(True).alias("good"))
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(labelled), "k", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    rows = d.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    c = np.zeros((2, buckets))
    for b, r, t in rows:
        c[:, b] = r, t
    expected = c[0] * (c[1].sum() / max(1.0, c[0].sum()))
    return np.rint(np.log((c[1] + smooth) / (expected + smooth)) * UNIT).astype(np.int64)


def score(texts: list[str | None], ratio: np.ndarray) -> np.ndarray:
    """Of each text the sum of its features' log ratios, in UNITs; 0 without words."""
    f, n = features(texts, len(ratio))
    total = np.concatenate([[0], np.cumsum(ratio[f])])
    end = np.cumsum(n)
    return total[end] - total[end - n]


def noisy(doc: F.Column, units: F.Column, seed: str) -> F.Column:
    """The log ratio plus Gumbel noise drawn from the document's id."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return units / float(UNIT) - F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 16384, slack: float = 8.0, sample: int = 20_000, seed: str = "gumbel:") -> tuple[DataFrame, np.ndarray, float | None]:
    """Every document with doc_id, log_ratio, noisy, rank_no, kept; the ratios; the last kept row's noisy value.

    labels: doc_id, good (boolean), the documents that stand for the target; of more than `sample` good ones,
    `sample` by hash are used, so that they can go to every task. The k best of log_ratio + Gumbel
    noise are kept, a sample without replacement in proportion to the importance weights; k is the number of
    documents whose weight isn't below exp(-slack), so that no document that looks like the target (or has no
    words, weight 1) hangs on the noise. Ranks come from one range-partitioned sort and a sum of the
    partitions' sizes. Rows of equal id and text share one value, are ranked next to each other, and a tie with
    the last kept row is kept. Null and empty texts have log ratio 0. Empty tables give empty results;
    without labels all ratios are 0. Other columns are not looked at.
    """
    pick = F.md5(F.concat(F.lit("sample:"), F.col("k").cast("string")))
    good = labels.where("good").select(F.col("doc_id").alias("k")).distinct().orderBy(pick, "k").limit(sample)
    ratio = ratios(docs, good, key, text, buckets)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in hashing.parts(b, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist(), ratio))], ["doc_id", "units"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    s = common.save(d.mapInArrow(scored, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, units long"), "ratios")
    s = s.withColumn("noisy", noisy(F.col("doc_id"), F.col("units"), seed))
    k = s.where(F.col("units") >= F.lit(-slack * UNIT)).count()
    s = common.save(s.repartitionByRange(F.desc("noisy"), "doc_id").withColumn("shard", F.spark_partition_id()), "ranked")
    sizes = s.groupBy("shard").count().select("shard", F.coalesce(F.sum("count").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    s = s.join(F.broadcast(sizes), "shard").withColumn("rank_no", F.col("before") + F.row_number().over(W.partitionBy("shard").orderBy(F.desc("noisy"), "doc_id")))
    last = s.where(F.col("rank_no") == k).select("noisy").first()
    bar = last[0] if last else None
    out = s.select("doc_id", (F.col("units") / float(UNIT)).alias("log_ratio"), "noisy", F.col("rank_no").cast("long").alias("rank_no"), (F.col("noisy") >= F.lit(bar)).alias("kept") if bar is not None else F.lit(False).alias("kept"))
    return out, ratio, bar


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "gumbel:", **options) -> DataFrame:
    """The documents that resample() keeps, with all their columns: scored once more where they lie instead of joined."""
    _, ratio, bar = resample(docs, labels, key, text, seed=seed, **options)
    if bar is None:
        return docs.limit(0)

    def scored(texts):
        import pandas as pd

        t = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *(score(b.column(0).to_pylist(), ratio) for b in hashing.parts(t, 0))]))

    units = F.pandas_udf(scored, "long")
    return docs.where(noisy(F.col(key), units(F.col(text)), seed) >= F.lit(bar))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents outside the held-out fifth (crc32 of the id's text, modulo 5, is 0)."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", (F.col("quality") == 1).alias("good"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_ratio, noisy, rank_no, kept of every document."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), training_labels(spark, sf_dir))[0]
