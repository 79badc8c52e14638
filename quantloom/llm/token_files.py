"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens

#: Two control bits per value hold its number of bytes less one; a control byte holds four values, the first in its low bits.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Unsigned 32-bit values -> control bytes, data bytes."""
    v = np.ascontiguousarray(values, dtype="<u4")
    code = np.zeros(-len(v) % 4 + len(v), dtype=np.uint8)
    code[: len(v)] = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) <= code[: len(v), None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values: lengths by table lookup on the control bytes, places by a running sum, bytes by gathering."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(length, dtype=np.int64)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = end - length
    out = raw[at].astype(np.uint32)
    for k in range(1, int(length.max(initial=1))):
        out |= np.where(length > k, raw[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenized(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, the end id last), encoded once and kept in the shared folder."""

    def encode_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at = 0
            for ids in encoder.encode(batch.column(1), end):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids], ["doc_id", "ids"])
                at += len(ids)

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return common.save(d.mapInArrow(encode_texts, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids binary"), "ids")


def rank_table(ids: DataFrame) -> DataFrame:
    """rank, token, uses of every token of all documents, the most used first (ties: smaller id first)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=len(total))
            part[: len(total)] += total
            total = part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "uses"])

    uses = ids.select("ids").mapInArrow(count, "token long, uses long").groupBy("token").agg(F.sum("uses").alias("uses"))
    return uses.select((F.row_number().over(W.orderBy(F.desc("uses"), "token")) - 1).alias("rank"), "token", "uses")


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Writes token files: path/ranks (rank, token, uses) and path/shards, whose part files hold the documents by ascending key.

    A row of a shard is a document: doc_id, shard, pos (its place in the shard), n_tokens (with the end id),
    control, data. The rank table has at most one row per vocabulary entry and goes to the driver and the
    tasks whole. Documents are dealt out by ranges of the key, so that no shard depends on how ids are spread
    and a hot source or long text only fills its own shard. Null and empty texts have the end id only; null
    keys come first; rows of equal key keep an arbitrary but stored order; no rows give empty files; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    ids = tokenized(docs, key, text, tokenizer, end_id)
    rank_table(ids).write.parquet(f"{path}/ranks")
    rows = spark.read.parquet(f"{path}/ranks").select("rank", "token").collect()  # bounded by the vocabulary
    rank_of = np.zeros(max([end_id, *(r.token for r in rows)]) + 1, np.uint32)
    rank_of[[r.token for r in rows]] = [r.rank for r in rows]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [rank_of[np.frombuffer(x, "<u4")] for x in batch.column(1).to_pylist()]
            coded = [encode(v) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in values], pa.int64()), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())], ["doc_id", "n_tokens", "control", "data"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    d = ids.mapInArrow(pack, f"doc_id {kind}, n_tokens long, control binary, data binary")
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    place = F.monotonically_increasing_id()  # the partition above 33 bits, the row below
    d = d.select("doc_id", F.shiftright(place, 33).cast("int").alias("shard"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), "n_tokens", "control", "data")
    d.write.option("compression", "zstd").parquet(f"{path}/shards")
    common.drop(ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, pos, n_tokens, ids (little-endian unsigned 32-bit integers) of every document in the token files."""
    rows = spark.read.parquet(f"{path}/ranks").select("rank", "token").collect()  # bounded by the vocabulary
    token_of = np.zeros(len(rows), "<u4")
    token_of[[r.rank for r in rows]] = [r.token for r in rows]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, shard, pos, n, control, data = batch.columns
            ids = [token_of[decode(c, d, k)].tobytes() for c, d, k in zip(control.to_pylist(), data.to_pylist(), n.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc, shard, pos, n, pa.array(ids, pa.binary())], ["doc_id", "shard", "pos", "n_tokens", "ids"])

    shards = spark.read.parquet(f"{path}/shards")
    kind = shards.schema["doc_id"].dataType.simpleString()
    return shards.select("doc_id", "shard", "pos", "n_tokens", "control", "data").mapInArrow(unpack, f"doc_id {kind}, shard int, pos long, n_tokens long, ids binary")


def with_start(docs: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before, from shard, pos and n_tokens: sums of shards first (one row a shard), then inside each."""
    shards = docs.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("shard_start"))
    inside = W.partitionBy("shard").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return docs.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shards, "shard").withColumn("start", F.col("start") + F.col("shard_start")).drop("shard_start")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files as read back."""
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    got = common.save(read(spark, path).select("doc_id", "shard", "pos", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-sums")
    return with_start(got).select("doc_id", "start", "n_tokens", "ids_crc32")
