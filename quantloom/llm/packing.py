"""Packing by lexical retrieval: a sharded BM25 inverted index gives each seed its unused neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

_PIECE = ["doc_id", "doc_tokens", "start", "ids"]


class Index:
    """BM25 over one shard: fragments are the documents, token ids the terms."""

    def __init__(self, fragments: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(fragments)
        sizes = np.array([len(f) for f in fragments])
        doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
        term = np.concatenate(fragments).astype(np.int64)
        pair, tf = np.unique(term * n + doc, return_counts=True)
        self.doc, terms = (pair % n).astype(np.int32), pair // n  # postings, by term
        self.first = np.searchsorted(terms, np.arange(term.max() + 2))
        df = np.diff(self.first)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[self.doc] / sizes.mean()))
        by_doc = np.argsort(self.doc, kind="stable")
        self.terms, self.term_first = terms[by_doc], np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.n = n

    def drop(self, left: np.ndarray) -> None:
        """Keeps the postings of the fragments that are left; their scores stay as they are."""
        keep = left[self.doc]
        self.first = np.concatenate(([0], np.cumsum(keep)))[self.first]
        self.doc, self.weight = self.doc[keep], self.weight[keep]

    def scores(self, seed: int) -> np.ndarray:
        """Of all fragments of the shard for the seed's distinct terms."""
        query = self.terms[self.term_first[seed] : self.term_first[seed + 1]]
        count = self.first[query + 1] - self.first[query]
        at = np.repeat(self.first[query] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill(fragments: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (fragment, from, to). Each seed's best unused neighbours fill its window; the last
    one is cut where the window ends and what is left of it stays in the index. Only the shard's last window
    can be short."""
    index, n = Index(fragments), len(fragments)
    size, done, left = np.array([len(f) for f in fragments]), np.zeros(n, np.int64), np.ones(n, bool)
    indexed = n
    for seed in range(n):
        while left[seed]:
            room, parts = window, []
            order: Iterator[int] = iter([seed])
            ranked = False
            while room:
                d = next(order, None)
                if d is None:
                    if ranked or not left.any():
                        break
                    if (many := int(left.sum())) < 0.85 * indexed:
                        index.drop(left)
                        indexed = many
                    s = np.where(left, index.scores(seed), -1.0)
                    order, ranked = iter(np.argsort(-s, kind="stable")[:many]), True
                    continue
                take = min(room, size[d] - done[d])
                parts.append((int(d), int(done[d]), int(done[d] + take)))
                done[d] += take
                room -= take
                left[d] = done[d] < size[d]
            yield parts


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, window: int = 1024, shard: int = 1024) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence of at most `window` ids.

    Returns doc_id, doc_tokens (its ids with the end id), start (the document's ids before the piece), ids
    (little-endian unsigned 32-bit integers), sequence_id, offset (of the piece in its sequence, gapless).

    A document's full windows are sequences of their own. Its rest, shorter than a window, is a fragment:
    fragments are dealt out by ranges of a min-hash of their token 4-grams, which puts copies side by side
    without ever putting a group of copies into one task, and each run of `shard` fragments is an inverted
    index of bounded size. Null and empty texts are the end id alone; repeated rows are documents of their
    own; an empty table gives no pieces; other columns are not looked at.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def encoded(texts: pa.Array) -> Iterator[bytes]:
            for ids in encoder.encode(texts, end):
                yield from (x.as_py() for x in ids)

        mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            rows = []
            for d, own in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                n = len(own) // 4
                for k in range(0, n - n % window, window):
                    rows.append((d, n, k, own[4 * k : 4 * (k + window)], None))
                if n % window:
                    v = np.frombuffer(own, "<u4")[n - n % window :].astype(np.uint64)
                    h = v[:1] if len(v) < 4 else ((v[:-3] * mix + v[1:-2]) * mix + v[2:-1]) * mix + v[3:]
                    h = (h ^ h >> np.uint64(31)) * mix
                    rows.append((d, n, n - n % window, own[4 * (n - n % window) :], int(((h ^ h >> np.uint64(29)).min(keepdims=True) * mix >> np.uint64(1))[0])))
                if len(rows) >= 2000:
                    yield table(rows, batch.schema.field(0).type)
                    rows = []
            if rows:
                yield table(rows, batch.schema.field(0).type)

    def table(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64())], [*_PIECE, "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens.encoder.cache_clear()  # all texts are encoded by now; idle workers would keep the words
        sequence = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            t = pa.Table.from_batches(held).combine_chunks()
            doc, count, start, raw = (t.column(k).to_pylist() for k in _PIECE)
            frag = [np.frombuffer(r, "<u4") for r in raw]
            out = []
            for parts in fill(frag, window):
                at = 0
                for d, a, b in parts:
                    out.append((doc[d], count[d], start[d] + a, raw[d][4 * a : 4 * b], 2 * sequence, at))
                    at += b - a
                sequence += 1
            held.clear()
            cols = list(zip(*out, strict=True))
            kinds = [t.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*_PIECE, "sequence_id", "offset"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, shard - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == shard:
                    yield flush()
        if held:
            yield flush()

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    cut_up = common.save(d.mapInArrow(cut, f"doc_id {kind}, doc_tokens long, start long, ids binary, near long"), "pieces")
    full = cut_up.where("near is null").select(*_PIECE, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut_up.where("near is not null").repartitionByRange("near", "doc_id", "start").sortWithinPartitions("near", "doc_id", "start").select(*_PIECE)
    return full.unionByName(rest.mapInArrow(pack, f"doc_id {kind}, doc_tokens long, start long, ids binary, sequence_id long, offset long"))


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    p = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return p.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
