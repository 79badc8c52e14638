"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """source, source_size -> source, source_size, source_no, weight, target, budget.

    Sources stand by code point, null last, and weigh weights[0], weights[1], ... repeating. They share
    budget = floor(share * all sizes) by weight; no target exceeds max_repeats times its source's size, and
    the excess goes to the others by weight until none is above. The input has one row per source: this is
    the one place where all rows of that small table meet.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy()
    t = sizes.withColumn("source_no", F.row_number().over(by_name))
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumns({"cap": F.col("source_size") * max_repeats, "budget": F.floor(F.sum("source_size").over(every) * F.lit(float(share))).cast("long"), "all_weight": F.sum("weight").over(every)})
    # A source is held at its cap if, with everything filled up to this cap's level, the budget isn't used up.
    upto = W.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumns({"sum_cap": F.sum("cap").over(upto), "sum_weight": F.sum("weight").over(upto)})
    t = t.withColumn("full", F.col("sum_cap") * F.col("weight") + F.col("cap") * (F.col("all_weight") - F.col("sum_weight")) <= F.col("budget") * F.col("weight"))
    level = F.try_divide(
        (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))).cast("double"),
        (F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), F.lit(0))).cast("double"),
    )
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    return t.select("source", "source_size", "source_no", "weight", "target", "budget")


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", extra: str | None = None) -> DataFrame:
    """row_id, doc_id, source, size, ticket and an extra column if asked for of every document; the texts go no further. ticket: the shuffle, md5 of the id."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), common.words(F.col(text)).alias("size"), *([F.col(extra).alias("extra")] if extra else []))
    d = d.withColumns({"row_id": F.monotonically_increasing_id(), "ticket": F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))})
    return common.save(d, "sized")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, buckets: int = 8192, extra: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sized documents with their source's target, queue entries that the mix takes).

    Entries: row_id, doc_id, source, pass_no (0 is a document's first use), size, words (of them taken),
    finish (virtual finish time: the source's words up to the entry's end, over its target), mix_offset
    (words of the mix before the entry). Only each source's last entry and the entry at the budget are cut.

    Each source's documents are shuffled by ticket and read up to max_repeats times; all sources' entries
    are sorted by finish time and the queue ends at the budget. Running sums are taken in two levels: a
    source's 4096 lanes of tickets, and `buckets` ranges of finish time, which hold nearly the same number of
    words each whatever the sources are; a hot source or lane therefore never stands in one task, and the
    tables of lane and bucket sums have a fixed size per source or in all.

    Null and empty texts have size 0 and are never taken. Null sources form a source of their own. Repeated
    rows are documents of their own. An empty table gives empty results. Other columns are not looked at.
    """
    d = sized(docs, key, source, text, extra)
    d = d.withColumn("lane", F.conv(F.substring("ticket", 1, 3), 16, 10).cast("int"))
    lanes = d.groupBy("source", "lane").agg(F.sum("size").alias("lane_size"))
    goal = targets(lanes.groupBy("source").agg(F.sum("lane_size").alias("source_size")), weights, share, max_repeats)
    earlier = W.partitionBy("source").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    lanes = lanes.withColumn("before", F.coalesce(F.sum("lane_size").over(earlier), F.lit(0)))
    lanes = lanes.alias("l").join(goal.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).select("l.source", "l.lane", "l.before", "g.source_size", "g.source_no", "g.target", "g.budget")
    q = d.alias("d").join(lanes.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.lane") == F.col("l.lane"))).select(*[f"d.{c}" for c in d.columns], "l.before", "l.source_size", "l.source_no", "l.target", "l.budget")
    in_lane = W.partitionBy("source", "lane").orderBy("ticket", "doc_id", "size", "row_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    q = common.save(q.withColumn("upto", F.col("before") + F.sum("size").over(in_lane)).drop("before", "lane"), "queue")

    e = q.where("size > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    e = e.withColumn("end", F.col("pass_no") * F.col("source_size") + F.col("upto"))
    e = e.withColumn("words", F.least(F.col("size"), F.floor("target").cast("long") - (F.col("end") - F.col("size")))).where("words > 0")
    e = e.withColumn("finish", F.col("end") / F.col("target"))
    e = e.withColumn("bucket", F.least(F.floor(F.col("finish") * buckets), F.lit(buckets)).cast("int"))
    sums = e.groupBy("bucket").agg(F.sum("words").alias("bucket_words"))
    sums = sums.select("bucket", F.coalesce(F.sum("bucket_words").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("bucket_before"))
    # One row per bucket, at most buckets + 1 of them: small enough to broadcast at any input size.
    e = e.join(F.broadcast(sums), "bucket")
    in_bucket = W.partitionBy("bucket").orderBy("finish", "source_no", "ticket", "doc_id", "pass_no", "row_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.withColumn("mix_offset", F.col("bucket_before") + F.sum("words").over(in_bucket) - F.col("words"))
    e = e.withColumn("words", F.least("words", F.col("budget") - F.col("mix_offset"))).where("words > 0")
    return q, e.select("row_id", "doc_id", "source", "pass_no", "size", "words", "finish", "mix_offset")


def apply(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """docs with each document as often as the mix takes it; an entry that is cut counts if more than half of it is taken.

    Documents are told apart by key, source and text's hash; rows that repeat share what the mix takes of them, as
    evenly as whole times go. Documents without words are never taken. Other columns are kept whatever their names are.
    """
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), F.xxhash64(text).alias("of"))
    sizes, entries = mix(d, "id", "source", "text", extra="of", **options)
    times = entries.where(F.col("words") * 2 > F.col("size")).groupBy("row_id").agg(F.count("*").alias("times"))
    t = sizes.join(times, "row_id", "left").groupBy("doc_id", "source", "extra").agg(F.sum(F.coalesce("times", F.lit(0))).alias("times"), F.count("*").alias("rows")).where("times > 0")
    t = t.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("extra").alias("v"), "times", "rows")
    d = d.drop("text").join(t, F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("of") == F.col("v")))
    once, again = d.where("rows = 1"), d.where("rows > 1")
    # Rows that repeat are numbered in SALTS parts each.
    again = common.save(again.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(common.SALTS)).cast("int")), "repeated")
    k = ["i", "s", "v"]
    parts = again.groupBy(*k, "salt").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy(*k).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"{c}_") for c in [*k, "salt"]], "before")
    same = F.col("i").eqNullSafe(F.col("i_")) & F.col("s").eqNullSafe(F.col("s_")) & (F.col("v") == F.col("v_")) & (F.col("salt") == F.col("salt_"))
    place = F.col("before") + F.row_number().over(W.partitionBy(*k, "salt").orderBy("of"))
    again = again.join(parts, same).withColumn("place", place)
    again = again.withColumn("times", F.floor(F.col("times") / F.col("rows")) + (F.col("place") <= F.col("times") % F.col("rows")).cast("long")).select(*once.columns)
    out = once.unionByName(again).where("times > 0").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc.*")


def op2_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    q, entries = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = entries.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return q.join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


ORACLE_OP2 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS ticket
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS source_no FROM s),
w AS (SELECT *, ((source_no - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap,
             (sum(source_size) OVER ())::BIGINT AS budget FROM n),
c AS (SELECT *, (sum(weight) OVER ())::BIGINT AS all_weight,
             (sum(cap) OVER up)::BIGINT AS sum_cap, (sum(weight) OVER up)::BIGINT AS sum_weight
      FROM w WINDOW up AS (ORDER BY cap / weight, source_no ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, sum_cap * weight + cap * (all_weight - sum_weight) <= budget * weight AS is_full FROM c),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
        (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0))::DOUBLE
        / nullif(all_weight - coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0), 0)::DOUBLE * weight END AS target FROM f),
q AS (SELECT doc_id, size, source_size, target,
             (sum(size) OVER (PARTITION BY d.source ORDER BY ticket, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(size, floor(target)::BIGINT - (upto - size)), 0)
        + greatest(least(size, floor(target)::BIGINT - (source_size + upto - size)), 0)
        + greatest(least(size, floor(target)::BIGINT - (2 * source_size + upto - size)), 0))::BIGINT AS taken
FROM q
"""
