"""Shared pieces: tables in the cluster's shared folder, connected components, exact top-k, word patterns."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark removes a query's shuffle files as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only where all tasks run in the driver's
    own process (master local) may it be unset; then it is a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quantloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quantloom-{spark.sparkContext.applicationId}"


def save(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors.

    The shuffle files of the write are removed when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that save() wrote, once nothing reads it any more."""
    path = getattr(df, "saved_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that tasks need no install or PYTHONPATH."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in root.rglob("*.py"):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query, after ship()."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: what the session has for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column | str) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key with more rows than HOT is salted in skew_join; the MOST with the most rows are, any other has less than a
#: MOST-th of all rows.
HOT, MOST, SALTS = 5_000, 10_000, 64


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys (inner or left), whatever share of left's rows one key has.

    left should be a saved table, as it is read twice; right has few rows a key. The rows of hot keys, at most MOST
    of them, are dealt to SALTS parts on the left and repeated for each part on the right.
    """
    rows = left.groupBy(*keys).agg(F.count("*").alias("rows_")).where(F.col("rows_") > HOT).orderBy(F.desc("rows_")).limit(MOST).collect()
    if not rows:
        return left.join(right, keys, how)
    hot = left.sparkSession.createDataFrame(rows, left.select(*keys, F.lit(0).cast("long").alias("rows_")).schema).select(*keys, F.lit(True).alias("hot_"))
    a = left.join(F.broadcast(hot), keys, "left").withColumn("salt_", F.when(F.col("hot_"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot_")
    b = right.join(F.broadcast(hot), keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.when(F.col("hot_"), SALTS - 1).otherwise(0)))).drop("hot_")
    return a.join(b, [*keys, "salt_"], how).drop("salt_")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: columns u, v (orderable ids, either direction, loops and repeats allowed, nulls ignored).
    Returns id, component (the smallest id reachable) for every id that stands in an edge between two
    different ids. Each round is two joins on node ids: minima are pre-aggregated per task and the edges of a hub
    with many of them are salted; rounds are written to the shared folder. The number of rounds grows with the
    logarithm of the longest chain.
    """
    e = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        flipped = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = e.unionByName(flipped).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = skew_join(flipped, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = save(small, "cc")
        drop(e)
        e = new
        # settled: every node has one edge down, and none leads to a node that has one
        ends = e.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not ends.agg(F.bool_or((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0]:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
