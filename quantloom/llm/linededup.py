"""Line dedup by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Where a text is cut into lines: after each line break and, inside long lines, after each sentence.
CUT = r"(?<=\n)|(?<=[.!?]\x20)"
#: Characters of a winnowing window, the shortest run that has them, and of a run that is deleted: some 25 words.
#: A single line that has them is a window by itself.
LONG = LEAST = 150
#: Bits of a place that hold the line's number in its document; a string can't have more lines than that in memory.
POS_BITS = 23
#: A window with more than a 1/SPREAD of all repeated places is salted; there are less than SPREAD of these at any size.
SPREAD, SALTS = 10_000, 64


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), CUT)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n"))


def coded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, doc_id, version (hash of the text), h and k once for each id and text that has lines: the hash of each
    line without the white space around it, and the number of lines of the winnowing window from it on, the fewest
    that have LEAST characters; 0 where there is none.

    Lines of white space are left out, so that runs go on across them; positions count the others. row counts the
    documents in the order of id and version. A document's lines are summed where its arrays lie.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("version"), F.filter(F.transform(lines(F.col(text)), bare), lambda x: x != "").alias("l"))
    d = common.save(d.select("doc_id", "version", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", F.length).alias("n")), "lines")
    doc = ["doc_id", "version"]
    upto = W.partitionBy(*doc).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    o = d.repartitionByRange(*doc).dropDuplicates(doc).select(*doc, "n", F.posexplode("h").alias("pos", "h")).withColumn("n", F.get("n", "pos").cast("long"))
    o = o.withColumn("end", F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
    span = W.partitionBy(*doc).orderBy("begin").rangeBetween(0, LEAST - 1)  # the lines that begin before the window may end
    o = o.withColumn("k", F.when(F.last("end").over(span) - F.col("begin") >= LEAST, F.count("*").over(span)).otherwise(0).cast("int"))
    o = o.groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct("pos", "h", "k"))).alias("l")).sortWithinPartitions(*doc)
    o = o.select(*doc, F.col("l.h").alias("h"), F.col("l.k").alias("k"))
    o = common.save(o.withColumn("at", F.monotonically_increasing_id()), "numbered")  # the partition above 33 bits, the row below
    common.drop(d)
    shard = F.shiftright("at", 33)
    sizes = o.groupBy(shard.alias("shard")).count()
    sizes = sizes.select("shard", F.coalesce(F.sum("count").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # One row per partition of the table.
    out = o.withColumn("shard", shard).join(F.broadcast(sizes), "shard").withColumn("row", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    out = out.select("row", "doc_id", "version", "h", "k")
    out.saved_path = o.saved_path
    return out


def windows(d: DataFrame) -> DataFrame:
    """row, from, to, print, code of the winnowing windows, from each line on and up to each line the fewest lines that
    have LEAST characters. print: the window's minimum, the smallest hash of its lines, which is its fingerprint;
    code: a hash of its lines' hashes in their order; a window has LEAST lines at most.

    A run of LEAST characters or more is the union of the windows in it, so it stands at another place just if
    these do. Up to a line where no window from a line on ends, the window begins where the last of these does.
    Lines are exploded and read their document's arrays inside one generated loop.
    """
    p = F.col("pos")
    x = d.select("row", "h", "k", F.posexplode("k").alias("pos", "own")).where("own > 0")
    to, following = p + F.col("own") - 1, F.get("k", p + 1)
    last = F.greatest(to, F.when(following > 0, p + following - 1).otherwise(F.size("h") - 1))
    x = x.select("row", "h", p.alias("from"), F.explode(F.sequence(to, last)).alias("to"))
    own = F.slice("h", F.col("from") + 1, F.col("to") - F.col("from") + 1)
    return x.select("row", "from", "to", F.array_min(own).alias("print"), F.xxhash64(own).alias("code"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, version, runs (array of from, to): the lines to delete from each document that has any, counted without
    lines of white space.

    The windows' positions are joined on their fingerprints: the first place of each window (smallest doc_id, then
    version and position) stays; each later place is joined with the first only, so a run of any number of
    copies gives one row a window. What later places cover is joined into runs. Very common windows are salted.

    Guarantee: a line goes just if it lies in a run of LEAST characters or more that stands at an earlier place too,
    whatever stands around it there.
    """
    d = coded(docs, key, text)
    place = F.shiftleft("row", POS_BITS).bitwiseOR(F.col("from"))
    w = windows(d)
    first = w.groupBy("print", "code").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = common.save(first, "first")
    total = first.agg(F.sum("times")).first()[0] or 0
    salts = F.when(F.col("times") * SPREAD > max(total, SPREAD * 1000), SALTS).otherwise(1)
    first = first.withColumn("salts", salts)
    hot = first.where("salts > 1").select("print", "code", F.col("salts").alias("hot"))  # less than SPREAD rows
    first = first.select("print", "code", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    m = w.join(F.broadcast(hot), ["print", "code"], "left").withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod("row", "hot")).cast("int"))
    m = m.join(first, ["print", "code", "salt"]).where(place != F.col("first")).select("row", "from", "to")
    o = W.partitionBy("row").orderBy("from")
    m = m.withColumn("seen", F.max("to").over(o.rowsBetween(W.unboundedPreceding, -1)))
    m = m.withColumn("island", F.sum(F.coalesce((F.col("from") > F.col("seen") + 1).cast("int"), F.lit(1))).over(o.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = m.groupBy("row", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    runs = common.save(runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs")), "islands")
    out = common.save(d.select("row", "doc_id", "version").join(runs, "row").select("doc_id", "version", "runs"), "runs")
    for t in (d, first, runs):
        common.drop(t)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("lines_in", "lines_out")) -> DataFrame:
    """docs with text without its later repeated runs, and how many lines it had and has, under the names in counts.

    Only the first place of a repeated run of lines (here also sentences) of 150 or more characters stays; order of
    places: smaller id, then line. Rows of equal id and text are one document. Null texts stay null, with no
    lines; empty ones have one empty line. Lines of white space count for nothing: runs go on across them. Long
    texts are handled line by line. An empty table gives no rows. Other columns are kept whatever their names are;
    ones named as the counts are replaced.
    """
    r = repeats(docs, key, text).select(F.col("doc_id").alias("id"), F.col("version").alias("of"), "runs")
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(text).alias("version"))
    own = F.col("doc")[text]
    d = d.join(r.hint("shuffle_hash"), F.col("doc")[key].eqNullSafe(F.col("id")) & (F.col("version") == F.col("of")), "left")
    d = d.select("doc", "runs", F.when(own.isNotNull(), lines(own)).alias("l"))
    # Runs count lines that are not white space; what stands between two lines of a run goes with it.
    at = F.filter(F.transform("l", lambda x, i: F.when(bare(x) != "", i)), lambda i: i.isNotNull())
    d = d.withColumn("at", F.when(F.col("runs").isNotNull(), at))
    d = d.withColumn("runs", F.transform("runs", lambda r: F.struct(F.get("at", r["from"]).alias("from"), F.get("at", r["to"]).alias("to"))))
    stay = F.filter("l", lambda x, i: ~F.exists("runs", lambda r: i.between(r["from"], r["to"])))
    d = d.withColumn("stay", F.when(F.col("runs").isNull(), F.col("l")).otherwise(stay))
    # One row from a generator: a condition on these columns stays above it, else it would take the lines' computation apart.
    n_in, n_out = F.coalesce(F.size("l"), F.lit(0)), F.coalesce(F.size("stay"), F.lit(0))
    left = F.when(F.col("runs").isNull(), own).otherwise(F.array_join("stay", ""))
    d = d.select("doc", F.inline(F.array(F.struct(n_in.alias("n_in"), n_out.alias("n_out"), left.alias("left")))))
    new = {counts[0]: F.col("n_in"), counts[1]: F.col("n_out"), text: F.col("left")}
    return d.select(*[new.pop(c, F.col("doc")[c]).alias(c) for c in docs.columns], *[v.alias(c) for c, v in new.items()])


def op6_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_in, lines_out, chars_in, chars_out, text_md5 of every document after the deletion."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("chars_in", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return dedup(docs).select("doc_id", F.greatest("lines_in", F.lit(0)).cast("long").alias("lines_in"), F.greatest("lines_out", F.lit(0)).cast("long").alias("lines_out"), "chars_in", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars_out"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
