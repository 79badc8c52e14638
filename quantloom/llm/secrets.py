"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the contract: kinds in order, their patterns, the group that is measured and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"  # the same matches as [0-9a-f]+ with the shorter ones dropped
KINDS = {"assign": (ASSIGN, 3, 6), "access": (ACCESS, 2, 20), "hex": (HEX, 2, 24)}

#: What the battery looks at: long runs of the characters of the usual encodings; only those with a digit are taken for encoded.
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
# Alphabets by encoding, the first that fits is inferred.
ALPHABETS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Sum of the squared letter frequencies of running text: how far from uniform a token of words is.
TEXT_MATCH = 0.0655
#: Share of running text's letters that a hexadecimal alphabet has.
TEXT_IN_HEX = 0.316
#: Bins of -log10 p in the false-discovery count, per power of ten; smaller p count as the last bin.
PER_TEN, LAST_BIN = 20, 400


def found(text: Column, pattern: str, measured: int, least: int) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches whose measured group has `least`
    characters; code points, end exclusive. \\G ties each match to the end of the one before, so the lengths of
    what lies between add up to positions."""
    inner = r"(?s)\G(.*?)(?:" + pattern + ")"
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(inner), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(inner), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(inner), F.lit(measured)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        end = acc["at"] + F.length(m["all"])
        one = F.struct((acc["at"] + F.length(m["gap"])).alias("start"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(empty)


def _upper(z: str) -> str:
    """SQL for the upper tail of the normal distribution, relative error about 1e-7 (rational Chebyshev fit of erfc)."""
    x, t = f"(abs({z}) / sqrt(2D))", f"(1 / (1 + abs({z}) / (2 * sqrt(2D))))"
    # Fixed values of that fit, highest power first.
    poly = "0.17087277D"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({c}D + {t} * {poly})"
    tail = f"(0.5D * {t} * exp(-{x} * {x} + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def battery(c: DataFrame) -> DataFrame:
    """c with a string column `value` of 20 or more characters -> with p_random and p_text.

    In the inferred encoding's alphabet of k symbols: chi-squared against uniform symbols, runs above and
    below the alphabet's middle, serial correlation of neighbours. p_random: of all three together if the value
    were random (Stouffer). p_text: of a chi-squared as small as this if the value were made of words, whose
    chi-squared grows with the length; times the chance that words keep to a hexadecimal alphabet, where it is one.
    """
    alphabet = F.lit(None).cast("string")
    for pattern, letters in reversed(ALPHABETS):
        alphabet = F.when(F.regexp_like("value", F.lit(pattern)), F.lit(letters)).otherwise(alphabet)
    c = c.withColumn("alphabet", alphabet).withColumn("core", F.regexp_replace("value", "=", "")).withColumn("k", F.length("alphabet").cast("double"))
    c = c.withColumn("v", F.expr("transform(regexp_extract_all(core, '.', 0), x -> CAST(instr(alphabet, x) AS DOUBLE))"))
    c = c.withColumn("n", F.size("v").cast("double"))
    c = c.withColumn("squares", F.expr("aggregate(array_distinct(v), 0D, (a, x) -> a + pow(CAST(size(filter(v, y -> y = x)) AS DOUBLE), 2))"))
    c = c.withColumn("chi", F.expr("squares * k / n - n"))
    c = c.withColumn("z_chi", F.expr("(pow(chi / (k - 1), 1D / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))"))
    c = c.withColumn("high", F.expr("CAST(size(filter(v, x -> x > k / 2)) AS DOUBLE)")).withColumn("pairs", F.expr("zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (a, b) -> named_struct('a', a, 'b', b))"))
    c = c.withColumn("runs", F.expr("1D + size(filter(pairs, p -> (p.a > k / 2) <> (p.b > k / 2)))")).withColumn("mu", F.expr("2 * high * (n - high) / n + 1"))
    c = c.withColumn("z_runs", F.expr("CASE WHEN high = 0 OR high = n THEN sqrt(n) ELSE coalesce(try_divide(runs - mu, sqrt((mu - 1) * (mu - 2) / (n - 1))), 0D) END"))
    c = c.withColumn("mean", F.expr("aggregate(v, 0D, (a, x) -> a + x) / n"))
    c = c.withColumn("z_serial", F.expr("coalesce(try_divide(aggregate(pairs, 0D, (a, p) -> a + (p.a - mean) * (p.b - mean)), aggregate(v, 0D, (a, x) -> a + pow(x - mean, 2))) * sqrt(n), sqrt(n))"))
    c = c.withColumn("z_all", F.expr("(z_chi + (abs(z_runs) - 0.7979D) / 0.6028D + (abs(z_serial) - 0.7979D) / 0.6028D) / sqrt(3D)"))
    c = c.withColumn("extra", F.expr(f"n * (k * {TEXT_MATCH}D - 1)"))
    c = c.withColumn("z_text", F.expr("(chi - (k - 1) - greatest(extra, 0D)) / sqrt(2 * (k - 1) + 4 * greatest(extra, 0D))"))
    return c.withColumn("p_random", F.expr(_upper("z_all"))).withColumn("p_text", F.expr(f"{_upper('(-z_text)')} * CASE WHEN k = 16 THEN pow({TEXT_IN_HEX}D, length(regexp_replace(core, '[0-9]', ''))) ELSE 1 END"))


def _numbered(kind: str, number: int) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(number).alias("kind")))


def _count(number: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == number)).cast("long")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", q: float = 0.01, least_random: float = 0.001) -> DataFrame:
    """doc_id, base, more of every document: arrays of struct<start, end, kind>, kind 0 assign, 1 access, 2 hex, 3 random.

    base are the fixed patterns' matches. more are encoded-looking runs that the battery takes for random
    (p_random at least `least_random`) and that stand against being words at false-discovery rate q, counted over
    all candidates of the table per class of length (Benjamini-Hochberg on binned p, which errs on the strict
    side); runs whose span is a base span already are left out. The bin counts are a fixed number of rows.

    Null and empty texts have no spans. Very long texts are read whole. Repeated rows come back as often as
    they stand in the input; equal runs get equal values. An empty table gives no rows; other columns are
    not looked at.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cols = [found(t, *KINDS[k]).alias(k) for k in KINDS]
    d = docs.select(F.col(key).alias("doc_id"), *cols, F.filter(found(t, CANDIDATE, 2, 20), lambda x: F.regexp_like(x["value"], F.lit("[0-9]"))).alias("candidates"))
    d = common.save(d.withColumn("row_id", F.monotonically_increasing_id()), "spans")
    c = d.select("row_id", F.explode("candidates").alias("c")).select("row_id", "c.start", "c.end", "c.value")
    c = battery(c).withColumn("stratum", F.least(F.floor(F.log2("n")), F.lit(8)).cast("int"))
    c = c.withColumn("bin", F.when(F.col("p_random") >= least_random, F.least(F.floor(-F.log10(F.greatest("p_text", F.lit(1e-300))) * PER_TEN), F.lit(LAST_BIN))).otherwise(-1).cast("int"))
    c = common.save(c.select("row_id", "start", "end", "stratum", "bin"), "candidates")
    bars: dict[int, int] = {}
    bins: dict[int, list[tuple[int, int]]] = {}
    for s, b, n in c.groupBy("stratum", "bin").count().collect():  # at most 5 * 402 rows
        bins.setdefault(s, []).append((b, n))
    for s, each in bins.items():
        m, seen = sum(n for _, n in each), 0
        for b, n in sorted(each, reverse=True):
            seen += n
            if b >= 0 and 10 ** (-b / PER_TEN) <= q * seen / m:
                bars[s] = b
    hit = F.lit(False)
    for s, b in bars.items():
        hit = hit | ((F.col("stratum") == s) & (F.col("bin") >= b))
    more = c.where(hit).groupBy("row_id").agg(F.collect_list(F.struct("start", "end", F.lit(3).alias("kind"))).alias("more"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    base = F.lit(None)
    for number, kind in enumerate(KINDS):
        one = _numbered(kind, number)
        base = one if number == 0 else F.concat(base, one)
    out = d.withColumn("base", base).join(more, "row_id", "left").withColumn("more", F.coalesce("more", empty))
    fresh = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] == m["start"]) & (b["end"] == m["end"])))
    return out.select("doc_id", "base", fresh.alias("more"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in [*KINDS, "random"]])
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    s = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return s.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
