"""N-gram Jaccard join by vertical partitioning: the global n-gram order is cut into fragments, overlaps are
counted fragment by fragment and summed per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

#: Bits of the table of the most frequent n-grams, and how many of its buckets are in use at most: 2 MB at any input size.
FREQUENT_BITS, FREQUENT = 24, 1 << 20
#: n-grams that are counted at once in a task, and rows of the inverted index in one.
COUNTED, POSTINGS = 4 << 20, 500_000
#: Sets that a task remembers so as to send no copy of them.
KNOWN = 1 << 19
#: n-grams in a block of a family's sets, and sets in one; sets and n-grams that are compared in one product.
BLOCK, BLOCK_SETS = 500_000, 5_000
STEP, COLUMNS = 1024, 4096
_NEED, _OF = 80, 100


def _sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    h, count = hashing.words(texts)
    end = np.cumsum(count)
    for e, n in zip(end.tolist(), count.tolist(), strict=True):
        yield hashing.shingles(h[e - n : e], width)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set; equal sets, equal signatures."""
    a = hashing.mixed(s + hashing.GOLDEN)
    b = hashing.mixed(hashing.mixed(s ^ hashing.GOLDEN) * hashing.GOLDEN)
    n = np.uint64(len(s))
    return tuple(int(hashing.mixed(x.sum(keepdims=True) + n).view(np.int64)[0]) for x in (a, b))


def least_shared(n):
    """How many n-grams of their prefixes two linked sets share at least, the smaller one having n."""
    return n // 20 + 1


def _first(n: int) -> int:
    """Length of the prefix of a set of n n-grams."""
    return n - -(-_NEED * n // _OF) + least_shared(n)


def _fits(a: Column, b: Column) -> Column:
    return F.lit(_OF) * F.least(a, b) >= F.lit(_NEED) * F.greatest(a, b)


def _needed(a: Column, b: Column) -> Column:
    """How many n-grams of their fronts two linked sets of a and b n-grams share at least: what they must share in all,
    4 / 9 of both sizes, less what can lie behind the front that ends first in the order."""
    behind = [n - F.floor(n / 5) - F.floor(n / 20) - 1 for n in (a, b)]
    return F.ceil((a + b) * 4 / 9) - F.greatest(*behind)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, sig, n, late) in the order of token and sig those whose token is late or stands in another set
    too, each once; only the last row of a batch is held."""
    held, out = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        token, sig = cols[:2]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])))
        cols = [c[fresh] for c in cols]
        token = cols[0]
        change = token[1:] != token[:-1]
        first = np.concatenate(([True], change))
        give = ~(first & np.concatenate((change, [True]))) | cols[3]
        if out:
            give[0] = False
        held = [c[-1:] for c in cols]
        out = bool(give[-1]) or (out and len(token) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(c[give]) for c in cols], ["token", "sig", "n", "late"])


def _shared_counts(rows: np.ndarray, tokens: np.ndarray, n_rows: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each of the sets `left` shares with each of `right`. rows, tokens: which set holds which n-gram."""
    place = np.full((2, n_rows), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    mine, theirs = place[:, rows]
    kept = np.intersect1d(tokens[mine >= 0], tokens[theirs >= 0])
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(kept):
        return out
    column = np.searchsorted(kept, tokens)
    hit = kept[np.minimum(column, len(kept) - 1)] == tokens
    for c in range(0, len(kept), COLUMNS):
        width = min(COLUMNS, len(kept) - c)
        inside = hit & (column >= c) & (column < c + width)
        sides = []
        for side, of in ((mine, left), (theirs, right)):
            m, on = np.zeros((len(of), width), np.float32), inside & (side >= 0)
            m[side[on], column[on] - c] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _block(table: pa.Table) -> pa.Table:
    """Of a block's sets (sig, more, label, first, tokens) those that link and are in different components, the ones marked
    first with all others; of each two components one link."""
    table = table.combine_chunks()
    sig, label, first = (table.column(k).to_numpy() for k in ("sig", "label", "first"))
    one, at, own = np.unique(sig, return_index=True, return_inverse=True)
    more, label, lists = table.column("more").to_numpy()[at], label[at], table.column("tokens").take(pa.array(at)).combine_chunks()
    n = lists.value_lengths().to_numpy().astype(np.int64)
    rows, tokens = np.repeat(np.arange(len(one)), n), lists.flatten().to_numpy()
    token, tokens = np.unique(tokens, return_inverse=True)
    common_ = np.bincount(tokens, minlength=len(token)) > 1
    rows, tokens = rows[common_[tokens]], tokens[common_[tokens]]
    lefts, rights = np.unique(own[first]), np.unique(own[~first])
    lefts, rights = lefts[np.argsort(n[lefts], kind="stable")], rights[np.argsort(n[rights], kind="stable")]
    links: dict[tuple[int, int], tuple[int, int]] = {}
    for a in range(0, len(lefts), STEP):
        x = lefts[a : a + STEP]
        near = rights[(_OF * n[rights] >= _NEED * n[x[0]]) & (_NEED * n[rights] <= _OF * n[x[-1]])]
        for b in range(0, len(near), STEP):
            y = near[b : b + STEP]
            shared = _shared_counts(rows, tokens, len(one), x, y).astype(np.int64)
            i, j = np.nonzero((_OF * shared >= _NEED * (n[x][:, None] + n[y] - shared)) & (label[x][:, None] != label[y]))
            for k, m in zip(x[i].tolist(), y[j].tolist(), strict=True):
                links.setdefault((label[k], label[m]), (k, m))
    k, m = (np.array([p[e] for p in links.values()], np.int64) for e in (0, 1))
    return pa.table({c: pa.StructArray.from_arrays([pa.array(one[e]), pa.array(more[e])], ["sig", "more"]) for c, e in (("u", k), ("v", m))})


class Join:
    """Links between the sets of n-grams of documents whose Jaccard similarity is 0.8 or more.

    Classes of equal sets count as one member throughout. The global order of n-grams puts the most frequent ones
    (a table of fixed size, by counts over all documents) after all others and is by hash otherwise. It is cut into
    vertical fragments: of each set the part that falls to the front, its first n - ceil(0.8 n) + n // 20 + 1
    n-grams, and `fragments` ranges of hashes.

    Front fragment: any two sets that link share n // 20 + 1 of these n-grams at least (n of the smaller set), in
    whatever order. Each range of n-grams is dealt to a task of its own as an inverted index; what only one set
    holds goes at once, then sets with too few shared n-grams, and n-grams that only one of the other sets
    holds. Partial overlaps of pairs are counted n-gram by n-gram and summed per pair, and pairs with too few go.

    Ranges: for pairs that are left, each range gives its partial overlap, and their sum over all ranges decides
    exactly.

    An n-gram that more than `small` sets share gives no pairs. Its `hubs` members with the most shared n-grams are
    compared with all others at first, which joins a family of copies at one pair a member. n-grams of the same first
    hub are one family then: where its members are in several components, those outside of the largest one are compared
    with all, block by block, and of each two components at most one link comes out of a block. So no pairs of a
    family's members are written out, and no link is lost.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, small: int = 4, fragments: int = 8, hubs: int = 1):
        self.docs = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
        self.width, self.small, self.fragments, self.hubs = width, small, fragments, max(1, hubs)
        self.kind = self.docs.schema["doc_id"].dataType.simpleString()

    def members(self) -> DataFrame:
        """doc_id, version (hash of the text), n_shingles, sig and more (the signature's halves; null for an empty set) of every document."""
        width, kind = self.width, self.kind

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (p for b in batches for p in hashing.parts(b, 2)):
                rows = [(len(s), *(_signature(s) if len(s) else (None, None))) for s in _sets(batch.column(2).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", "version", "n_shingles", "sig", "more"])

        return common.save(self.docs.mapInArrow(sign, f"doc_id {kind}, version long, n_shingles long, sig long, more long"), "members")

    def frequent(self, least: int = 4) -> np.ndarray:
        """A bit for each bucket of the n-grams that are the most frequent ones. Counted are those that `least` different
        sets share among COUNTED n-grams of a task; the FREQUENT buckets with the largest counts stay."""
        width, shift = self.width, np.uint64(64 - FREQUENT_BITS)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            size = 0

            def flush() -> pa.RecordBatch:
                token, uses = np.unique(np.concatenate(list(held.values())), return_counts=True)
                many = uses >= least
                return pa.RecordBatch.from_arrays([pa.array((token[many] >> shift).astype(np.int64)), pa.array(uses[many].astype(np.int64))], ["bucket", "uses"])

            for batch in (p for b in batches for p in hashing.parts(b, 0)):
                for s in _sets(batch.column(0).to_pylist(), width):
                    if len(s) and held.setdefault(_signature(s)[0], s) is s:
                        size += len(s)
                if size >= COUNTED:
                    yield flush()
                    held, size = {}, 0
            if held:
                yield flush()

        counts = common.save(self.docs.select("text").mapInArrow(count, "bucket long, uses long").groupBy("bucket").agg(F.sum("uses").alias("uses")), "frequent")
        level = F.floor(F.log2("uses") * 8).cast("int")
        left, cut = FREQUENT, 0
        for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # a row per eighth of a power of two
            left -= r["count"]
            if left < 0:
                cut = r.level + 1
                break
        rows = counts.where(level >= cut).select("bucket").toPandas()  # at most FREQUENT numbers
        common.drop(counts)
        bits = np.zeros(1 << FREQUENT_BITS, bool)
        bits[rows["bucket"].to_numpy(np.int64)] = True
        return np.packbits(bits)

    def front(self, members: DataFrame, frequent: np.ndarray) -> DataFrame:
        """token, sig, n, late (is a frequent one): the n-grams of the front fragment that can be shared, for each set that holds them."""
        width, shift = self.width, np.uint64(64 - FREQUENT_BITS)
        sent = self.docs.sparkSession.sparkContext.broadcast(frequent)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, known = np.unpackbits(sent.value).astype(bool), set()
            for batch in (p for b in batches for p in hashing.parts(b, 0)):
                rows = []
                for s in _sets(batch.column(0).to_pylist(), width):
                    n = len(s)
                    if not n or (g := _signature(s)[0]) in known:  # copies in other tasks are dropped later
                        continue
                    if len(known) < KNOWN:
                        known.add(g)
                    late = bits[s >> shift]
                    first = _first(n)
                    k = first - min(first, n - int(late.sum()))
                    rows.append((np.concatenate([s[~late][:first], s[late][:k]]) if late.any() else s[:first], g, n, k))
                if rows:
                    token, sig, n, k = zip(*rows, strict=True)
                    size = np.array([len(t) for t in token])
                    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    late = place >= np.repeat(size - np.array(k), size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.repeat(np.array(sig, np.int64), size)), pa.array(np.repeat(np.array(n, np.int32), size)), pa.array(late)], ["token", "sig", "n", "late"])

        total = members.agg(F.sum(F.col("n_shingles") * 0.25 + 1)).first()[0] or 0
        salt = F.when(F.col("late"), F.pmod("sig", F.lit(common.SALTS))).otherwise(0)
        d = self.docs.select("text").mapInArrow(cut, "token long, sig long, n int, late boolean")
        d = d.repartition(int(total) // POSTINGS + 1, "token", salt).sortWithinPartitions("token", "sig").mapInArrow(_shared, "token long, sig long, n int, late boolean")
        d = common.save(d, "front")
        rows = common.save(self.busy(d), "busy")
        # n-grams that only one of the sets that are left holds; late ones count as shared
        more = rows.where("not late").groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
        kept = rows.where("not late").join(more, "token").unionByName(rows.where("late").withColumn("size", F.lit(None).cast("long")))
        kept = common.save(kept, "kept")
        out = common.save(self.busy(kept), "busy")
        for t in (d, rows, kept):
            common.drop(t)
        return out

    @staticmethod
    def busy(rows: DataFrame) -> DataFrame:
        """The rows of sets that share as many n-grams of the front fragment as a link takes, with that number, m. A linked set has 0.8 n at least."""
        enough = rows.groupBy("sig").agg(F.count("*").alias("m"), F.max("n").alias("n")).where(F.col("m") > F.floor(F.col("n") / 25)).select("sig", "m")
        return rows.drop("m").join(enough, "sig")

    def candidates(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b), a < b, of sets that can link by what they share in the front fragment."""
        few = rows.where(F.col("size") <= self.small).groupBy("token").agg(F.collect_list(F.struct("sig", "n")).alias("g"))  # at most `small` sets
        p = few.select(F.explode("g").alias("x"), "g").select("x", F.explode("g").alias("y")).where((F.col("x.sig") < F.col("y.sig")) & _fits(F.col("x.n"), F.col("y.n")))
        pairs = p.groupBy(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), _needed(F.col("x.n"), F.col("y.n")).alias("needed")).agg(F.count("*").alias("shared"))
        held = self.large(rows).groupBy("sig").agg(F.count("*").alias("held"))
        for side in "ab":
            pairs = pairs.join(held.select(F.col("sig").alias(side), F.col("held").alias(f"held_{side}")), side, "left")
        may = F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0)))
        return pairs.where(F.col("shared") + may >= F.col("needed")).select("a", "b")

    def large(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("size").isNull() | (F.col("size") > self.small))

    def sets(self, members: DataFrame, sigs: DataFrame, whole: bool = False) -> DataFrame:
        """sig, more, n, fragment, tokens (a range's n-grams, or all of them) of the sets that `sigs` names, from one document each."""
        width, top = self.width, np.uint64(63 if whole else 64 - (self.fragments - 1).bit_length())

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (p for b in batches for p in hashing.parts(b, 0)):
                out = []
                for s in _sets(batch.column(0).to_pylist(), width):
                    part = np.zeros(len(s), np.uint64) if whole else s >> top
                    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    g = _signature(s)
                    out += [(*g, len(s), int(part[e]), t) for e, t in zip(edge.tolist(), np.split(s.view(np.int64), edge[1:]), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["sig", "more", "n", "fragment", "tokens"])

        one = members.join(sigs, "sig", "left_semi").groupBy("sig", "more").agg(F.min(F.struct("doc_id", "version")).alias("one")).select(F.col("one.doc_id").alias("i"), F.col("one.version").alias("v"))
        d = self.docs.join(one, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v"))).dropDuplicates(["doc_id", "version"])
        return common.save(d.select("text").mapInArrow(cut, "sig long, more long, n int, fragment int, tokens array<long>"), "sets")

    @staticmethod
    def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """u, v (structs of sig and more): of the pairs (a, b) those with 100 * intersection >= 80 * union."""
        x = common.skew_join(pairs, sets.select(F.col("sig").alias("a"), F.struct("sig", "more").alias("u"), F.col("n").alias("na"), "fragment", F.col("tokens").alias("ta")), ["a"])
        x = x.join(sets.select(F.col("sig").alias("b"), F.struct("sig", "more").alias("v"), F.col("n").alias("nb"), "fragment", F.col("tokens").alias("tb")), ["b", "fragment"])
        partial = x.select("u", "v", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("shared"))
        shared = partial.groupBy("u", "v", "na", "nb").agg(F.sum("shared").alias("shared"))
        return shared.where(F.lit(_OF) * F.col("shared") >= F.lit(_NEED) * (F.col("na") + F.col("nb") - F.col("shared"))).select("u", "v")

    def linked(self, members: DataFrame) -> DataFrame:
        """id, component (both structs of sig and more) of each set that links with another one."""
        rows = self.front(members, self.frequent())
        large = common.save(self.large(rows).select("token", "sig", "n", "m"), "large")
        # the first hub of each group: the likeliest original of a family of copies
        one = F.max(F.struct("m", "sig", "n")).alias("hub")
        hubs = common.save(large.groupBy("token", F.pmod(F.xxhash64("sig"), F.lit(self.hubs)).alias("share")).agg(one).select("token", "hub"), "hubs")
        pairs = common.save(self.candidates(rows).unionByName(self.hub_pairs(large, hubs)).distinct(), "pairs")
        sets = self.sets(members, pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
        common.drop(rows)
        found = self.grouped(self.links(pairs, sets))
        family = large.groupBy("token").agg(one, F.count("*").alias("members")).where("members > 1").select("token", F.col("hub.sig").alias("family"))
        group = common.skew_join(large, family, ["token"]).select("family", "sig").distinct()
        group = group.join(found.select(F.col("id.sig").alias("sig"), F.col("component.sig").alias("label")), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        group = common.save(group, "group")
        known = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
        last, found = found, self.grouped(self.block_links(members, group).unionByName(known))
        for t in (last, group, large, hubs, pairs, sets):
            common.drop(t)
        return found

    def block_links(self, members: DataFrame, group: DataFrame) -> DataFrame:
        """u, v: links between members of a family that are in different components, a link of each two components in a block at least."""
        parts = group.groupBy("family", "label").agg(F.count("*").alias("members"))
        main = parts.groupBy("family").agg(F.max(F.struct("members", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("family", F.col("main.label").alias("main"))
        open_ = common.save(common.skew_join(group, main, ["family"]), "open")
        sets = self.sets(members, open_.select("sig").distinct(), whole=True)
        own = open_.join(sets.select("sig", "n"), "sig")
        blocks = lambda of: F.greatest(F.lit(1), F.ceil(F.sum(F.when(of, F.greatest("n", F.lit(BLOCK // BLOCK_SETS)))) / BLOCK)).cast("int")
        cuts = own.groupBy("family").agg(blocks(F.col("label") != F.col("main")).alias("lefts"), blocks(F.lit(True)).alias("rights"))
        x = common.skew_join(open_, cuts, ["family"])
        at = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = x.where("label <> main").select("family", "sig", "label", F.lit(True).alias("first"), at("lefts").alias("l"), every("rights").alias("r"))
        right = x.select("family", "sig", "label", F.lit(False).alias("first"), every("lefts").alias("l"), at("rights").alias("r"))
        d = common.skew_join(common.save(left.unionByName(right), "blocks"), sets.select("sig", "more", "tokens"), ["sig"])
        return d.groupBy("family", "l", "r").applyInArrow(_block, "u struct<sig: long, more: long>, v struct<sig: long, more: long>").distinct()

    @staticmethod
    def grouped(links: DataFrame) -> DataFrame:
        return common.save(common.components(links), "component")

    @staticmethod
    def hub_pairs(group: DataFrame, hubs: DataFrame) -> DataFrame:
        """a, b: each group's hubs with its members, but for those of too different a size or with too few shared n-grams."""
        p = common.skew_join(group, hubs, ["token"]).where((F.col("sig") != F.col("hub.sig")) & _fits(F.col("n"), F.col("hub.n")))
        p = p.where(F.least("m", "hub.m") >= _needed(F.col("n"), F.col("hub.n")))
        return p.select(F.least("sig", "hub.sig").alias("a"), F.greatest("sig", "hub.sig").alias("b")).distinct()

    def run(self) -> tuple[DataFrame, DataFrame]:
        """members(), and sig, more, low_id, low_version of each set that several documents have or that links: the first document of its component."""
        members = self.members()
        found = self.linked(members)
        own = members.where("sig is not null").groupBy("sig", "more").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "version")).alias("one"))
        c = own.join(found.select("id.sig", "id.more", "component"), ["sig", "more"], "left").where("copies > 1 or component is not null")
        c = common.save(c.withColumn("component", F.coalesce("component", F.struct("sig", "more"))), "classes")
        low = c.groupBy("component").agg(F.min("low").alias("low_id"), F.min(F.when(F.col("one.doc_id").isNotNull(), F.col("one"))).alias("first"))
        ids = common.skew_join(c, low, ["component"]).select("sig", "more", "low_id", F.col("first.version").alias("low_version"))
        out = common.save(ids, "ids")
        for t in (found, c):
            common.drop(t)
        return members, out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    A document's set: distinct runs of five words (lower-cased A-Z, split at ASCII white space); the whole
    sequence where it has fewer words. Links at Jaccard 0.8 or more, compared in whole numbers; component_id is
    the smallest doc_id reachable. Documents without words, null texts included, link with nothing and have
    their own id. Repeated rows come back as often as they stand in the input. n-grams are compared by 64-bit
    hashes, whole sets by 128 bits. An empty table gives no rows; other columns are not looked at.
    """
    members, ids = Join(docs, key, text, **options).run()
    d = common.skew_join(members, ids, ["sig", "more"], "left")
    return d.select("doc_id", "n_shingles", F.coalesce("low_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (and one row of it), with all columns.

    Different texts under one id are documents of their own. Documents with a null id can't be told apart and all
    stay. Other columns are kept whatever their names are.
    """
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("id"), F.xxhash64(text).alias("of"))
    named = docs.where(F.col(key).isNotNull())
    members, ids = Join(named, key, text).run()
    m = common.skew_join(members, ids, ["sig", "more"], "left")
    first = m.where(F.col("low_version").isNull() | ((F.col("low_id") == F.col("doc_id")) & (F.col("low_version") == F.col("version"))))
    first = common.save(first.select(F.col("doc_id").alias("id"), F.col("version").alias("of")).distinct(), "kept")
    one = d.where(F.col("id").isNotNull()).join(first, ["id", "of"], "left_semi").dropDuplicates(["id", "of"])
    return one.unionByName(d.where(F.col("id").isNull())).select("doc.*")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
