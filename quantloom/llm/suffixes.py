"""Suffix-array dedup: shards of text are sorted by induced sorting, and permuted common prefixes tell what repeats.

Every byte string of `length` bytes has a fingerprint, the smallest hash of the shorter strings in it, so equal strings
have equal ones. Neighbouring strings mostly share theirs; such a stretch is a segment. Fingerprints deal segments to
shards: equal strings always meet, and the segments of one fingerprint are a text of their own, small enough for its
suffix array. Many such texts are sorted in step with each other, one numpy operation for a step of all of them.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import GOLDEN, mixed

#: A doc_id that stands for none; such documents come last.
NONE = (1 << 63) - 1
#: Bytes of text of a chunk (documents that are looked at together), and of a slice of it that is hashed at once.
CHUNK, SLICE = 2 << 20, 1 << 17
#: Bytes of text, of keys and of segments that a shard gets in the mean at most.
SHARD, TOLD, SENT = 32 << 20, 8 << 20, 24 << 20
#: Keys that a shard counts at once.
COUNT = 1 << 19
#: Positions of a segment at most, so that its first and last string tell all of its bytes.
STRETCH = 50
#: Of a fingerprint in so many chunks only the strings that stand in more than one document are sent.
HOT = 64
#: Bytes of one fingerprint's distinct segments that are one text; more are compared string by string.
LANE = 4096
#: Symbols that are sorted in step.
STEP = 1 << 18


# ---- suffix arrays of many texts in step: arrays are (place, lane)


def _induced(t: np.ndarray, s: np.ndarray, tails: np.ndarray, heads: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Suffix arrays induced from leftmost-smaller suffixes in `order` (place, lane; -1: none)."""
    n, lanes = t.shape
    k = tails.shape[1]
    sa = np.full(n * lanes, -1, np.int32)
    lane = np.arange(lanes)
    flat = t.ravel()
    larger, smaller = np.where(s, -1, t).ravel(), np.where(s, t, -1).ravel()
    at = tails.ravel().copy()
    for j in order[::-1]:
        ok = np.flatnonzero(j >= 0)
        j = j[ok]
        slot = ok * k + flat[j * lanes + ok]
        at[slot] -= 1
        sa[at[slot] * lanes + ok] = j
    at = heads.ravel().copy()
    for places, by, kind, step in ((range(n), at, larger, 1), (range(n - 1, -1, -1), tails.ravel().copy(), smaller, -1)):
        for i in places:
            j = sa[i * lanes : (i + 1) * lanes] - 1
            c = kind[np.maximum(j, 0) * lanes + lane]
            ok = np.flatnonzero((j >= 0) & (c >= 0))
            if not len(ok):
                continue
            j, slot = j[ok], ok * k + c[ok]
            if step > 0:
                sa[by[slot] * lanes + ok] = j
                by[slot] += 1
            else:
                by[slot] -= 1
                sa[by[slot] * lanes + ok] = j
    return sa.reshape(n, lanes)


def suffix_arrays(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix arrays of the columns of t (symbols below k). Each column ends with its only 0 and may begin with any number of k - 1."""
    n, lanes = t.shape
    lane = np.arange(lanes)
    s = np.ones((n, lanes), bool)  # smaller than the suffix to the right
    for i in range(n - 2, -1, -1):
        s[i] = (t[i] < t[i + 1]) | (t[i] == t[i + 1]) & s[i + 1]
    left = np.zeros((n, lanes), bool)  # leftmost of a smaller run
    left[1:] = s[1:] & ~s[:-1]
    tails = np.bincount((t + lane * k).ravel(), minlength=lanes * k).reshape(lanes, k).cumsum(1)
    heads = np.concatenate([np.zeros((lanes, 1), tails.dtype), tails[:, :-1]], 1)
    many = left.sum(0)
    most = int(many.max())
    who, where = np.nonzero(left.T)  # lane by lane, in order of place
    rank = np.arange(len(who)) - np.repeat(many.cumsum() - many, many)
    places = np.full((most, lanes), -1, np.int64)
    places[rank, who] = where
    sa = _induced(t, s, tails, heads, places)
    # Names of the substrings from one leftmost place to the next, in their order.
    by, place = np.nonzero(np.take_along_axis(left, sa, 0).T)
    p = sa[place, by]
    following = np.full((n, lanes), n, np.int32)
    following[where[:-1][who[:-1] == who[1:]], who[:-1][who[:-1] == who[1:]]] = where[1:][who[:-1] == who[1:]]
    size = following[p, by] - p
    same = np.append(False, (by[1:] == by[:-1]) & (size[1:] == size[:-1]))
    look, d = np.flatnonzero(same), 0
    while len(look):
        a, b, w = p[look] + d, p[look - 1] + d, by[look]
        equal = (t[np.minimum(a, n - 1), w] == t[np.minimum(b, n - 1), w]) & (s[np.minimum(a, n - 1), w] == s[np.minimum(b, n - 1), w]) & (a < n) & (b < n)
        same[look[~equal]] = False
        look = look[equal & (d < size[look])]
        d += 1
    total = np.cumsum(~same)
    first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    name = total - np.repeat(total[first], np.diff(np.append(first, len(by))))
    if (np.bincount(by, weights=~same, minlength=lanes) == many).all():
        order = np.full((most, lanes), -1, np.int64)
        order[np.arange(len(by)) - np.repeat(many.cumsum() - many, many), by] = p
    else:
        top = int(name.max()) + 1
        names = np.zeros((n, lanes), np.int32)
        names[p, by] = name
        pad = most - many
        reduced = np.full((most, lanes), top, np.int32)
        reduced[rank + pad[who], who] = names[where, who]
        r = suffix_arrays(reduced, top + 1) - pad
        order = np.where(r >= 0, np.take_along_axis(places, np.maximum(r, 0), 0), -1)
    return _induced(t, s, tails, heads, order)


def common_prefixes(t: np.ndarray, sa: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each place of each column from `begin` on, how many symbols above 1 in a row its suffix shares with the
    one before it in the suffix array, in the text's order: what one place shares, less one, the next one shares too."""
    n, lanes = t.shape
    phi = np.full((n, lanes), -1, np.int32)
    np.put_along_axis(phi, sa[1:], sa[:-1], 0)
    flat, phi, out = t.ravel(), phi.ravel(), np.zeros(n * lanes, np.int32)
    lane, i, l = np.arange(lanes), begin.astype(np.int64), np.zeros(lanes, np.int64)
    while len(lane):
        b = phi[i * lanes + lane]
        x = flat[(i + l) * lanes + lane]
        hit = (x > 1) & (b >= 0)
        hit &= x == flat[np.where(hit, b + l, 0) * lanes + lane]
        done = np.flatnonzero(~hit)
        out[i[done] * lanes + lane[done]] = l[done]
        l += 1
        l[done] = np.maximum(l[done] - 2, 0)
        i[done] += 1
        if (i[done] >= n - 1).any():
            live = i < n - 1
            lane, i, l = lane[live], i[live], l[live]
    return out.reshape(n, lanes)


def lowest(texts: np.ndarray, sizes: np.ndarray, low: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each string of `length` bytes in each segment, the smallest `low` of all segments of its owner with that string.

    texts: the segments' bytes one after the other; sizes: their lengths; owner: which text each belongs to, in order.
    The result has sizes - length + 1 numbers for each segment.
    """
    n = sizes - length + 1
    out = np.repeat(low, n)
    to = n.cumsum() - n  # where a segment's numbers begin
    begin = sizes.cumsum() - sizes
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    segments = np.diff(np.append(first, len(owner)))
    symbols = np.add.reduceat(sizes + 1, first) if len(first) else first
    for k in np.flatnonzero((segments > 1) & (symbols > LANE)):  # string by string
        rows = np.arange(first[k], first[k] + segments[k])
        at = np.repeat(begin[rows] - n[rows].cumsum() + n[rows], n[rows]) + np.arange(n[rows].sum())
        grams = np.lib.stride_tricks.sliding_window_view(texts, length)[at].view(f"V{length}").ravel()
        _, back = np.unique(grams, return_inverse=True)
        least = np.full(back.max() + 1, NONE)
        np.minimum.at(least, back, np.repeat(low[rows], n[rows]))
        out[to[rows[0]] : to[rows[0]] + len(at)] = least[back]
    lanes = np.flatnonzero((segments > 1) & (symbols <= LANE))
    lanes = lanes[np.argsort(symbols[lanes], kind="stable")]
    while len(lanes):
        # the longest that fit STEP symbols together
        wide = int(np.clip(STEP // (symbols[lanes[-1]] + 1), 1, len(lanes)))
        now, lanes = lanes[-wide:], lanes[:-wide]
        high = int(symbols[now].max()) + 1
        t = np.full((high, wide), 258, np.int32)
        source, place, column, pos = [], [], [], []
        rows = np.concatenate([np.arange(first[k], first[k] + segments[k]) for k in now])
        col = np.repeat(np.arange(wide), segments[now])
        ends = (sizes[rows] + 1).cumsum()
        start = ends - sizes[rows] - 1  # in its column's text: less what stands before the column
        base = np.repeat(start[np.append(0, segments[now].cumsum()[:-1])], segments[now])
        start = start - base + (high - 1 - symbols[now])[col]
        within = np.arange(sizes[rows].sum()) - np.repeat(sizes[rows].cumsum() - sizes[rows], sizes[rows])
        t[np.repeat(start, sizes[rows]) + within, np.repeat(col, sizes[rows])] = texts[np.repeat(begin[rows], sizes[rows]) + within].astype(np.int32) + 2
        t[start + sizes[rows], col] = 1
        t[high - 1] = 0
        sa = suffix_arrays(t, 259)
        shared = common_prefixes(t, sa, high - 1 - symbols[now])
        of = np.full((high, wide), NONE)
        string = np.arange(n[rows].sum()) - np.repeat(n[rows].cumsum() - n[rows], n[rows])
        at, ac = np.repeat(start, n[rows]) + string, np.repeat(col, n[rows])
        of[at, ac] = np.repeat(low[rows], n[rows])
        run = np.take_along_axis(shared, sa, 0).T < length  # lane by lane: a new run of equal strings begins
        run[:, 0] = True
        cut = np.flatnonzero(run.ravel())
        ordered = np.take_along_axis(of, sa, 0).T.ravel()
        least = np.repeat(np.minimum.reduceat(ordered, cut), np.diff(np.append(cut, len(ordered)))).reshape(wide, high).T
        np.put_along_axis(of, sa, least, 0)
        out[np.repeat(to[rows], n[rows]) + string] = of[at, ac]
    return out


# ---- fingerprints and segments of a chunk


def _powers(x: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all runs of `width` entries, by doubling."""
    out, size, cur, power, length = None, 0, x, GOLDEN, 1
    with np.errstate(over="ignore"):
        while width:
            if width & 1:
                if out is None:
                    out = cur
                else:
                    m = len(cur) - size
                    out = out[:m] * power + cur[size:]
                size += length
            width >>= 1
            if width:
                cur = cur[: len(cur) - length] * power + cur[length:]
                power, length = power * power, 2 * length
    return out


def stretches(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, number of strings (STRETCH at most) and fingerprint of each run of strings with one fingerprint; no string crosses an end."""
    small = length // 2
    span = length - small + 1
    out = []
    begin = np.append(0, ends[:-1])
    for a in range(0, len(text), SLICE):
        b = min(a + SLICE, len(text) - length + 1)
        if b <= a:
            break
        x = mixed(_powers(text[a : b + length - 1].astype(np.uint64) + np.uint64(1), small))
        width = 1
        while width < span:
            step = min(width, span - width)
            x = np.minimum(x[: len(x) - step], x[step:])
            width += step
        off = np.zeros(b - a + 1, np.int32)
        k = slice(np.searchsorted(ends, a, "right"), np.searchsorted(ends, b + length, "right"))
        lo, hi = np.clip(np.maximum(ends[k] - length + 1, begin[k]) - a, 0, b - a), np.clip(ends[k] - a, 0, b - a)
        np.add.at(off, lo, 1)
        np.add.at(off, hi, -1)
        ok = off[:-1].cumsum() == 0
        edge = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (ok[1:] != ok[:-1])))
        many = np.diff(np.append(edge, b - a))
        edge, many = edge[ok[edge]], many[ok[edge]]
        cuts = -(-many // STRETCH)
        nth = np.arange(cuts.sum()) - np.repeat(cuts.cumsum() - cuts, cuts)
        out.append((np.repeat(edge, cuts) + nth * STRETCH + a, np.minimum(np.repeat(many, cuts) - nth * STRETCH, STRETCH), np.repeat(x[edge], cuts)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def dealt(fingerprint: np.ndarray, shards: int) -> np.ndarray:
    """Shard (above) and what tells fingerprints of a shard apart (the lower 32 bits), in one number."""
    fingerprint = mixed(fingerprint)  # the smallest of several hashes is small itself
    high, low = fingerprint >> np.uint64(32), fingerprint & np.uint64(0xFFFFFFFF)
    return (high * np.uint64(shards) >> np.uint64(32) << np.uint64(32) | low).astype(np.int64)


def _digest(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings that begin at these places, which ascend; slice by slice."""
    out = np.zeros(len(at), np.uint64)
    slices = np.arange(0, len(text) + SLICE, SLICE)
    cuts = np.searchsorted(at, slices)
    for a, i, j in zip(slices.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=False):
        if j - i > SLICE >> 4:
            out[i:j] = _powers(text[a : a + SLICE + length - 1].astype(np.uint64) + np.uint64(1), length)[at[i:j] - a]
        elif j > i:
            for k in range(length):
                out[i:j] = out[i:j] * GOLDEN + text[at[i:j] + k] + np.uint64(1)
    return mixed(out)


def _taken(text: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of text with these begins and sizes, one after the other."""
    out, to = np.empty(int(sizes.sum()), np.uint8), 0
    for a in range(0, len(sizes), 1 << 13):
        b, n = begin[a : a + (1 << 13)], sizes[a : a + (1 << 13)]
        where = np.repeat(b - n.cumsum() + n, n) + np.arange(n.sum())
        out[to : to + len(where)] = text[where]
        to += len(where)
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys (the first one leads), where each group of equal ones begins there, and the group of each row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    back = np.empty(len(order), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return order, np.flatnonzero(new), back


def _states(marks: list[dict]) -> np.ndarray:
    """0, 1 (in more than one document) or 2 (and frequent) for each distinct key that a chunk has told, in their order."""
    bits = [np.unpackbits(np.frombuffer(m["marks"], np.uint8).reshape(2, -1), axis=1, count=m["many"]).sum(0, dtype=np.uint8) for m in sorted(marks, key=lambda m: m["shard"])]
    return np.concatenate(bits) if bits else np.zeros(0, np.uint8)


def _ranges(keys: np.ndarray, parts: int) -> Iterator[np.ndarray]:
    """Where the keys of each of so many ranges stand."""
    low, high = (int(keys.min()), int(keys.max()) + 1) if len(keys) else (0, 1)
    edges = [low + -(-k * (high - low) // parts) for k in range(parts + 1)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield np.flatnonzero((keys >= a) & (keys < b)) if parts > 1 else np.arange(len(keys))


def told_again(keys: np.ndarray, shared: np.ndarray, hot: int, most: int) -> np.ndarray:
    """Two rows of bits for the keys of a shard (those of one chunk are distinct): in more than one document; and in `hot` chunks.
    Some `most` keys are counted at once."""
    bits = np.zeros((2, len(keys)), bool)
    for at in _ranges(keys, len(keys) // most + 1):
        order, first, back = _groups(keys[at])
        if len(at):
            times = np.diff(np.append(first, len(order)))
            more = (times > 1) | (np.add.reduceat(shared[at][order], first, dtype=np.int64) > 0)
            bits[:, at] = more[back], (more & (times >= hot))[back]
    return bits


def answers(rows: list[dict], length: int) -> Iterator[tuple]:
    """chunk, least, runs for each row of a shard: the smallest id of each string of its segments, in runs. Takes the rows' bytes away."""
    keys, strings, low = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in (("keys", np.uint32), ("strings", np.uint8), ("low", np.int64)))
    text = np.frombuffer(b"".join([r.pop("bytes") for r in rows]), np.uint8)
    strings = strings.astype(np.int64)
    sizes = strings + length - 1
    begin = sizes.cumsum() - sizes
    order, first, back = _groups(keys, strings, _digest(text, begin, length), _digest(text, begin + strings - 1, length))
    least = np.minimum.reduceat(low[order], first)
    pick = order[first]
    del order, low
    least = lowest(_taken(text, begin[pick], sizes[pick]), sizes[pick], least, keys[pick], length)
    to = strings[pick].cumsum() - strings[pick]
    at = 0
    for r in rows:
        n = len(r["strings"])
        own = back[at : at + n]
        many = strings[at : at + n]
        values = least[np.repeat(to[own] - many.cumsum() + many, many) + np.arange(many.sum())]
        cut = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        at += n
        yield r["chunk"], values[cut].tobytes(), np.diff(np.append(cut, len(values))).astype(np.int32).tobytes()


class Chunk:
    """Documents that are looked at together, with their stretches."""

    def __init__(self, row: dict, length: int, shards: int):
        self.number, self.length, self.shards = row["chunk"], length, shards
        self.ids, self.ends = (np.frombuffer(row[c], np.int64) for c in ("ids", "ends"))
        self.text = np.frombuffer(row["text"], np.uint8)
        self.begin, self.many, self.fingerprint = stretches(self.text, self.ends, length)
        self.doc = np.searchsorted(self.ends, self.begin, "right")
        self.key = dealt(self.fingerprint, shards)
        order, first, self.back = _groups(self.key)
        self.keys = self.key[order][first]
        last = np.append(first[1:], len(order)) - 1
        self.shared = self.doc[order][first] != self.doc[order][last] if len(order) else np.zeros(0, bool)

    def rows(self, keys: np.ndarray, finer: int = 1) -> Iterator[tuple[int, slice]]:
        """The shards of sorted keys, each cut into `finer` ones, and their parts of them."""
        shard = (keys >> 32) * finer + ((keys & 0xFFFFFFFF) * finer >> 32)
        cut = np.flatnonzero(np.append(shard[1:] != shard[:-1], True)) + 1 if len(keys) else []
        for a, b in zip([0, *cut[:-1]], cut, strict=False):
            yield int(shard[a]), slice(int(a), int(b))

    def told(self) -> Iterator[tuple]:
        """shard, chunk, keys, shared (whether in more than one document here) of the distinct fingerprints."""
        for shard, part in self.rows(self.keys):
            yield shard, self.number, self.keys[part].astype(np.uint32).tobytes(), np.packbits(self.shared[part]).tobytes()

    def marked(self, marks: list[dict]) -> None:
        """Takes what the shards say of the fingerprints: which may repeat, and the strings of the frequent ones."""
        state = _states(marks)[self.back]
        self.one, self.hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        many = self.many[self.hot]
        self.segment = np.repeat(self.hot.astype(np.int32), many)  # of each string of a frequent fingerprint
        self.string = np.repeat((self.begin[self.hot] - many.cumsum() + many).astype(np.int32), many)
        self.string += np.arange(len(self.string), dtype=np.int32)
        key = dealt(_digest(self.text, self.string, self.length), self.shards)
        order, first, self.string_back = _groups(key)
        self.string_keys = key[order[first]]
        doc = self.doc[self.segment[order[first]]], self.doc[self.segment[order[np.append(first[1:], len(order)) - 1]]] if len(order) else []
        self.string_shared = doc[0] != doc[1] if len(order) else np.zeros(0, bool)

    def told_strings(self, finer: int = 1) -> Iterator[tuple]:
        """As told(), of the strings of the frequent fingerprints."""
        for shard, part in self.rows(self.string_keys, finer):
            yield shard, self.number, self.string_keys[part].astype(np.uint32).tobytes(), np.packbits(self.string_shared[part]).tobytes()

    def segments(self, marks: list[dict]) -> None:
        """Takes what the shards say of these strings and sets the segments that may repeat: their begin and number of
        strings, and the distinct ones among them, in the order of their keys. A frequent fingerprint's segments are
        cut to runs of strings that repeat."""
        stay = np.flatnonzero(_states(marks)[self.string_back] > 0)
        at, of = self.string[stay], self.segment[stay]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]))) if len(at) else np.zeros(0, np.int64)
        self.at = np.append(self.begin[self.one], at[first])
        self.strings = np.append(self.many[self.one], np.diff(np.append(first, len(at))))
        key = np.append(self.key[self.one], self.key[of[first]])
        self.own = self.ids[np.searchsorted(self.ends, self.at, "right")]
        del stay, at, of, first
        self.segment = self.string = self.string_back = self.string_keys = None
        begin = np.argsort(self.at)  # those of frequent fingerprints come after the others
        ends = np.empty((2, len(begin)), np.uint64)
        for k, shift in enumerate((0, self.strings[begin] - 1)):
            ends[k, begin] = _digest(self.text, self.at[begin] + shift, self.length)
        order, self.first, self.of = _groups(key, self.strings, *ends)
        self.order, self.distinct = order, key[order[self.first]]

    def shipped(self, finer: int = 1) -> Iterator[tuple]:
        """shard, chunk, keys, strings, low (smallest id), bytes of the distinct segments."""
        low = np.full(len(self.first), NONE)
        np.minimum.at(low, self.of, self.own)
        at, many = self.at[self.order][self.first], self.strings[self.order][self.first]
        for shard, part in self.rows(self.distinct, finer):
            yield shard, self.number, self.distinct[part].astype(np.uint32).tobytes(), many[part].astype(np.uint8).tobytes(), low[part].tobytes(), _taken(self.text, at[part], many[part] + self.length - 1).tobytes()

    def documents(self, found: list[dict], finer: int = 1) -> Iterator[tuple]:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256, given the smallest id of each string of the distinct segments."""
        gone = np.zeros(len(self.text), bool)  # strings to remove, by their begin
        first = np.append(self.first, len(self.order))
        for (_, part), f in zip(self.rows(self.distinct, finer), sorted(found, key=lambda f: f["shard"]), strict=True):
            least = np.repeat(np.frombuffer(f["least"], np.int64), np.frombuffer(f["runs"], np.int32))
            many = self.strings[self.order[self.first[part]]]
            segment = self.order[first[part.start] : first[part.stop]]
            n = self.strings[segment]
            string = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            to = (many.cumsum() - many)[self.of[segment] - part.start]
            gone[(np.repeat(self.at[segment], n) + string)[least[np.repeat(to, n) + string] < np.repeat(self.own[segment], n)]] = True
        cover = np.cumsum(gone, dtype=np.int32)
        cover[self.length :] -= cover[: -self.length].copy()
        cover = cover > 0
        begin = np.append(0, self.ends[:-1])
        for doc, a, b in zip(self.ids.tolist(), begin.tolist(), self.ends.tolist(), strict=True):
            c = cover[a:b]
            spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
            kept = self.text[a:b][~c] if spans else self.text[a:b]
            yield doc, b - a, int(c.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()


# ---- the jobs


@contextlib.contextmanager
def _at_once(spark: SparkSession, rows: int):
    """Rows of an Arrow batch, and of one that is read from Parquet, meanwhile: rows that hold whole chunks come a few at a time."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.parquet.columnarReaderBatchSize": max(rows, 16)}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """chunk, ids, ends, text: documents of a partition, CHUNK bytes or one document together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, number = [], [], 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held]).astype(np.int64)
            cols = [pa.array([(TaskContext.get().partitionId() << 33) + number]), *(pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), ends.tobytes(), b"".join(held)))]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "ends", "text"])

        size = 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(x)
                ids.append(i)
                size += len(x)
                if size >= CHUNK:
                    yield flush()
                    held, ids, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NONE)).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return d.mapInArrow(run, "chunk long, ids binary, ends binary, text binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Their rows, one at a time. At the end Arrow gives back what it holds for later use."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]
    pa.default_memory_pool().release_unused()


def _batches(rows: Iterator[tuple], schema: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each shard; they come sorted by shard."""
    at, held = None, []
    for row in _rows(batches):
        if row["shard"] != at and held:
            yield at, held
            held = []
        at = row["shard"]
        held.append(row)
    if held:
        yield at, held


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document without the bytes that a string of `length` bytes
    covers which also starts in a document with a smaller id.

    Five passes. (1) Documents become chunks; each tells its shards' fingerprints, four bytes each, and the shards answer
    which stand in more than one document. (2) Of fingerprints in HOT chunks or more each string is told in the same
    way. (3) Chunks send their distinct segments with such a fingerprint, each with its smallest id, and of frequent ones
    the runs of strings that repeat; (4) a shard joins equal ones, sorts the suffixes of every fingerprint's segments,
    and answers with the smallest id of each string, in runs. (5) Chunks mark what those cover. So a passage in any number
    of documents is sent once a chunk. A fingerprint with more than LANE bytes of distinct segments in a shard is
    compared string by string. All of it is exact: what is left out stands in one document only.

    Null and empty texts have no bytes. Rows without an id come after all others and aren't smaller than each
    other; rows of one id aren't either. Repeated rows each give a row. Texts of any length: strings are hashed slice
    by slice. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    with _at_once(spark, 500):
        chunks = common.save(_chunked(docs, key, text), "chunks")
    size = chunks.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(common.tasks(spark), size // SHARD + 1)

    told_schema = "shard int, chunk long, keys binary, shared binary"

    marks_schema = "chunk long, shard int, many int, repeated long, frequent long, marks binary"
    sent_schema = "shard int, chunk long, keys binary, strings binary, low binary, bytes binary"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from _batches(Chunk(row, length, shards).told(), told_schema)

    def told_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row, length, shards)
            c.marked(row["marked"] or [])
            yield from _batches(c.told_strings(finer["strings"]), told_schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
            many = [len(k) for k in keys]
            bits = told_again(np.concatenate(keys), np.concatenate([np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=n) for r, n in zip(rows, many, strict=True)]), HOT, COUNT)
            ends = np.cumsum(many).tolist()
            parts = (bits[:, e - n : e] for e, n in zip(ends, many, strict=True))
            yield from _batches(((r["chunk"], shard, n, int(b[0].sum()), int(b[1].sum()), np.packbits(b, axis=1).tobytes()) for r, n, b in zip(rows, many, parts, strict=True)), marks_schema)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row, length, shards)
            c.marked(row["marked"] or [])
            c.segments(row["strings"] or [])
            yield from _batches(c.shipped(finer["sent"]), sent_schema)

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            yield from _batches(((chunk, shard, least, runs) for chunk, least, runs in answers(rows, length)), "chunk long, shard int, least binary, runs binary")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row, length, shards)
            c.marked(row["marked"] or [])
            c.segments(row["strings"] or [])
            yield _batch(list(c.documents(row["found"] or [], finer["sent"])), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def of_chunk(answers: DataFrame, name: str) -> DataFrame:
        """One row per chunk, with as many entries as it has shards."""
        used = [c for c in answers.columns if c not in ("chunk", "repeated", "frequent")]
        return answers.groupBy("chunk").agg(F.collect_list(F.struct(*used)).alias(name)).hint("shuffle_hash")

    def answered(rows: DataFrame, name: str, shards: int) -> tuple[DataFrame, int, int]:
        """The answers, and for how many keys of chunks they say repeated, and frequent."""
        asked = rows.repartition(shards, "shard").sortWithinPartitions("shard")
        out = common.save(asked.mapInArrow(counted, marks_schema), name)
        return out, *(x or 0 for x in out.agg(F.sum("repeated"), F.sum("frequent")).first())

    finer = {}  # shards that each shard is cut into, by what is dealt, so that a shard's share does not grow with what repeats
    with _at_once(spark, 2):
        marks, repeats, frequent = answered(chunks.mapInArrow(told, told_schema), "marks", shards)
        marked = chunks.join(of_chunk(marks, "marked"), "chunk", "left")
        finer["strings"] = frequent * 13 * 4 // (shards * TOLD) + 1  # strings of a fingerprint in the mean, bytes of a key
        strings, again, _ = answered(marked.mapInArrow(told_strings, told_schema), "strings", shards * finer["strings"])
        marked = marked.join(of_chunk(strings, "strings"), "chunk", "left")
        finer["sent"] = ((repeats - frequent) * 75 + again * 8) // (shards * SENT) + 1  # bytes of a segment, and of a string in a run
        parts = marked.mapInArrow(sent, sent_schema)
        parts = parts.repartition(shards * finer["sent"], "shard").sortWithinPartitions("shard")
        found = common.save(parts.mapInArrow(sorted_, "chunk long, shard int, least binary, runs binary"), "found")
        out = marked.join(of_chunk(found, "found"), "chunk", "left")
        out = common.save(out.mapInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "cleaned")
    for t in (chunks, marks, strings, found):
        common.drop(t)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NONE)))


def op12_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Two hexadecimal digits a byte.
ORACLE_OP12 = """WITH d AS (SELECT row_number() OVER () AS k, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
t AS (SELECT k, doc_id, j, substr(h, CAST(1000 * j + 1 AS BIGINT), 1098) AS h FROM (SELECT k, doc_id, h, unnest(range(CAST(len(h) // 1000 + 1 AS BIGINT))) AS j FROM d)),
g AS (SELECT k, doc_id, 500 * j + p AS p, hash(substr(h, CAST(2 * p + 1 AS BIGINT), 100)) AS s FROM (SELECT k, doc_id, j, h, unnest(range(CAST(least(len(h) // 2 - 49, 500) AS BIGINT))) AS p FROM t)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY 1),
c AS (SELECT k, p, lag(p) OVER (PARTITION BY k ORDER BY p) AS q FROM g JOIN f USING (s) WHERE least < doc_id),
i AS (SELECT k, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS i FROM c),
r AS (SELECT k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY k, i),
n AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM r GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n.k IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda j: substr(h, CAST(2 * CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END + 1 AS BIGINT), CAST(2 * (CASE WHEN j > len(a) THEN len(h) // 2 ELSE a[j] END - CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (k)"""
