"""Many texts to 64-bit hashes of their words at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the rolling and mixing steps (the golden ratio in 64 bits).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; longer texts are cut at white space.
SLICE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1 for what stands inside words (letters, digits, all of UTF-8's many-byte characters), 2 for other marks, 0 for white space.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[_SPACE] = 0


def _slices(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > SLICE:
        end = max((data.find(c, at + SLICE) for c in (b" ", b"\n")), default=-1, key=lambda x: (x >= 0, -x))
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def _hash(data: bytes, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of one buffer, and where in it each word begins."""
    raw = np.frombuffer(data, np.uint8)
    if marks:
        kind = _CLASS[raw]
        inside = kind != 0
        first = inside & np.concatenate(([True], kind[1:] != kind[:-1]))
    else:
        inside = ~_SPACE[raw]
        first = inside & np.concatenate(([True], ~inside[:-1]))
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    at = np.flatnonzero(inside)
    order = np.cumsum(first[at]) - 1
    place = (at - begin[order]).astype(np.uint64)
    value = _BYTE[_LOWER[raw[at]]] * (place * GOLDEN | np.uint64(1))
    return mixed(np.add.reduceat(value, np.searchsorted(at, begin))), begin


def parts(batch, column: int, most: int = 2 << 20) -> Iterator:
    """The batch in slices of some `most` bytes of the texts in a column, so that what is computed from a slice stays small.

    At the end Arrow gives back what it holds for later use (often more than a worker's caches): workers live on
    between stages, and their executor has that memory for other work.
    """
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(column).offset).astype(np.int64)) if batch.num_rows else np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0))
    edges = [0, *cut.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def words(texts: list[str | None], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many each text has. Words are lower-cased (A-Z) runs of what
    isn't ASCII white space; with marks, runs of letters and digits or runs of other marks."""
    count = np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    held: list[bytes] = []
    numbers: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            h, begin = _hash(b"\n".join(held), marks)
            ends = np.cumsum([len(x) + 1 for x in held])
            np.add.at(count, numbers, np.diff(np.searchsorted(begin, ends), prepend=0))
            out.append(h)
            held.clear()
            numbers.clear()
            size = 0

    for k, t in enumerate(texts):
        for part in _slices(t.encode()) if t else ():
            held.append(part)
            numbers.append(k)
            size += len(part)
            if size >= SLICE:
                flush()
    flush()
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), count


def shingles(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of each run of `width` words; of the whole text where it has fewer; none without words."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(n, width)
    h = word_hashes[: n - k + 1].copy()
    for j in range(1, k):
        h = h * GOLDEN + word_hashes[j : n - k + 1 + j]
    return np.unique(mixed(h + np.uint64(k)))
