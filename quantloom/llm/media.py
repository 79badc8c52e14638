"""Media columns: payloads in progressive JPEG files, decoded scan by scan into coefficient arrays and RGB tensors."""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Natural place (row * 8 + column) of each coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
#: A payload byte b is the coefficient 256 + b: the first scans at bit 8 say 1 everywhere, each later scan adds a bit.
TOP = 8
#: Blocks in a run of ends of band; a multiple of 8, so that runs stay on whole bytes.
RUN = 32760
#: MCUs of 16 x 16 pixels in a row at most.
COLUMNS = 4095
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


class Table(NamedTuple):
    """A Huffman table: symbols by (length, code), as stored, and (length, symbol) by the next 16 bits."""

    symbols: dict[tuple[int, int], int]
    stored: bytes
    ahead: list[tuple[int, int] | None]


@functools.cache
def table(lengths: tuple[int, ...], symbols: bytes) -> Table:
    """Canonical codes from the number of codes of each length 1..16 and the symbols in order."""
    out, code, k = {}, 0, 0
    ahead: list = [None] * 65536
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            ahead[code << 16 - length : code + 1 << 16 - length] = [(length, symbols[k])] * (1 << 16 - length)
            code += 1
            k += 1
        code <<= 1
    return Table(out, bytes(lengths) + symbols, ahead)


DC = table((1, 1, *[0] * 14), b"\x00\x01")  # 0: no change; 10: by one, and its sign
AC_FIRST = table((1, *[0] * 15), b"\x01")  # 0: next coefficient is one, and its sign
AC_MORE = table((0, *[1] * 15), bytes(n << 4 for n in range(14, -1, -1)))  # run of 2**n.. blocks: 16 - n bits and n more


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def scan(components: tuple[tuple[int, int], ...], first: int, last: int, high: int, low: int, bits: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, t]) for c, t in components) + bytes([first, last, high << 4 | low])
    return segment(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


@functools.cache
def _packed(pattern: str, times: int) -> bytes:
    bits = np.tile(np.frombuffer(pattern.encode(), np.uint8) - 48, times)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


@functools.cache
def _mcu_order(rows: int, cols: int) -> np.ndarray:
    """Places of the blocks Y Y Y Y Cb Cr of each MCU in the order: all Y by rows, all Cb, all Cr."""
    r, c = np.divmod(np.arange(rows * cols), cols)
    y = (2 * r[:, None] + [0, 0, 1, 1]) * 2 * cols + 2 * c[:, None] + [0, 1, 0, 1]
    n = rows * cols
    return np.concatenate([y, 4 * n + np.arange(n)[:, None], 5 * n + np.arange(n)[:, None]], axis=1).reshape(-1)


def _planes(values: np.ndarray) -> list[bytes]:
    """Bytes -> their bit planes from bit 7 to bit 0, each filled up with ones to whole bytes."""
    bits = np.unpackbits(values.reshape(-1, 1), axis=1).T
    pad = -bits.shape[1] % 8
    if pad:
        bits = np.concatenate([bits, np.ones((8, pad), np.uint8)], axis=1)
    packed = np.packbits(bits, axis=1)
    return [p.tobytes() for p in packed]


def _runs(n: int) -> Iterator[tuple[int, int, bytes]]:
    """Runs of blocks as (from, to, code of the run's length)."""
    for at in range(0, n, RUN):
        run = min(RUN, n - at)
        k = run.bit_length() - 1
        length = 16 - k
        code = next(c for (size, c), s in AC_MORE.symbols.items() if size == length and s == k << 4)
        yield at, at + run, struct.pack(">H", code << k | run - (1 << k))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG (YCbCr, chroma at half size) whose quantised coefficients hold the payload, 64 bytes a block."""
    n = -(-len(payload) // 384)
    cols = min(max(n, 1), COLUMNS)
    rows = -(-max(n, 1) // cols)
    n = rows * cols
    blocks = np.zeros((6 * n, 64), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = [slice(0, 4 * n), slice(4 * n, 5 * n), slice(5 * n, 6 * n)]
    out = [b"\xff\xd8", segment(0xFE, b"payload %d" % len(payload)), segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"))
    out.append(segment(0xC4, b"\x00" + DC.stored + b"\x10" + AC_FIRST.stored + b"\x11" + AC_MORE.stored))
    every = ((1, 0), (2, 0), (3, 0))
    # each component's first difference is one ("10" and sign "1"), all others are none
    one = "101" + "0" * 3 + "101" + "101"
    first = np.frombuffer((one + "0" * 6 * (n - 1)).encode(), np.uint8) - 48
    out.append(scan(every, 0, 0, 0, TOP, np.packbits(np.concatenate([first, np.ones(-len(first) % 8, np.uint8)])).tobytes()))
    for c, part in enumerate(parts, 1):
        out.append(scan(((c, 0),), 1, 63, 0, TOP, _packed("01" * 63, part.stop - part.start)))
    dc = _planes(blocks[:, 0][_mcu_order(rows, cols)])
    ac = [[b""] * 8 for _ in parts]
    for c, part in enumerate(parts):
        band = np.ascontiguousarray(blocks[part, 1:])
        for a, b, head in _runs(len(band)):
            ac[c] = [x + head + p for x, p in zip(ac[c], _planes(band[a:b]), strict=True)]
    for k in range(8):
        out.append(scan(every, 0, 0, TOP - k, TOP - k - 1, dc[k]))
        for c in range(3):
            out.append(scan(((c + 1, 1),), 1, 63, TOP - k, TOP - k - 1, ac[c][k]))
    return b"".join([*out, b"\xff\xd9"])


class _Bits:
    """The bits of a scan, read from `at` on."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff") + b"\0\0\0", 0

    @functools.cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.data, np.uint8))

    def take(self, n: int) -> int:
        first = self.at >> 3
        self.at += n
        last = (self.at + 7) >> 3
        return int.from_bytes(self.data[first:last]) >> (8 * last - self.at) & ((1 << n) - 1)

    def many(self, n: int) -> np.ndarray:
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, t: Table) -> int:
        first = self.at >> 3
        got = t.ahead[int.from_bytes(self.data[first : first + 3]) >> (8 - (self.at & 7)) & 0xFFFF]
        if got is None:
            raise ValueError("no such Huffman code")
        self.at += got[0]
        return got[1]

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def again(self, since: int, most: int) -> int:
        """How often the bits from `since` to here come again right away; they are skipped."""
        n = self.at - since
        if most <= 0 or not n:
            return 0
        rest = self.bits[self.at : min(self.at + most * n, len(self.bits) - 24)]
        same = rest == self.bits[since : since + len(rest)]
        k = (len(rest) if same.all() else int(same.argmin())) // n
        self.at += k * n
        return k


class Picture(NamedTuple):
    height: int
    width: int
    sampling: list[tuple[int, int]]  # of each component: horizontal, vertical
    coefficients: list[np.ndarray]  # of each component: block rows, block columns, 64 in zigzag order
    quantisers: list[np.ndarray]
    comment: bytes
    own: list[tuple[int, int]]  # of each component: block rows and columns without what only fills up MCUs


def refined(planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Bits of equal places in several refining scans, (bit number, bits), put together."""
    if [low for low, _ in planes] == list(range(7, -1, -1)):
        return np.packbits(np.stack([b for _, b in planes]), axis=0)[0].astype(np.int32)
    out = np.zeros(len(planes[0][1]), np.int32)
    for low, b in planes:
        out |= b.astype(np.int32) << low
    return out


class Later:
    """Refining scans that only append a bit to coefficients that aren't 0: kept as they are and added together.

    A scan qualifies if all coefficients of its band are positive and one run of ends of band covers all blocks.
    """

    def __init__(self) -> None:
        self.held: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = {}

    def take(self, bits: _Bits, coef: np.ndarray, t: Table, which: int, first: int, last: int, low: int) -> bool:
        key = (which, first, last)
        if key not in self.held and coef[:, first : last + 1].min(initial=1) <= 0:
            return False
        begun = bits.at
        s = bits.symbol(t)
        zeros = s >> 4
        if s & 15 or zeros == 15 or (1 << zeros) + (bits.take(zeros) if zeros else 0) < len(coef):
            bits.at = begun
            return False
        self.held.setdefault(key, []).append((low, bits.many(len(coef) * (last - first + 1))))
        return True

    def put(self, which: int, coef: np.ndarray) -> None:
        for key in [k for k in self.held if k[0] == which]:
            part = coef[:, key[1] : key[2] + 1]
            part += refined(self.held.pop(key)).reshape(part.shape)


def _dc_scan(bits: _Bits, comps: list[int], pic: Picture, tables: list[Table], high: int, low: int) -> None:
    """The DC coefficients of one component alone, or of several dealt out by MCUs."""
    cells = []  # views of the coefficients at one place of every unit, in the order of the scan
    for c in comps:
        h, v = pic.sampling[c] if len(comps) > 1 else (1, 1)
        dc = pic.coefficients[c][:, :, 0]
        if len(comps) == 1:
            rows, cols = pic.own[c]
            dc = dc[:rows, :cols]
        cells.append([dc[y::v, x::h] for y in range(v) for x in range(h)])
    shape = cells[0][0].shape
    units, each = shape[0] * shape[1], sum(map(len, cells))
    if high:
        got = refined([(low, bits.many(units * each))]).reshape(units, each).T.reshape(each, *shape)
        for cell, bit in zip([x for own in cells for x in own], got, strict=True):
            cell |= bit
        return
    diff, unit = np.zeros((units, each), np.int32), 0
    while unit < units:
        since, k = bits.at, 0
        for own, t in zip(cells, tables, strict=True):
            for _ in own:
                diff[unit, k] = bits.signed(bits.symbol(t))
                k += 1
        more = bits.again(since, units - unit - 1)
        diff[unit + 1 : unit + 1 + more] = diff[unit]
        unit += 1 + more
    k = 0
    for own in cells:
        value = np.cumsum(diff[:, k : k + len(own)].reshape(-1)).reshape(units, len(own)) << low
        for j, cell in enumerate(own):
            cell[:] = value[:, j].reshape(shape)
        k += len(own)


def _dc_put(held: list[tuple[int, _Bits]], pic: Picture) -> None:
    """Adds refining DC scans over all components at once."""
    if not held:
        return
    h0, v0 = pic.sampling[0]
    rows, cols = pic.coefficients[0].shape[0] // v0, pic.coefficients[0].shape[1] // h0
    each = sum(h * v for h, v in pic.sampling)
    got = refined([(low, bits.many(rows * cols * each)) for low, bits in held]).reshape(rows, cols, each)
    held.clear()
    k = 0
    for coef, (h, v) in zip(pic.coefficients, pic.sampling, strict=True):
        for y in range(v):
            for x in range(h):
                coef[y::v, x::h, 0] |= got[:, :, k]
                k += 1


def _ac_scan(bits: _Bits, coef: np.ndarray, t: Table, first: int, last: int, high: int, low: int) -> None:
    """coef: blocks x 64 of one component, changed in place."""
    block, n = 0, len(coef)
    while block < n:
        since, k, run = bits.at, first, 0
        row = coef[block]
        while k <= last:
            start = bits.at
            s = bits.symbol(t)
            zeros, size = s >> 4, s & 15
            if not size and zeros < 15:
                run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                break
            if high:
                value = (1 if bits.take(1) else -1) << low if size else 0
                while k <= last:
                    if row[k]:
                        if bits.take(1):
                            row[k] += (1 if row[k] > 0 else -1) << low
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if value and k <= last:
                    row[k] = value
            else:
                k += zeros
                if size:
                    row[k] = bits.signed(size) << low
                    if not zeros and (more := bits.again(start, last - k)):
                        row[k + 1 : k + 1 + more] = row[k]
                        k += more
            k += 1
        if run:
            if high:  # one bit for each coefficient that isn't 0 yet, in this block from k on and in the run's other blocks
                part = coef[block : block + run, first : last + 1]
                if k == first and part.min() > 0:
                    part += bits.many(part.size).reshape(part.shape).astype(np.int32) << low
                else:
                    seen = part != 0
                    seen[0, : k - first] = False
                    add = bits.many(int(seen.sum())).astype(np.int32) << low
                    part[seen] += np.where(part[seen] > 0, add, -add)
            block += run
        else:
            block += 1
            if not high and block < n:
                more = bits.again(since, n - block)
                coef[block : block + more, first : last + 1] = row[first : last + 1]
                block += more


def coefficients(data: bytes) -> Picture:
    """All scans of a baseline-precision progressive JPEG, accumulated. Restart intervals are not read."""
    at, quant, huff, pic, comment = 2, {}, {}, None, b""
    ids: list[int] = []
    picks: list[int] = []
    later, dc_later = Later(), []  # dc_later: refining DC scans of all components, bit number and bits
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = table(tuple(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            each = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            ids, picks = [e[0] for e in each], [e[2] for e in each]
            sampling = [(e[1] >> 4, e[1] & 15) for e in each]
            h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
            across, down = -(-width // (8 * h)), -(-height // (8 * v))
            pic = Picture(height, width, sampling, [np.zeros((down * sv, across * sh, 64), np.int32) for sh, sv in sampling], [], b"", [(-(-(-(-height * sv // v)) // 8), -(-(-(-width * sh // h)) // 8)) for sh, sv in sampling])
        elif marker == 0xDA:
            n = body[0]
            comps = [ids.index(body[1 + 2 * k]) for k in range(n)]
            tables = [body[2 + 2 * k] for k in range(n)]
            first, last, both = body[1 + 2 * n :]
            end = _MARKER.search(data, at).start()
            bits = _Bits(data[at:end])
            at = end
            high, low = both >> 4, both & 15
            if first == 0:
                if high and n == len(ids) > 1:
                    dc_later.append((low, bits))
                else:
                    _dc_put(dc_later, pic)
                    _dc_scan(bits, comps, pic, [huff.get(t >> 4) for t in tables], high, low)
            else:
                which = comps[0]
                coef, (rows, cols), t = pic.coefficients[which], pic.own[which], huff[0x10 | tables[0] & 15]
                whole = coef.shape[:2] == (rows, cols)
                own = coef.reshape(-1, 64) if whole else coef[:rows, :cols].reshape(-1, 64)
                if high and whole and later.take(bits, own, t, which, first, last, low):
                    continue
                later.put(which, own)
                _ac_scan(bits, own, t, first, last, high, low)
                if not whole:
                    coef[:rows, :cols] = own.reshape(rows, cols, 64)
    if pic is not None:
        _dc_put(dc_later, pic)
        for which, coef in enumerate(pic.coefficients):
            later.put(which, coef.reshape(-1, 64))
    return pic._replace(quantisers=[quant[p] for p in picks], comment=comment)


@functools.cache
def _inverse() -> np.ndarray:
    """64 coefficients in zigzag order -> 64 pixels."""
    u, x = np.arange(8)[:, None], np.arange(8)
    one = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.kron(one, one)[ZIGZAG].astype(np.float32)


def rgb(pic: Picture) -> np.ndarray:
    """height x width x 3 of 8 bits: dequantised, transformed back, chroma repeated up to full size, converted."""
    planes = []
    most_h, most_v = max(s[0] for s in pic.sampling), max(s[1] for s in pic.sampling)
    for coef, quant, (h, v) in zip(pic.coefficients, pic.quantisers, pic.sampling, strict=True):
        rows, cols, _ = coef.shape
        px = (coef.reshape(-1, 64) * quant).astype(np.float32) @ _inverse()
        px = px.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)
        if (h, v) != (most_h, most_v):
            px = px.repeat(most_v // v, 0).repeat(most_h // h, 1)
        planes.append(px[: pic.height, : pic.width])
    out = np.empty((pic.height, pic.width, 3), np.uint8)
    if len(planes) == 1:
        out[:] = _byte(planes[0])[:, :, None]
    else:
        y, b, r = planes
        out[:, :, 0] = _byte(y + np.float32(1.402) * r)
        out[:, :, 1] = _byte(y - np.float32(0.344136) * b - np.float32(0.714136) * r)
        out[:, :, 2] = _byte(y + np.float32(1.772) * b)
    return out


def _byte(x: np.ndarray) -> np.ndarray:
    """Samples around 0 -> 0 to 255."""
    return np.clip(x + np.float32(128.5), np.float32(0), np.float32(255)).astype(np.uint8)


def payload_of(pic: Picture) -> bytes:
    """What encode() put into a picture."""
    n = int(pic.comment.rsplit(b" ", 1)[-1])
    return np.concatenate([c.reshape(-1) for c in pic.coefficients])[:n].astype(np.uint8).tobytes()


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as UTF-8, filled up with zero bytes to a positive multiple of 64, in a
    progressive JPEG file; written to the shared folder and returned as read from there.

    Null and empty texts are one block of zeros. Very long texts make pictures of more rows. Rows of equal text
    get equal files; repeated rows stay; an empty table gives no rows; other columns are not looked at.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                raw = [(t or "").encode() for t in b.column(1).to_pylist()]
                files = [encode(r + bytes(-len(r) % 64 or (0 if r else 64))) for r in raw]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return common.save(d.mapInArrow(write, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"), "media")


def load(media: DataFrame, *keep: str) -> DataFrame:
    """doc_id, n_bytes, media and other columns to keep -> doc_id, n_bytes, those, payload, height, width and rgb (row by row, 3 bytes a pixel)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                pics = [coefficients(m) for m in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[1:], pa.array([payload_of(p) for p in pics], pa.binary()), pa.array([p.height for p in pics], pa.int32()), pa.array([p.width for p in pics], pa.int32()), pa.array([rgb(p).tobytes() for p in pics], pa.binary())],
                    [*b.schema.names[1:], "payload", "height", "width", "rgb"],
                )

    m = media.select("media", "doc_id", "n_bytes", *keep)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema.fields[1:])
    return m.mapInArrow(read, f"{kinds}, payload binary, height int, width int, rgb binary")


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    m = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    m = load(m.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)}), "media_bytes", "media_sha256")
    feature = F.concat_ws(":", F.col("height").cast("string"), F.col("width").cast("string"), F.crc32("rgb").cast("string"))
    return m.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))
