import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import media, secrets, toxicity


def test_media_round_trip(docs, rows, none):
    m = media.load(media.store(docs.select("doc_id", "text", "size")).withColumn("file", F.col("media")), "file").collect()
    seen = {}
    for r in m:
        raw = (dict((x[0], x[1]) for x in rows)[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and bytes(r.payload) == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert len(r.rgb) == 3 * r.height * r.width
        assert seen.setdefault(raw, (bytes(r.file), bytes(r.rgb))) == (bytes(r.file), bytes(r.rgb))
    assert len(m) == len(rows) and media.load(media.store(none)).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 6, 7, 100, 4095 * 6 + 5, 200_000])
def test_any_payload(blocks):
    p = np.random.default_rng(blocks).integers(0, 256, 64 * blocks, dtype=np.uint8).tobytes()
    assert media.payload_of(media.coefficients(media.encode(p))) == p


def write_scans(y):
    """A grey progressive JPEG by the book, coefficient by coefficient: DC, two bands, first and refining scans."""
    out = []

    def code(t, s):
        return next(f"{c:0{n}b}" for (n, c), v in t.symbols.items() if v == s)

    every = media.table((0, 0, 0, 0, 0, 0, 0, 255, *[1] * 1, *[0] * 7), bytes(range(255)) + b"\xff")
    size = lambda v: abs(int(v)).bit_length()
    tail = lambda v: f"{int(v) if v > 0 else int(v) + (1 << size(v)) - 1:0{size(v)}b}" if v else ""
    pack = lambda b: np.packbits(np.frombuffer((b + "1" * (-len(b) % 8)).encode(), np.uint8) - 48).tobytes()
    down = lambda v, k: (abs(int(v)) >> k) * (1 if v > 0 else -1)
    bits, last = "", 0
    for b in y:
        v = int(b[0]) >> 1
        bits, last = bits + code(every, size(v - last)) + tail(v - last), v
    out.append(media.scan(((1, 0),), 0, 0, 0, 1, pack(bits)))
    for lo, hi in ((1, 5), (6, 63)):
        bits = ""
        for b in y:
            run = 0
            for k in range(lo, hi + 1):
                v = down(b[k], 1)
                if v:
                    while run > 15:
                        bits, run = bits + code(every, 0xF0), run - 16
                    bits, run = bits + code(every, run << 4 | size(v)) + tail(v), 0
                else:
                    run += 1
            bits += code(every, 0) if run else ""
        out.append(media.scan(((1, 0),), lo, hi, 0, 1, pack(bits)))
    out.append(media.scan(((1, 0),), 0, 0, 1, 0, pack("".join(str(int(b[0]) & 1) for b in y))))
    bits = ""
    for b in y:
        run, held = 0, ""
        ends = max([k for k in range(1, 64) if abs(int(b[k])) == 1], default=0)
        for k in range(1, 64):
            a = abs(int(b[k]))
            if a > 1:
                held += str(a & 1)
            elif a == 1:
                bits, run, held = bits + code(every, run << 4 | 1) + ("1" if b[k] > 0 else "0") + held, 0, ""
            else:
                run += 1
                if run == 16 and k < ends:
                    bits, run, held = bits + code(every, 0xF0) + held, 0, ""
        bits += (code(every, 0) + held) if ends < 63 else ""
    out.append(media.scan(((1, 0),), 1, 63, 1, 0, pack(bits)))
    n = len(y)
    import struct

    head = b"\xff\xd8" + media.segment(0xDB, b"\x00" + bytes(range(1, 65))) + media.segment(0xC2, struct.pack(">BHHB", 8, 8, 8 * n, 1) + b"\x01\x11\x00")
    return head + media.segment(0xC4, b"\x00" + every.stored + b"\x10" + every.stored) + b"".join(out) + b"\xff\xd9"


def test_reads_other_writers_scans():
    rng = np.random.default_rng(4)
    y = np.where(rng.random((9, 64)) < 0.4, rng.integers(-9, 10, (9, 64)), 0)
    y[:, 0] = rng.integers(0, 200, 9)
    y[3] = y[4] = 0
    pic = media.coefficients(write_scans(y))
    assert (pic.coefficients[0].reshape(-1, 64) == y).all()
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)
    block = np.zeros(64)
    block[media.ZIGZAG] = y[0] * np.arange(1, 65)
    want = np.clip(np.floor(basis.T @ block.reshape(8, 8) @ basis + 128.5), 0, 255)
    assert np.abs(media.rgb(pic)[:, :8, 0].astype(int) - want).max() <= 1


def test_base_secrets(spark, docs, rows, none):
    extra = ["token: abc", "x password:token:abcdefg y", "API_KEY = 'sk-1234567890'", "Secret=token=abcdef password = zz", "é𝄞 apikey=αβγ token=qwerty123456", "AKIA" + "A" * 16, "xAKIA123 AKIAAKIA" + "B" * 12, "f" * 24 + "g" + "0" * 23, None]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.scan(d).select("doc_id", "base", secrets.joined(F.col("base")).alias("j")).collect():
        t = texts[r.doc_id]
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.j == ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(want))
    assert secrets.scan(none).count() == 0


def test_battery_tells_random_from_text(spark):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    good = ["".join(rng.choice(letters) for _ in range(44)) for _ in range(30)] + [hashlib.sha1(str(k).encode()).hexdigest().upper() for k in range(30)]
    bad = ["internationalization_of_the_configuration_file_2024", "2024-01-01-2024-01-02-2024-01-03", "00000000000000000000000000", "the/quick/brown/fox/jumps/over/the/lazy/dog/1", "abababababababababababab12"] * 6
    d = spark.createDataFrame([(k, f"see {t} here") for k, t in enumerate(good + bad)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.scan(d).where("size(more) > 0").collect()}
    assert len([k for k in hit if k < 60]) >= 54 and not [k for k in hit if k >= 60]


def test_gradients_match_differences():
    m = toxicity.start({"a": 1, "b": 2})
    m.w = {k: v.astype(float) for k, v in m.w.items()}
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5, 3, 3 * toxicity.HIDDEN))
    d = rng.standard_normal((5, 3, toxicity.HIDDEN))
    out, steps = toxicity._gru(x, m.w["hf"], keep=True)
    dx, dw = toxicity._gru_back(d, m.w["hf"], steps)
    for at in ((0, 0, 0), (2, 1, 9), (4, 2, 20)):
        y = x.copy()
        y[at] += 1e-6
        assert ((toxicity._gru(y, m.w["hf"])[0] - out) * d).sum() / 1e-6 == pytest.approx(dx[at], rel=1e-3, abs=1e-5)
    w = m.w["hf"].copy()
    w[1, 2] += 1e-6
    assert ((toxicity._gru(x, w)[0] - out) * d).sum() / 1e-6 == pytest.approx(dw[1, 2], rel=1e-3, abs=1e-5)


def test_toxicity(spark, docs, none):
    rng = random.Random(1)
    words = ["".join(rng.choice(["an", "er", "th", "on", "ti", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for k in range(500):
        t = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        bad = k % 4 == 0
        for _ in range(3 if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(["zorkel", "grumph", "blax" + rng.choice(words)])
        rows.append((k, " ".join(t), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = zlib.crc32
    model = toxicity.train(d, d.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    test = [(got[k], y) for k, _, y in rows if out(str(k).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in test]) > 0.9
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(none, model).count() == 0
    long = " ".join(words * 40)
    assert toxicity.Scorer(model).scores([long + " zorkel grumph zorkel"])[0] > toxicity.Scorer(model).scores([long])[0]
