"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

#: Words in a window and from one window's start to the next's: neighbours overlap by a third.
WINDOW, STRIDE = 48, 32
#: Sizes: word embedding, character embedding, hidden state of each direction; buckets of character n-grams.
WORD_DIM, CHAR_DIM, HIDDEN, GRAMS = 8, 12, 8, 16384
#: Windows that are scored at once.
ROWS = 512
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def tokens_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, or of marks."""
    return _TOKEN.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's character n-grams of 3 and 5 characters, with its ends marked, and how many each word has."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    b = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(b))  # characters from here to the word's end
    three = (b[:-2] * hashing.GOLDEN + b[1:-1]) * hashing.GOLDEN + b[2:]
    five = (three[:-2] * hashing.GOLDEN + b[3:-1]) * hashing.GOLDEN + b[4:]
    both = np.stack([three, np.concatenate([five, np.zeros(min(2, len(three)), np.uint64)])], axis=1)
    real = np.stack([left[:-2] >= 3, left[:-2] >= 5], axis=1)
    return (hashing.mixed(both[real]) % np.uint64(GRAMS)).astype(np.int64), np.maximum(size - 2, 0) + np.maximum(size - 4, 0)


@dataclass
class Model:
    """Vocabulary and weights; small enough to travel with every task."""

    vocabulary: dict[str, int]
    w: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)


def start(vocabulary: dict[str, int], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    w = {"word": rng.normal(0, 0.3, (len(vocabulary) + 1, WORD_DIM)), "char": rng.normal(0, 0.3, (GRAMS, CHAR_DIM))}
    w["word"][0] = 0
    for k in ("f", "b"):
        w |= {f"x{k}": rng.normal(0, 0.3, (d, 3 * h)), f"h{k}": rng.normal(0, 0.3, (h, 3 * h)), f"c{k}": np.zeros(3 * h)}
    w |= {"att": rng.normal(0, 0.3, (2 * h, h)), "attb": np.zeros(h), "attv": rng.normal(0, 0.3, h), "out": rng.normal(0, 0.3, 2 * h), "outb": np.zeros(1)}
    return Model(vocabulary, {k: v.astype(np.float32) for k, v in w.items()})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gru(x: np.ndarray, w: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """x: steps x rows x 3 hidden, the input's part of the gates -> states; what backward needs."""
    h = np.zeros((x.shape[1], HIDDEN), x.dtype)
    out = np.empty((*x.shape[:2], HIDDEN), x.dtype)
    steps = []
    n = HIDDEN
    for t in range(len(x)):
        hw = h @ w
        gates = 1 / (1 + np.exp(-(x[t, :, : 2 * n] + hw[:, : 2 * n])))
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + r * hw[:, 2 * n :])
        if keep:
            steps.append((h, z, r, c, hw[:, 2 * n :]))
        h = c + z * (h - c)
        out[t] = h
    return out, steps


def _gru_back(d: np.ndarray, w: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input's part and of the recurrent weights from those of the states."""
    dx, dw, dh = np.empty((*d.shape[:2], 3 * HIDDEN), d.dtype), np.zeros_like(w), np.zeros_like(d[0])
    for t in range(len(d) - 1, -1, -1):
        h, z, r, c, hc = steps[t]
        dh = dh + d[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        dhw = np.concatenate([dz, dr, dc * r], axis=1)
        dw += h.T @ dhw
        dh = dh * z + dhw @ w.T
    return dx, dw


def forward(w: dict[str, np.ndarray], xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
    """Logits of windows from both directions' input parts (steps x rows x 3 hidden) and the mask of real words."""
    f, sf = _gru(xf, w["hf"], keep)
    b, sb = _gru(xb[::-1], w["hb"], keep)
    h = np.concatenate([f, b[::-1]], axis=2)
    a = np.tanh(h @ w["att"] + w["attb"])
    e = np.where(mask, a @ w["attv"], -1e9)
    p = np.exp(e - e.max(0))
    p /= p.sum(0)
    pooled = (p[:, :, None] * h).sum(0)
    return pooled @ w["out"] + w["outb"], (h, a, p, pooled, sf, sb)


def _starts(words: int) -> range:
    return range(0, max(1, words - WINDOW + STRIDE), STRIDE)


def fit(texts: list[str], toxic: list[int], vocabulary_size: int = 1000, rounds: int = 6, epochs: int = 2, batch: int = 64, rate: float = 0.01, blind: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Trained by backpropagation through time and Adam on windows of labelled documents.

    A toxic document has clean windows too, so each round takes the window of it that scores highest now (all of
    them in the first round), and of a clean document the highest and another one; both labels weigh the same.
    `blind` of the words are shown without their word embedding, by characters only. At last a logistic scaling of a document's
    highest window logit is fitted on the same documents.
    """
    one: dict[str, str] = {}  # one string for all places of a token
    docs = [[one.setdefault(t, t) for t in tokens_of(x)] for x in texts]
    seen: dict[str, int] = {}
    for d in docs:
        for t in set(d):
            seen[t] = seen.get(t, 0) + 1
    known = sorted((t for t, n in seen.items() if n >= 5), key=lambda t: (-seen[t], t))[:vocabulary_size]
    m = start({t: k for k, t in enumerate(known, 1)}, seed)
    g, n = grams(list(seen)) if seen else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    parts = dict(zip(seen, np.split(g, np.cumsum(n)[:-1]), strict=True)) if seen else {}
    rng = np.random.default_rng(seed)
    w = m.w
    state = ({k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, [0])
    for turn in range(rounds):
        logit, first = Scorer(m).by_parts(texts) if turn else (None, None)
        windows, label = [], []
        for k, (d, y) in enumerate(zip(docs, toxic, strict=True)):
            starts = list(_starts(len(d)))
            if turn:
                own = logit[first[k] : first[k] + len(starts)]
                pick = {int(own.argmax())} if y else {int(own.argmax()), int(rng.integers(len(starts)))}
            else:
                pick = set(range(len(starts))) if y else set(rng.integers(len(starts), size=3).tolist())
            for j in sorted(pick):
                windows.append(d[starts[j] : starts[j] + WINDOW])
                label.append(y)
        y_all = np.array(label, np.float32)
        share = float(np.clip(y_all.mean(), 1e-3, 1 - 1e-3)) if len(y_all) else 0.5
        weight = np.where(y_all > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                _step(m, [windows[k] for k in pick], y_all[pick], weight[pick], parts, state, rate * (1 - 0.8 * turn / rounds), blind, decay, rng)
    top = Scorer(m).highest(texts)
    a, b = 1.0, 0.0
    y = np.array(toxic, float)
    for _ in range(100 if len(y) else 0):  # Newton steps of a logistic regression, slightly held back
        q = sigmoid(a * top + b)
        v = q * (1 - q) + 1e-6
        g = np.array([((q - y) * top).sum() + 0.1 * (a - 1), (q - y).sum() + 0.1 * b])
        hess = np.array([[(v * top * top).sum() + 0.1, (v * top).sum()], [(v * top).sum(), v.sum() + 0.1]])
        delta = np.linalg.solve(hess, g)
        a, b = a - np.clip(delta[0], -1, 1), b - np.clip(delta[1], -1, 1)
    m.scale = (float(max(a, 1e-3)), float(b))
    return m


def _step(m: Model, rows: list[list[str]], y: np.ndarray, weight: np.ndarray, parts: dict, state: tuple, rate: float, blind: float, decay: float, rng: np.random.Generator) -> None:
    """One step of Adam on one batch of windows."""
    w = m.w
    n = max(1, max(map(len, rows)))
    flat = [t for r in rows for t in r]
    words, inverse = np.unique(np.array(flat, object), return_inverse=True) if flat else (np.zeros(0, object), np.zeros(0, np.int64))
    ids = np.array([m.vocabulary.get(t, 0) for t in words], np.int64)
    ids[rng.random(len(ids)) < blind] = 0
    lengths = np.array([len(parts[t]) for t in words], np.int64)
    g = np.concatenate([np.zeros(0, np.int64), *(parts[t] for t in words)])
    owner = np.repeat(np.arange(len(words)), lengths)
    root = np.sqrt(lengths).astype(np.float32)
    emb = np.zeros((len(words) + 1, WORD_DIM + CHAR_DIM), np.float32)  # the last row stands for no word
    emb[:-1, :WORD_DIM] = w["word"][ids]
    np.add.at(emb[:, WORD_DIM:], owner, w["char"][g] / root[owner, None])
    place = np.full((len(rows), n), len(words))
    mask = np.arange(n) < np.array([len(r) for r in rows])[:, None]
    place[mask] = inverse
    place, mask = place.T, mask.T
    x = emb[place]
    logit, (h, a, p, pooled, sf, sb) = forward(w, x @ w["xf"] + w["cf"], x @ w["xb"] + w["cb"], mask, keep=True)
    d = ((sigmoid(logit) - y) * weight / len(rows)).astype(np.float32)
    grad = {k: decay * v for k, v in w.items()}
    grad["out"] += pooled.T @ d
    grad["outb"] += d.sum()
    dpool = d[:, None] * w["out"]
    dh = p[:, :, None] * dpool
    dp = (h * dpool).sum(2)
    de = p * (dp - (p * dp).sum(0))
    grad["attv"] += np.einsum("tb,tbk->k", de, a)
    da = de[:, :, None] * w["attv"] * (1 - a * a)
    grad["att"] += h.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, HIDDEN)
    grad["attb"] += da.sum((0, 1))
    dh = dh + da @ w["att"].T
    df, grad_f = _gru_back(dh[:, :, :HIDDEN], w["hf"], sf)
    db, grad_b = _gru_back(dh[::-1, :, HIDDEN:], w["hb"], sb)
    db = db[::-1]
    grad["hf"] += grad_f
    grad["hb"] += grad_b
    for k, dx in (("f", df), ("b", db)):
        grad[f"x{k}"] += x.reshape(-1, x.shape[2]).T @ dx.reshape(-1, dx.shape[2])
        grad[f"c{k}"] += dx.sum((0, 1))
    dx = df @ w["xf"].T + db @ w["xb"].T
    demb = np.zeros_like(emb)
    np.add.at(demb, place.reshape(-1), dx.reshape(-1, dx.shape[2]))
    np.add.at(grad["word"], ids, demb[:-1, :WORD_DIM])
    grad["word"][0] = 0
    np.add.at(grad["char"], g, demb[owner, WORD_DIM:] / root[owner, None])
    first, second, count = state
    count[0] += 1
    for k, v in grad.items():
        v = v.astype(np.float32)
        first[k] = 0.9 * first[k] + 0.1 * v
        second[k] = 0.999 * second[k] + 0.001 * v * v
        w[k] = (w[k] - rate * (first[k] / (1 - 0.9 ** count[0])) / (np.sqrt(second[k] / (1 - 0.999 ** count[0])) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores texts with a model; keeps the input parts of words that it has seen."""

    LIMIT = 200_000

    def __init__(self, model: Model):
        self.m, w = model, model.w
        self.known: dict[str, int] = {}
        self.project = np.concatenate([w["xf"], w["xb"]], axis=1)
        self.bias = np.concatenate([w["cf"], w["cb"]])
        self.rows = np.zeros((1, 6 * HIDDEN), np.float32) + self.bias  # row 0: no word

    def _learn(self, new: list[str]) -> None:
        w = self.m.w
        own, n = grams(new)
        emb = np.zeros((len(new), WORD_DIM + CHAR_DIM), np.float32)
        emb[:, :WORD_DIM] = w["word"][[self.m.vocabulary.get(t, 0) for t in new]]
        emb[:, WORD_DIM:] = np.add.reduceat(w["char"][own], np.cumsum(n) - n) / np.sqrt(n)[:, None]
        first = len(self.rows)
        self.rows = np.concatenate([self.rows, emb @ self.project + self.bias])
        self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all texts' windows, and where each text's begin; a text without words has one empty window."""
        if len(self.known) > self.LIMIT:
            self.known, self.rows = {}, self.rows[:1]
        docs = [tokens_of(t) for t in texts]
        if new := list({t for d in docs for t in d if t not in self.known}):
            self._learn(new)
        get = self.known.__getitem__
        ids = np.array([get(t) for d in docs for t in d], np.int32)
        count = np.array([len(d) for d in docs], np.int64)
        first = np.cumsum(count) - count
        windows = np.array([len(_starts(n)) for n in count.tolist()], np.int64)
        begin = np.cumsum(windows) - windows
        doc = np.repeat(np.arange(len(docs)), windows)
        place = (np.arange(len(doc)) - begin[doc]) * STRIDE
        size = np.minimum(WINDOW, count[doc] - place)
        padded = np.concatenate([ids, np.zeros(WINDOW, np.int32)])
        step = np.arange(WINDOW)[:, None]
        start = first[doc] + place
        full = -len(doc) % ROWS  # rows without words, so that all products have one shape and equal windows equal sums
        size, start = np.concatenate([size, np.zeros(full, np.int64)]), np.concatenate([start, np.zeros(full, np.int64)])
        logit = np.empty(len(size), np.float32)
        for at in range(0, len(size), ROWS):
            k = slice(at, at + ROWS)
            x = self.rows[np.where(step < size[k], padded[np.minimum(start[k] + step, len(padded) - 1)], 0)]
            logit[k] = forward(self.m.w, x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], step < np.maximum(size[k], 1))[0]
        return logit[: len(doc)], begin

    def by_parts(self, texts: list[str], most: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """windows() of many texts, `most` at once."""
        logits, begins, at = [np.zeros(0, np.float32)], [np.zeros(0, np.int64)], 0
        for k in range(0, len(texts), most):
            logit, begin = self.windows(texts[k : k + most])
            logits.append(logit)
            begins.append(begin + at)
            at += len(logit)
        return np.concatenate(logits), np.concatenate(begins)

    def highest(self, texts: list[str]) -> np.ndarray:
        logit, begin = self.by_parts(texts)
        return np.maximum.reduceat(logit, begin) if len(begin) else logit

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.m.scale
        return sigmoid(a * self.highest(texts).astype(float) + b)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000, **options) -> Model:
    """A model from the labelled rows of docs. labels: doc_id, toxic (0 or 1).

    At most `sample` labelled rows, chosen by a hash of their id, are fetched to the driver with their whole texts,
    whatever the size of the tables; up to half of the sample is toxic. An id's label is the highest of its rows;
    rows without a label are left out. Of rows with the same id one is taken. Ties of the hash go by id. Without
    labels the model is one that wasn't trained.
    """
    pick = F.md5(F.concat(F.lit("tox:"), F.col("doc_id").cast("string")))
    l = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = l.where("toxic = 1").orderBy(pick, "doc_id").limit(sample // 2).unionByName(l.where("toxic = 0").orderBy(pick, "doc_id").limit(sample // 2))
    got = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")
    got = got.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id"])
    rows = sorted(got.collect(), key=lambda r: str(r.doc_id))
    return fit([r.text for r in rows], [int(r.toxic) for r in rows], **options)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every document: all overlapping windows of the whole text are scored, the highest counts.

    Null and empty texts are one window without words. Equal texts get equal scores, in repeated rows too: windows
    are computed in products of one shape. An empty table gives no rows; columns other than key and text are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for b in hashing.parts(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores([t or "" for t in b.column(1).to_pylist()]))], ["doc_id", "score"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc: F.Column) -> F.Column:
    return F.crc32(doc.cast("string")) % 5 == 0


def op3_attention_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    s = score(docs, train(docs, labels))
    return s.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
