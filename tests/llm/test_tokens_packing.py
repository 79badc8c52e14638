from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import common, packing, token_files, tokens


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(file, rows):
    import random

    e, rng = tokens.encoder(file), random.Random(1)
    odd = ["".join(rng.choice([" ", "\n", "a", "The", "é", "12", "!!", "'s", "\t", "\xa0", "Σ", "<|endoftext|>", "\r\n", "日", "\0"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for t in [r[1] for r in rows if r[1]] + odd:
        assert e.ids(t) == e.whole(t), repr(t[:80])


def test_workers_give_memory_back():
    """After a batch a worker holds nothing for later use that Arrow could give back."""

    def held() -> float:
        with open("/proc/self/smaps_rollup") as f:
            return int(next(line for line in f if line.startswith("Private_Dirty")).split()[1]) / 1024

    rng, e = np.random.default_rng(3), tokens.encoder("byte_bpe_50k.json")
    words = np.array(["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(20_000)])
    texts = pa.array([" ".join(words[rng.integers(0, len(words), 700)]) for _ in range(6_000)])
    assert sum(len(ids) for ids in e.encode(texts, b"\0\0\0\0")) == len(texts)
    before = held()
    pa.default_memory_pool().release_unused()
    assert before - held() < 40, "MB"


def test_codec():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (2**8, 2**16, 2**24, 2**32):
            v = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            control, data = token_files.encode(v)
            assert len(control) == -(-n // 4)
            assert (token_files.decode(control, data, n) == v).all()


def test_token_files(spark, docs, rows, none):
    path = f"{common.shared_dir(spark)}/t"
    token_files.write(docs, path)
    got = {r.doc_id: r for r in token_files.with_start(token_files.read(spark, path)).collect()}
    start, e = 0, tokens.encoder("word_bpe_49k.json")
    for i, t, *_ in sorted(rows):
        ids = (e.whole(t) if t else b"") + np.array([2], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids) // 4, ids)
        start += len(ids) // 4
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r.uses for r in ranks] == sorted((r.uses for r in ranks), reverse=True) and sum(r.uses for r in ranks) == start
    token_files.write(none, f"{path}-none")
    assert token_files.read(spark, f"{path}-none").count() == 0
    token_files.write(docs.unionByName(docs), f"{path}-twice")
    assert token_files.read(spark, f"{path}-twice").count() == 2 * len(rows)


def test_packing(docs, rows, none):
    p = packing.pieces(docs.unionByName(docs.where("doc_id = 3"))).collect()
    e = tokens.encoder("byte_bpe_50k.json")
    of, seq = defaultdict(list), defaultdict(list)
    for r in p:
        of[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        seq[r.sequence_id].append((r.offset, len(r.ids) // 4))
    for i, t, *_ in rows:
        ids = (e.whole(t) if t else b"") + np.array([0], "<u4").tobytes()
        times = 2 if i == 3 else 1
        assert sum(len(x) for _, x, _ in of[i]) == times * len(ids)
        if times == 1:
            assert b"".join(x for _, x, _ in sorted(of[i])) == ids
        assert all(n == len(ids) // 4 and ids[4 * s : 4 * s + len(x)] == x for s, x, n in of[i])
    total = 0
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
        total += at
    assert len(seq) <= total / 1024 + 6  # a short sequence per shard at most
    assert packing.pieces(none).count() == 0


def test_neighbours_fill_windows():
    a, b = np.arange(100, dtype="<u4"), np.arange(1000, 1100, dtype="<u4")
    windows = list(packing.fill([a, b, a.copy(), b.copy()], 200))
    assert [{d for d, _, _ in w} for w in windows] == [{0, 2}, {1, 3}]


def test_scores_of_what_is_left_stay():
    rng = np.random.default_rng(5)
    index = packing.Index([rng.integers(0, 300, rng.integers(1, 400)).astype("<u4") for _ in range(60)])
    left, before, postings = rng.random(60) < 0.4, index.scores(7), len(index.doc)
    index.drop(left)
    assert (index.scores(7)[left] == before[left]).all() and len(index.doc) < postings


def test_pieces_of_words_are_words_too():
    """One cache: whatever was cut before, a word's ids are the library's."""
    e = tokens.Encoder("byte_bpe_50k.json", False)
    for text in ("Foo, foo,, bar", " foo Foo ,, ,", "naïve, naïve", "x1 x 1", "'s it's"):
        assert e.ids(text) == e.whole(text)
    assert e.words[","] == e.whole(",") and " foo" in e.words


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_batches_ask_for_each_word_once(file):
    """Texts of one batch, whole ones and nulls among them; the cache is asked once for a word, however often it stands there."""
    texts = ["foo Foo, bar.\nfoo", None, "", "a \t b", "<|ENDOFTEXT|> <|endoftext|> x", "\0 foo", "É été, ΣΑΣ İ!", " foo\n\n", "foo " * 5000]
    e, asked = tokens.Encoder(file, file.startswith("word")), []

    class Known(tokens._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    e.words = Known(e._word)
    e.words[""] = b""
    got = [x.as_py() for part in e.encode(pa.array(texts), b"end.") for x in part]
    assert got == [(e.whole(t) if t else b"") + b"end." for t in texts]
    assert len(asked) < 60
