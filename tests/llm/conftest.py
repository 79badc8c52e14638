import random

import pytest

#: Names that operators use inside; they must not clash with a table's own columns.
EXTRA = ("size", "target", "ticket", "lane", "sig", "token", "units", "kept", "h", "n", "r", "ids", "start", "vector", "bucket", "pos", "version", "code", "near", "shard", "noisy", "c", "value")


def corpus(seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source): prose with copies, near copies, shared passages, secrets, nulls, empty and odd texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "er", "th", "on", "ti", "re", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    passage = " ".join(sentence(14) for _ in range(5))
    texts: list[str | None] = []
    for k in range(60):
        lines = [" ".join(sentence(rng.randint(3, 12)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        if k % 9 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if k % 11 == 0:
            lines.append(f"password = {rng.getrandbits(128):032x} and AKIA{''.join(rng.choice('ABCDEFGHIJ234567') for _ in range(16))}")
        texts.append("\n".join(lines))
    base = texts[7] + " " + sentence(60)
    near = base.split(" ")
    for k in range(6):
        other = list(near)
        other[3 * k + 2] = "changed"
        texts.append(" ".join(other))
    texts += [texts[0]] * 4 + [None, None, "", " ", "\n\n", "one two", "one  two", "ONE\ttwo", "the end\n", "日本語 テキスト x", "x" * 3000, "!!", "a  b\n \n c "]
    texts.append(" ".join(rng.choice(words) for _ in range(6000)))
    return [(k, t, "en", [None, "s1", "s2", "s3"][k % 4] if k % 3 else "s1") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    from quantloom.llm import common

    common.ship(spark)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.withColumns({c: F.lit(1) for c in EXTRA}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
