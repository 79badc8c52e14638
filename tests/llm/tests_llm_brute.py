"""Brute-force versions of the pair and line operators."""

import re
from collections import defaultdict

from quantloom.llm import linededup

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sets_of(rows):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def smallest(ids, links):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def lines_left(rows, code):
    """What line dedup leaves, one line and place at a time. code: the order of units of equal length."""
    W, R = 2, 3
    D = {}
    for i, t, *_ in rows:
        parts = re.split(r"(?<=\n)|(?<=[.!?] )", t or "")
        bare = [x.strip(" \t\r\n") for x in parts]
        D[i] = (parts, [x or None for x in bare], [len(x) for x in bare])
    marks = []
    units = {}
    for i, (parts, h, n) in D.items():
        u = units[i] = [(n[p], (h[p],)) if n[p] >= linededup.LONG else (n[p] + n[p + 1], (h[p], h[p + 1])) if all(h[p : p + 2]) and p + 1 < len(h) else None for p in range(len(parts))]
        rank = [(1, 0) if x is None else (-min(x[0], 2047), code[x[1]]) for x in u]
        for p in range(len(parts)):
            windows = [all(not 0 <= p + k < len(parts) or rank[p] <= rank[p + k] for k in range(f, f + W)) for f in range(-W + 1, 1)]
            if u[p] and (u[p][0] >= linededup.LONG or any(windows)):
                marks.append((i, p))
    first = {}
    for i, p in marks:
        first.setdefault(units[i][p][1], (i, p))
    at = lambda h, p: h[p] if 0 <= p < len(h) else None
    covered = defaultdict(set)
    for i, p in marks:
        a, q = first[units[i][p][1]]
        if (a, q) != (i, p):
            h, g = D[i][1], D[a][1]
            b = next((k for k in range(R) if at(h, p - k - 1) is None or at(h, p - k - 1) != at(g, q - k - 1)), R)
            e = next((k for k in range(R) if at(h, p + k + 1) is None or at(h, p + k + 1) != at(g, q + k + 1)), R)
            covered[i, a, p - q].update(range(p - (min(b, p - q - 1) if a == i else b), p + e + 1))
    gone = defaultdict(set)
    for (i, *_), places in covered.items():
        run = []
        for p in [*sorted(places), None]:
            if run and (p is None or p != run[-1] + 1):
                if sum(D[i][2][x] for x in run) >= linededup.LEAST:
                    gone[i].update(run)
                run = []
            run.append(p)
    return {i: None if t is None else "".join(x for k, x in enumerate(D[i][0]) if k not in gone[i]) for i, t, *_ in rows}


def line_codes(spark, rows):
    """The order of equally long units: Spark's hash of a line, or of two lines' hashes, without its low bits."""
    from pyspark.sql import functions as F

    docs = [[x.strip(" \t\r\n") for x in re.split(r"(?<=\n)|(?<=[.!?] )", t or "")] for _, t, *_ in rows]
    units = sorted({(x, None) for d in docs for x in d} | {p for d in docs for p in zip(d, d[1:], strict=False)}, key=str)
    h = F.when(F.col("y").isNull(), F.xxhash64("x")).otherwise(F.xxhash64(F.xxhash64("x"), F.xxhash64("y")))
    d = spark.createDataFrame(units, "x string, y string").withColumn("h", F.shiftrightunsigned(h, 12))
    return {(r.x,) if r.y is None else (r.x, r.y): r.h for r in d.collect()}
