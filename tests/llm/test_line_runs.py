"""Line dedup against its purpose: brute force over runs of lines, which knows nothing of fingerprints and windows."""

import random
import re

from quantloom.llm import linededup


def purpose(rows, least=150):
    """What stays (without white space) of texts in the order of ids: a line goes if it lies in a run of lines of
    least characters or more that an earlier place has too. Lines of white space count for nothing."""
    docs = [(i, [x for y in re.split(r"(?<=\n)|(?<=[.!?] )", t) if (x := y.strip(" \t\r\n"))]) for i, t in sorted(rows)]
    out, seen = {}, []
    for k, (i, lines) in enumerate(docs):
        gone = set()
        seen.append(lines)
        for a in range(len(lines)):
            for other, them in enumerate(seen):
                for b in range(len(them) if other < k else a):
                    n = 0
                    while a + n < len(lines) and b + n < len(them) and lines[a + n] == them[b + n]:
                        n += 1
                    if sum(map(len, lines[a : a + n])) >= least:
                        gone.update(range(a, a + n))
        out[i] = [x for p, x in enumerate(lines) if p not in gone]
    return out


def left(spark, rows):
    from quantloom.llm import common

    common.ship(spark)
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return {r.doc_id: [x for y in re.split(r"(?<=\n)|(?<=[.!?] )", r.text) if (x := y.strip(" \t\r\n"))] for r in got}


def line(rng, n):
    return "".join(rng.choice("abcdefghij") for _ in range(n))


def test_runs_go_on_across_blank_lines(spark):
    rng = random.Random(3)
    ten = [line(rng, 100) for _ in range(10)]
    double = "\n\n".join(ten)
    rows = [(1, double), (2, f"{line(rng, 90)}\n \n{double}\n\n{line(rng, 70)}\n"), (3, "\n\t\n\n".join(ten[3:6])), (4, "\n".join(ten))]
    rows += [(5, f"{line(rng, 60)}\n\n{line(rng, 60)}\n\n{line(rng, 60)}\n\n"), (6, f"{ten[0]}\n\n{line(rng, 200)}")]
    want = purpose(rows)
    assert [len(want[k]) for k in range(1, 7)] == [10, 2, 0, 0, 3, 2]
    assert left(spark, rows) == want


def test_runs_whose_parts_stand_first_elsewhere(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):  # a passage whole in two documents, its parts in three earlier ones
        p = [line(rng, 40) for _ in range(6)]
        other = lambda n: [line(rng, rng.randint(5, 60)) for _ in range(n)]
        for at, part in enumerate((p[:3], p[2:5], p[4:], p, p)):
            rows.append((10 * k + at, "\n".join(other(rng.randint(0, 3)) + part + other(rng.randint(0, 3)))))
    want = purpose(rows)
    assert all(len(want[10 * k + 4]) == len(rows[5 * k + 4][1].split("\n")) - 6 for k in range(60))
    assert left(spark, rows) == want


def test_runs_of_few_kinds_of_lines(spark):
    rng = random.Random(5)
    kinds = [line(rng, n) for n in (1, 3, 20, 30, 40, 60, 80, 100, 149, 150, 160)]
    rows = [(k, "".join(rng.choice(kinds) + rng.choice(["\n", "\n\n", "\n \n"]) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    rows += [(60, "\n".join("xyz"[k % 3] for k in range(400))), (61, "\n".join("xyz"[k % 3] for k in range(170)) + "\n" + kinds[5])]
    want = purpose(rows)
    assert left(spark, rows) == want


def test_lines_that_change_places_are_another_run(spark):
    lines = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqr"]  # 80 different lines of two characters
    swapped = list(lines)
    swapped[3], swapped[67] = swapped[67], swapped[3]
    pair = list(lines)
    pair[5] = pair[69] = "yy"
    other = list(lines)
    other[5] = other[69] = "zz"
    rows = [(1, "\n".join(lines)), (2, "\n".join(swapped)), (3, "\n".join(x + "!" for x in pair)), (4, "\n".join(x + "!" for x in other))]
    want = purpose(rows)
    assert len(want[2]) == 80 and len(want[4]) < 80  # runs of up to 126 characters stay, ones of 189 go
    assert left(spark, rows) == want


def test_many_short_lines(spark):
    rng = random.Random(7)
    kinds = [line(rng, n) for n in (1, 1, 2, 2, 2, 3, 3, 3)]
    rows = []
    for k in range(8):
        mine = [rng.choice(kinds) for _ in range(rng.randint(65, 400))]
        if k % 2:  # a stretch of an earlier document, with two of its lines exchanged now and then
            part = rows[k - 1][1].split("\n")[20:170]
            if k % 4 == 1 and len(part) > 80:
                part[4], part[68] = part[68], part[4]
            mine[10:10] = part
        rows.append((k, "\n".join(mine)))
    want = purpose(rows)
    assert any(len(want[k]) < len(rows[k][1].split("\n")) for k in range(8))
    assert left(spark, rows) == want
