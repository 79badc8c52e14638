"""p values against exact sums, positions side by side against one at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import crosssec, special, stats


def column(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_log_gamma_and_erfc(spark):
    z = [0.5, 1.0, 1.5, 2.0, 7.25, 30.0, 1e3, 1e6]
    got = column(spark, [(x,) for x in z], "z double", special.log_gamma(F.col("z")))
    assert [g[0] for g in got] == pytest.approx([math.lgamma(x) for x in z], rel=1e-12, abs=1e-12)
    x = [-3.0, -0.7, 0.0, 0.1, 1.0, 2.4, 2.6, 5.0, 9.0]
    got = column(spark, [(v,) for v in x], "x double", special.erfc(F.col("x")))
    assert [g[0] for g in got] == pytest.approx([math.erfc(v) for v in x], rel=1e-9)


def test_incomplete_beta_of_whole_numbers_is_a_binomial_tail(spark):
    rows = [(float(k), float(n - k + 1), p) for n in (1, 5, 40, 300) for k in (1, n // 2 + 1, n) for p in (0.01, 0.3, 0.5, 0.97)] + [(2.0, 3.0, 0.0), (2.0, 3.0, 1.0)]
    got = column(spark, rows, "a double, b double, x double", special.incomplete_beta(F.col("a"), F.col("b"), F.col("x")))
    for (a, b, x), (g,) in zip(rows, got, strict=True):
        n = round(a + b - 1)
        want = sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(round(a), n + 1))
        assert g == pytest.approx(want, rel=1e-9, abs=1e-13)


def t_p(r, n):
    """Student's t by its finite series."""
    s, c2 = abs(r), 1 - r * r
    if n % 2 == 0:
        term, total = 1.0, 0.0
        for j in range((n - 2) // 2):
            total += term
            term *= c2 * (2 * j + 1) / (2 * j + 2)
        return 1 - s * total
    term, total = 1.0, 0.0
    for j in range((n - 3) // 2):
        total += term
        term *= c2 * (2 * j + 2) / (2 * j + 3)
    return 1 - 2 / math.pi * (math.asin(s) + s * math.sqrt(c2) * total)


def test_p_of_a_correlation(spark):
    rows = [(r, n) for n in (3, 4, 5, 10, 31, 500, 20001) for r in (0.0, 0.01, -0.3, 0.8)] + [(1.0, 12), (-1.0, 12), (0.5, 2)]
    got = column(spark, rows, "r double, n int", special.correlation_p(F.col("r"), F.col("n")))
    for (r, n), (g,) in zip(rows, got, strict=True):
        assert g is None if n < 3 else g == pytest.approx(t_p(r, n), abs=1e-8)
    assert got[rows.index((-0.3, 31))][0] == pytest.approx(0.10102, abs=2e-4)  # as printed in tables of the t test


def test_p_of_a_share(spark):
    rows = [(50, 100), (60, 100), (0, 9), (0, 0)]
    got = column(spark, rows, "h int, n int", special.share_p(F.col("h"), F.col("n")))
    assert [g[0] for g in got[:3]] == pytest.approx([1.0, math.erfc(2 / math.sqrt(2)), math.erfc(3 / math.sqrt(2))], rel=1e-9)
    assert got[3][0] is None


def test_table_of_signals(spark):
    rng = random.Random(3)
    rows = [("strong", float(k), k + rng.gauss(0, 5)) for k in range(60)] + [("none", rng.choice([1.0, 2.0, 3.0]), rng.gauss(0, 1)) for _ in range(40)]
    rows += [("weak", float(k), 0.08 * k / 2000 + rng.gauss(0, 0.3)) for k in range(1500)] + [("few", float(k), 1.0 * k) for k in range(9)] + [("flat", 1.0, float(k)) for k in range(30)] + [("strong", None, 1.0), ("strong", 1.0, None)]
    got = {r.signal: r for r in crosssec.ic_table(spark.createDataFrame(rows, "signal string, x double, y double"), "signal", "x", "y").collect()}
    assert set(got) == {"strong", "none", "weak"}
    assert got["strong"].label == "strong" and got["strong"].n == 60 and got["strong"].place == 1
    assert got["none"].label == "none" and not got["none"].significant
    assert got["weak"].label in ("weak", "none") and abs(got["weak"].ic) < 0.1


def test_positions_side_by_side_and_by_period(spark):
    rng = random.Random(1)
    rows = [("a", t, rng.gauss(0, 0.01), "p1" if t < 60 else "p2") for t in range(150)]
    df = spark.createDataFrame(rows, "k string, t int, r double, period string")
    pos = {"hold": F.lit(1.0), "even": (F.col("t") % 2).cast("double"), "none": F.lit(None).cast("double")}
    got = {r.strategy: r for r in stats.performances(df, "k", "t", pos, "r", 0.001).collect()}
    assert got["hold"].trades == 1 and got["even"].trades == 149 and got["none"].net == 0 and got["none"].hit_rate is None and got["none"].calmar is None
    for name, p in pos.items():
        alone = stats.performance(df.withColumn("p", p), "k", "t", "p", "r", 0.001).first()
        for c in ("active", "gross", "net", "max_drawdown", "trades", "exposure", "turnover"):
            assert getattr(got[name], c) == pytest.approx(getattr(alone, c))
    split = {(r.period, r.strategy): r for r in stats.performances(df, "k", "t", pos, "r", 0.001, group="period").collect()}
    own = math.prod(1 + r[2] - (0.001 if r[1] == 0 else 0) for r in rows if r[3] == "p1") - 1
    assert split["p1", "hold"].net == pytest.approx(own) and split["p2", "hold"].trades == 0 and split["p2", "hold"].days == 90
