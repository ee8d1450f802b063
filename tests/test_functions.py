"""Scalar expressions, version rules and tail probabilities."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from repometrics import functions as fn

# (either, neither, python2, python3) -> (summary, select)
TRUTH = {
    (0, 0, 0, 0): ("empty", False), (0, 0, 0, 1): ("only3", True),
    (0, 0, 1, 0): ("only2", False), (0, 0, 1, 1): ("mix", True),
    (0, 1, 0, 0): ("neither", False), (0, 1, 0, 1): ("neither", True),
    (0, 1, 1, 0): ("neither", False), (0, 1, 1, 1): ("neither", True),
    (1, 0, 0, 0): ("either", True), (1, 0, 0, 1): ("only3", True),
    (1, 0, 1, 0): ("only2", False), (1, 0, 1, 1): ("mix", True),
    (1, 1, 0, 0): ("neither", True), (1, 1, 0, 1): ("neither", True),
    (1, 1, 1, 0): ("neither", False), (1, 1, 1, 1): ("neither", True),
}


def test_version_truth_table(make):
    df = make(list(itertools.product([0, 1], repeat=4)), "either int, neither int, python2 int, python3 int")
    cols = [F.col(c) for c in df.columns]
    got = df.select("*", fn.version_summary(*cols).alias("s"), fn.version_select(*cols).alias("p")).collect()
    assert {tuple(r)[:4]: (r.s, r.p) for r in got} == TRUTH


def test_select_compares_counts(make):
    df = make([(5, 0, 3, 2), (5, 0, 2, 2), (0, 0, 0, 7)], "either int, neither int, python2 int, python3 int")
    cols = [F.col(c) for c in df.columns]
    assert [r[0] for r in df.select(fn.version_select(*cols)).collect()] == [False, True, True]


def test_py_version_label(make):
    df = make([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    got = [r[0] for r in df.select(fn.py_version_label(F.col("a"), F.col("b"))).collect()]
    assert got == ["either", "python2", "python3", "neither"]


@pytest.mark.parametrize("name, want", [
    ("sklearn.model_selection.x", "sklearn"), ("numpy", "numpy"), (".sibling", ""), (None, ""), ("", ""),
])
def test_import_short_name_n7(make, name, want):
    got = make([(name,)], "n string").select(fn.import_short_name("n")).first()[0]
    assert got == want


@pytest.mark.parametrize("text, want", [
    ("", 0), ("\n", 0), ("  \n\t\n", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\n\r\n b \r\n", 2),
    ("a\x0b\n\x0c\nb\x00\n", 2), (None, None),
])
def test_nonblank_lines(make, text, want):
    assert make([(text,)], "t string").select(fn.nonblank_lines("t")).first()[0] == want


def test_clamps(make):
    df = make([(0.5,), (0.9,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fn.clamp_below("x", 0.9)).collect()] == [0.9, 0.9, 2.0, 0.9]
    assert [r[0] for r in df.select(fn.clamp_above("x", 0.9)).collect()] == [0.5, 0.9, 0.9, None]


def test_strip_and_days(make):
    row = make([(" \t a b\r\n", 129600)], "t string, s bigint").select(fn.strip("t"), fn.epoch_days(F.col("s"))).first()
    assert tuple(row) == ("a b", 1.5)


def test_erfc_and_normal_tail(make):
    xs = [-6.0, -3.0, -1.0, -0.1, 0.0, 1e-9, 0.3, 1.0, 1.9999, 2.0, 2.5, 4.0, 9.0, 25.0]
    for r in make([(x,) for x in xs], "x double").select("x", fn.erfc("x").alias("e"), fn.normal_tail("x").alias("n")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-12)
        assert r.n == pytest.approx(0.5 * math.erfc(r.x / math.sqrt(2)), rel=1e-12)


def test_chi_square_tail(spark, make):
    law = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(1.0)
    for r in make([(h,) for h in (0.0, 0.01, 1.0, 3.84, 30.0)], "h double").select("h", fn.chi2_tail_df1("h").alias("p")).collect():
        assert r.p == pytest.approx(1 - law.cumulativeProbability(r.h), abs=1e-12)


def t_tail(t, df):
    """P(|T| > t), by Simpson's rule over the density; its factor as a product."""
    m = df // 2
    product = math.fsum(math.log1p(-1 / (2 * k)) for k in range(1, m + 1))
    # Gamma((df+1)/2) / Gamma(df/2)
    half = 0.5 * math.log(math.pi) + math.log(m) + product if df % 2 == 0 else -0.5 * math.log(math.pi) - product
    front = half - 0.5 * math.log(math.pi * df)
    n, width = 40_000, max(1.0, 60 / t)
    def density(x):
        return math.exp(front - (df + 1) / 2 * math.log1p(x * x / df))
    h = width / n
    return 2 * h / 3 * math.fsum(density(t + k * h) * (1 if k in (0, n) else 4 if k % 2 else 2) for k in range(n + 1))


def test_f_tail(spark, make):
    law = spark._jvm.org.apache.commons.math3.distribution.FDistribution
    grid = [(f, d) for f in (1e-3, 0.3, 1.0, 4.0, 12.0) for d in (1.0, 2.0, 7.0, 100.0, 9999.0, 10001.0, 1e5)]
    for r in make(grid, "f double, d double").select("f", "d", fn.f_tail_df1("f", "d").alias("p")).collect():
        assert r.p == pytest.approx(1 - law(1.0, r.d).cumulativeProbability(r.f), abs=1e-8), r
    # small tails, to relative size: the density of t integrated where it matters
    grid = [(f, d) for f in (5.0, 40.0, 100.0, 400.0) for d in (9998.0, 9999.0, 10001.0, 20000.0, 1e6)]
    for r in make(grid, "f double, d double").select("f", "d", fn.f_tail_df1("f", "d").alias("p")).collect():
        assert r.p == pytest.approx(t_tail(math.sqrt(r.f), int(r.d)), rel=1e-9), r
    edge = make([(0.0, 5.0), (float("inf"), 5.0), (None, 5.0)], "f double, d double")
    assert [r[0] for r in edge.select(fn.f_tail_df1("f", "d")).collect()] == [1.0, 0.0, None]


def test_kolmogorov_tail(make):
    ts = [0.0, 0.2, 0.5, 0.9999, 1.0, 1.36, 3.0]
    for r in make([(t,) for t in ts], "t double").select("t", fn.kolmogorov_tail("t").alias("p")).collect():
        want = 1.0 if r.t < 0.1 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * r.t**2) for k in range(1, 500))
        assert r.p == pytest.approx(want, abs=1e-12)


def test_epoch_text_and_days_between(spark, make):
    df = make([(0, "2016-01-01 00:00:00", "2020-03-11 12:00:00"), (1580000001, None, "2020-03-11 00:00:00")],
              "s bigint, a string, b string")
    got = df.select(fn.epoch_iso(F.col("s")).alias("iso"),
                    fn.days_between(F.to_timestamp("a"), F.to_timestamp("b")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("1970-01-01T00:00:00+00:00", 1531.5), ("2020-01-26T00:53:21+00:00", None)]
