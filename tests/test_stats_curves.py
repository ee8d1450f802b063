"""Two-sample statistics and survival curves against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repometrics.operators import curves, stats


def members(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        in_a = rng.random() < 0.3
        rows += [("ties", float(rng.randint(0, 4) + in_a * (rng.random() < 0.3)), in_a),
                 ("wide", rng.gauss(0, 1) + 0.2 * in_a, in_a),
                 ("constant", 0.1, in_a),
                 ("split", 2.0 if in_a else 1.0, in_a)]
    rows += [("lonely", 1.0, True), ("lonely", 2.0, True), ("missing", None, True), ("pair", 3.0, True), ("pair", 4.0, False)]
    return rows


@pytest.fixture(scope="module", params=[11, 12])
def data(request, spark):
    rows = members(request.param)
    df = spark.createDataFrame(rows, "f string, x double, a boolean")
    groups = {}
    for f, x, a in rows:
        if x is not None:
            groups.setdefault(f, ([], []))[0 if a else 1].append(x)
    return groups, stats.two_group_histogram(df, "f", "x", F.col("a"))


def ranks(xs):
    order = {}
    for i, x in enumerate(sorted(xs)):
        order.setdefault(x, []).append(i + 1)
    return {x: sum(r) / len(r) for x, r in order.items()}


def sf(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def test_histogram_drops_missing_values(data):
    groups, hist = data
    assert {r.factor for r in hist.collect()} == set(groups)
    assert sum(r.a + r.b for r in hist.collect()) == sum(len(a) + len(b) for a, b in groups.values())


def test_ranks_and_distribution_functions(data):
    groups, hist = data
    for r in stats.average_rank(hist).collect():
        a, b = groups[r.factor]
        assert r["rank"] == ranks(a + b)[r.x]
    for r in stats.ecdf(hist).filter("factor = 'ties'").collect():
        a, b = groups["ties"]
        assert r.ecdf_a == pytest.approx(np.mean([v <= r.x for v in a]))
        assert r.ecdf_b == pytest.approx(np.mean([v <= r.x for v in b]))


def test_significance_table(data, spark):
    groups, hist = data
    got = {r.factor: r for r in stats.significance_table(hist).collect()}
    assert set(got) == set(groups)
    law = spark._jvm.org.apache.commons.math3.distribution.FDistribution
    for name in ("ties", "wide", "split"):
        (a, b), r = groups[name], got[name]
        n1, n2 = len(a), len(b)
        n = n1 + n2
        assert (r.meana, r.meda, r.meanb, r.medb) == pytest.approx((np.mean(a), np.median(a), np.mean(b), np.median(b)))
        assert (r.stda, r.stdb) == pytest.approx((np.std(a, ddof=1), np.std(b, ddof=1)))
        pooled = ranks(a + b)
        ties = sum(t**3 - t for t in ((a + b).count(x) for x in set(a + b)))
        c = 1 - ties / (n**3 - n)
        r1, r2 = sum(pooled[x] for x in a), sum(pooled[x] for x in b)
        h = (12 / (n * (n + 1)) * (r1**2 / n1 + r2**2 / n2) - 3 * (n + 1)) / c
        assert (r.k_stat, r.k_pval) == pytest.approx((h, math.erfc(math.sqrt(h / 2))), rel=1e-9, abs=1e-12)
        u = r1 - n1 * (n1 + 1) / 2
        sd = math.sqrt(c * n1 * n2 * (n + 1) / 12)
        z = [(v - n1 * n2 / 2 - 0.5) / sd for v in (max(u, n1 * n2 - u), n1 * n2 - u, u)]
        assert r.u_stat == u
        assert (r.u_pval, r.u_pval_less, r.u_pval_greater) == pytest.approx((min(1, 2 * sf(z[0])), sf(z[1]), sf(z[2])))
        grand = np.mean(a + b)
        between = n1 * (np.mean(a) - grand) ** 2 + n2 * (np.mean(b) - grand) ** 2
        within = sum((np.array(a) - np.mean(a)) ** 2) + sum((np.array(b) - np.mean(b)) ** 2)
        if name == "split":
            assert within == 0 and r.f_stat == float("inf") and r.f_pval == 0
        else:
            f = between / (within / (n - 2))
            assert r.f_stat == pytest.approx(f)
            assert r.f_pval == pytest.approx(1 - law(1.0, float(n - 2)).cumulativeProbability(float(f)), abs=1e-10)
    flat = got["constant"]
    assert (flat.meana, flat.stda) == (0.1, 0.0)
    for r in (flat, got["lonely"]):
        assert [r[c] for c in ("f_stat", "f_pval", "k_stat", "k_pval", "u_stat", "u_pval", "u_pval_less")] == [None] * 7
    assert got["lonely"].meanb is None and got["pair"].stda is None
    ordered = [r.u_pval for r in stats.significance_table(hist).collect()]
    known = [p for p in ordered if p is not None]
    assert known == sorted(known) and ordered[: len(known)] == known


def test_separate_tests_agree_with_the_table(data):
    groups, hist = data
    table = {r.factor: r.asDict() for r in stats.significance_table(hist).collect()}
    for test in (stats.two_group_summary, stats.anova_f, stats.kruskal_h, stats.mann_whitney_u):
        for r in test(hist).collect():
            for column, value in r.asDict().items():
                want = table[r.factor][column]
                # sums of doubles depend on the order of partitions in their last digits
                same = value == want if value is None or isinstance(value, str) else value == pytest.approx(want, rel=1e-9)
                assert same, (r.factor, column, value, want)


def test_kolmogorov_smirnov(data):
    groups, hist = data
    got = {r.factor: r for r in stats.ks_two_sample(hist).collect()}
    for name, (a, b) in groups.items():
        r = got[name]
        assert (r.n_a, r.n_b) == (len(a), len(b))
        if not a or not b:
            assert r.ks_stat is None and r.ks_pval is None
            continue
        points = sorted(set(a + b))
        d = max(abs(np.mean(np.array(a) <= p) - np.mean(np.array(b) <= p)) for p in points)
        t = math.sqrt(len(a) * len(b) / (len(a) + len(b))) * d
        p = 1.0 if t < 0.1 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 300))
        assert r.ks_stat == pytest.approx(d)
        assert r.ks_pval == pytest.approx(min(1, max(0, p)), abs=1e-9)


def numpy_curve(groups, edges):
    out = {}
    for g, xs in groups.items():
        counts, _ = np.histogram(xs, bins=edges)
        out[g] = counts[::-1].cumsum()[::-1] / counts.sum()
    return out


def check(df, want, edges):
    got = {}
    for r in df.collect():
        got.setdefault(r.grp, {})[r.bin] = r
    assert set(got) == set(want)
    for g, curve in want.items():
        assert sorted(got[g]) == list(range(len(curve)))
        np.testing.assert_allclose([got[g][i].survival for i in range(len(curve))], curve, atol=1e-12)
        np.testing.assert_allclose([got[g][i].edge for i in range(len(curve))], edges[:-1], rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize("edges", [1000, 11])
def test_linear_curve(make, edges):
    rng = random.Random(5)
    rows = [(rng.choice(["p", "q"]), rng.choice([None, float(rng.randint(-3, 9)), rng.gauss(2, 3)])) for _ in range(500)]
    xs = {g: np.array([x for k, x in rows if k == g and x is not None]) for g in "pq"}
    both = np.concatenate(list(xs.values()))
    bins = np.linspace(both.min(), both.max() + 0.001, edges)
    check(curves.survival_curve_linear(make(rows, "g string, v double"), "v", "g", edges), numpy_curve(xs, bins), bins)


def test_log_curve_counts_missing_as_floor(make):
    rng = random.Random(6)
    rows = [(rng.choice(["p", "q"]), rng.choice([None, 0, 1, rng.randint(1, 5000)])) for _ in range(500)]
    xs = {g: np.array([x if x and x > 0.9 else 0.9 for k, x in rows if k == g]) for g in "pq"}
    both = np.concatenate(list(xs.values()))
    bins = np.logspace(np.log10(both.min()), np.log10(both.max()) + 0.001, 1000)
    # the lowest edge must not lose the floor values to rounding
    bins[0] = min(bins[0], 0.9)
    check(curves.survival_curve_log(make(rows, "g string, v int"), "v", "g"), numpy_curve(xs, bins), bins)


def test_clipped_curve_from_histogram(make):
    rows = [("s", 0.0, 5, 9), ("s", 0.05, 2, 1), ("s", 0.3, 1, 0), ("s", 0.7, 0, 4), ("t", 0.1, 1, 1)]
    hist = make(rows, "factor string, x double, a bigint, b bigint")
    out = curves.survival_curve_clipped(hist, ["s"], cap=0.2)
    a = np.repeat([0.0, 0.05, 0.2], [5, 2, 1])
    b = np.repeat([0.0, 0.05, 0.2], [9, 1, 4])
    bins = np.linspace(0, 0.2 + 0.001, 1000)
    check(out, numpy_curve({"DS": a, "non-DS": b}, bins), bins)


def test_category_curve(make):
    hist = make([("s", 0.0, 1, 2, 3), ("s", 0.1, 4, 0, 1)], "factor string, x double, ml0 bigint, `no-ml-dependency` bigint, test bigint")
    out = curves.survival_curve_by_category(hist)
    assert {r.grp for r in out.collect()} == {"ml0", "no-ml-dependency", "test"}
    last = {r.grp: r.survival for r in out.filter("bin = 900").collect()}
    assert last == {"ml0": 0.8, "no-ml-dependency": 0.0, "test": 0.25}


def _enumerated(m, n):
    """Of all orders of two groups: how often each U, and each distance times m * n, comes up."""
    from collections import Counter
    from itertools import combinations

    above, apart = Counter(), Counter()
    for chosen in combinations(range(m + n), m):
        i = j = u = d = 0
        for k in range(m + n):
            if k in chosen:
                i, u = i + 1, u + j
            else:
                j += 1
            d = max(d, abs(i * n - j * m))
        above[u] += 1
        apart[d] += 1
    return above, apart


def _tails(make, sizes):
    """(m, n, k, P(U >= k), P(distance >= k)) for all k, by the expressions."""
    from repometrics.functions import distance_tail, u_distribution, upper_tail

    rows = make([(m, n) for m, n in sizes], "m int, n int").withColumn("ways", u_distribution("m", "n"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") * F.col("n"))))
    return rows.select("m", "n", "k", upper_tail("ways", "k"), distance_tail("m", "n", "k")).collect()


def test_exact_tails_equal_enumeration(make):
    sizes = [(m, n) for m in range(1, 9) for n in range(1, 9) if m + n <= 13 or m == n]
    found = {(m, n): _enumerated(m, n) for m, n in sizes}
    checked = 0
    for m, n, k, u, d in _tails(make, sizes):
        above, apart = found[m, n]
        total = sum(above.values())
        assert u == pytest.approx(sum(c for v, c in above.items() if v >= k) / total, rel=1e-10, abs=1e-15), (m, n, k)
        assert d == pytest.approx(sum(c for v, c in apart.items() if v >= k) / total, rel=1e-10, abs=1e-15), (m, n, k)
        checked += 1
    assert checked == sum(m * n + 1 for m, n in sizes)


def test_exact_tails_keep_their_digits(make):
    """Of two groups of 40 the most extreme order has a probability of 1 / C(80, 40), and twice that either way."""
    from math import comb

    last = {(m, n): (u, d) for m, n, k, u, d in _tails(make, [(40, 40), (3, 300)]) if k == m * n}
    assert last[40, 40] == pytest.approx((1 / comb(80, 40), 2 / comb(80, 40)), rel=1e-9)
    assert last[3, 300] == pytest.approx((1 / comb(303, 3), 2 / comb(303, 3)), rel=1e-9)


def test_exact_probabilities_of_small_factors(make, values):
    """Small groups without ties get exact ones; ties, large and one-sided groups keep the others."""
    rows = [("small", x, k in (0, 3, 4)) for k, x in enumerate((1.0, 2.5, 3.0, 7.0, 8.0, 11.0, 12.5))]
    rows += [("ties", x, k % 2 == 0) for k, x in enumerate((1.0, 1.0, 2.0, 3.0, 4.0))]
    rows += [("large", float(k * 37 % 101), k % 2 == 0) for k in range(100)] + [("one", 1.0, True), ("one", 2.0, True)]
    hist = stats.two_group_histogram(make(rows, "factor string, x double, in_a boolean"), "factor", "x", F.col("in_a"))
    plain = {r.factor: r for r in stats.mann_whitney_u(hist).collect()}
    exact = {r.factor: r for r in stats.mann_whitney_u(hist, exact_up_to=8).collect()}
    assert all(plain[f] == exact[f] for f in ("ties", "large", "one"))
    above, apart = _enumerated(3, 4)
    u = int(exact["small"].u_stat)
    tail = lambda x: sum(c for v, c in above.items() if v >= x) / 35
    assert [exact["small"][c] for c in ("u_pval", "u_pval_less", "u_pval_greater")] == pytest.approx([min(1, 2 * tail(max(u, 12 - u))), tail(12 - u), tail(u)], abs=1e-12)
    table = {r.factor: r.u_pval for r in stats.significance_table(hist, exact_up_to=8).collect()}
    assert table == {f: r.u_pval for f, r in exact.items()}
    near = {r.factor: r for r in stats.ks_two_sample(hist, exact_pairs=100).collect()}
    far = {r.factor: r for r in stats.ks_two_sample(hist).collect()}
    d = round(near["small"].ks_stat * 12)
    assert near["small"].ks_pval == pytest.approx(sum(c for v, c in apart.items() if v >= d) / 35, abs=1e-12)
    assert near["large"] == far["large"] and near["one"] == far["one"]


def test_ordered_by_probability_beyond_six_places(make):
    """Strong factors are told apart however small their probabilities."""
    rows = [(f"f{s}", float(k + (s * 40 if k % 2 else 0)), k % 2 == 0) for s in (1, 2, 3) for k in range(400)]
    hist = stats.two_group_histogram(make(rows, "factor string, x double, in_a boolean"), "factor", "x", F.col("in_a"))
    found = stats.significance_table(hist).collect()
    assert [r.factor for r in found] == ["f3", "f2", "f1"] and all(0 < a.u_pval < b.u_pval for a, b in zip(found, found[1:]))
    assert found[0].u_pval < 1e-15 and found[1].u_pval < 1e-6
