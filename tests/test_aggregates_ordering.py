"""Aggregations, running totals and row numbers against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.operators import aggregates as agg
from repometrics.operators import ordering

IMPORTS = "repo bigint, path string, module_name string, import_name string, parse_error boolean"


@pytest.fixture
def imports(make):
    return make([
        (1, "1/a", "a", "numpy.linalg", False), (1, "1/a", "a", "pytest", False),
        (1, "1/b", "b", "numpy", False), (1, "1/b", "b", "pandas", False),
        (1, "1/c", "c", None, True), (2, "2/a", "a", "os", False), (2, "2/a", "a", ".mock", False),
        (2, "2/b", "b", "torch.nn", False),
    ], IMPORTS)


def test_popular_imports_order_n13(imports):
    got = [tuple(r) for r in agg.popular_imports(imports).collect()]
    assert got == [("", 2), ("numpy", 1), ("os", 1), ("pandas", 1), ("pytest", 1), ("torch", 1)]


def test_test_label_wins_n6_and_list_is_literal_n15(imports, values):
    assert values(agg.label_files(imports)) == [
        (1, "1/a", "test"), (1, "1/b", "ml0"), (1, "1/c", "no-ml-dependency"),
        (2, "2/a", "no-ml-dependency"), (2, "2/b", "no-ml-dependency")]
    assert "torch" not in C.DS_LIBRARIES and "pytorch" in C.DS_LIBRARIES
    relabelled = agg.label_files(imports, libs=(*C.DS_LIBRARIES, "torch"))
    assert (2, "2/b", "ml0") in values(relabelled)


def test_library_sets(imports, values):
    sets = agg.library_sets(imports)
    assert values(sets) == [(1, ["numpy", "pandas"]), (2, [])]
    assert values(agg.library_set_popularity(sets)) == [([], 1), (["numpy", "pandas"], 1)]


def test_version_tables(make, values):
    ver = make([(1, "a", "either"), (1, "b", "python3"), (1, "c", "python3"), (2, "a", "neither"), (3, "a", None)],
               "repo bigint, path string, ver string")
    assert values(agg.version_pivot(ver)) == [(1, 1, 0, 0, 2), (2, 0, 1, 0, 0)]
    assert values(agg.version_table(ver), "repo", "summary", "select") == [(1, "only3", True), (2, "neither", False)]
    assert values(agg.count_by_repo_version(ver.dropna())) == [(1, "either", 1), (1, "python3", 2), (2, "neither", 1)]
    assert values(agg.version_summary_counts(agg.version_table(ver))) == [("neither", 1), ("only3", 1)]


def test_loc_of_unreadable_files_n12(make, values):
    loc = make([(1, 5), (1, None), (2, None), (3, 0)], "repo bigint, nonblank_loc bigint")
    assert values(agg.loc_by_repo(loc)) == [(1, 5), (2, 0), (3, 0)]


def test_complexity_uses_functions_only(make, values):
    cc = make([(1, "a", "method", 2), (1, "a", "class", 90), (1, "b", "function", 4), (2, "c", "class", 9)],
              "repo bigint, path string, type string, complexity int")
    assert values(agg.mean_complexity_by_repo(cc)) == [(1, 3.0)]
    assert values(agg.mean_complexity_by_file(cc)) == [(1, "a", 2.0), (1, "b", 4.0)]


def test_label_profile_without_division_error_n19(make, values):
    labels = make([(1, "a", "ml0"), (1, "b", "test"), (1, "b", "test"), (2, "c", None), (3, "d", "test")],
                  "repo bigint, path string, cat string")
    assert values(agg.repo_label_profile(labels)) == [(1, 1, 0, 1, 2, 0.5), (3, 0, 0, 1, 1, 0.0)]
    # files of other categories count in the total
    other = make([(1, "a", "other"), (2, "a", "other"), (2, "b", "ml0")], "repo bigint, path string, cat string")
    assert values(agg.repo_label_profile(other)) == [(1, 0, 0, 0, 1, 0.0), (2, 1, 0, 0, 2, 0.5)]


def test_repos_with_all_categories(make, values):
    rows = make([(1, c) for c in C.CATEGORIES] + [(2, "ml0"), (2, "test"), (3, None)], "repo bigint, cat string")
    assert values(agg.repos_with_all_categories(rows)) == [(1,)]


def test_counts_shares_and_cardinality(make, values):
    df = make([("a", 1), ("a", None), (None, 2), ("b", 2)], "k string, v int")
    assert values(agg.value_counts(df, "k")) == [("a", 2), ("b", 1)]
    assert values(agg.value_counts(df, "k", with_null=True)) == [("a", 2), ("b", 1), (None, 1)]
    assert values(agg.value_share(df, "k")) == [("a", 0.5), ("b", 0.25)]
    assert values(agg.column_cardinality(df, ["k", "v"])) == [("k", 2), ("v", 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_describe_matches_pandas(make, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("pq"), rng.choice([None, float(rng.randint(0, 9)), rng.gauss(0, 1)])) for _ in range(300)]
    rows += [("one", 4.0), (None, 1.0), ("none", None)]
    df = make(rows, "k string, x double")
    want = pd.DataFrame(rows, columns=["k", "x"]).dropna().groupby("k")["x"].describe()
    got = {r.k: r for r in agg.describe_grouped(df, "x", ["k"]).collect()}
    assert set(got) == set(want.index)
    for k, w in want.iterrows():
        g = got[k]
        assert g["std"] is None if np.isnan(w["std"]) else g["std"] == pytest.approx(w["std"])
        pairs = zip((g["count"], g["mean"], g["min"], g["q25"], g["q50"], g["q75"], g["max"]), w.drop("std"))
        assert all(a == pytest.approx(b) for a, b in pairs)
    whole = agg.describe_numeric(df, "x").first()
    assert whole["count"] == int(pd.Series([x for _, x in rows]).count())


def test_running_totals_over_several_ranges(spark, make):
    rng = random.Random(3)
    # one key holds most rows, so it spans many ranges
    data = {(("hot" if rng.random() < 0.8 else rng.choice("ab")), rng.random()): rng.randint(1, 9) for _ in range(4000)}
    df = make([(k, x, n) for (k, x), n in data.items()], "k string, x double, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordering.running_totals(df, ["k"], ["x"], {"n": F.col("n")}, {"nx": F.col("n") * F.col("x")})
        got = {(r.k, r.x): (r.before_n, r.total_n, r.total_nx) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    pdf = pd.DataFrame([(k, x, n) for (k, x), n in data.items()], columns=["k", "x", "n"]).sort_values(["k", "x"])
    pdf["before"] = pdf.groupby("k")["n"].cumsum() - pdf["n"]
    pdf["total"] = pdf.groupby("k")["n"].transform("sum")
    pdf["nx"] = (pdf["n"] * pdf["x"]).groupby(pdf["k"]).transform("sum")
    assert len(got) == len(pdf)
    for r in pdf.itertuples():
        assert got[(r.k, r.x)] == (r.before, r.total, pytest.approx(r.nx))


def test_chunks_and_slices(make, values):
    df = make([(i, i % 3) for i in range(10)], "id bigint, created_at int")
    want = sorted(range(10), key=lambda i: (-(i % 3), i))
    rows = ordering.chunk_list(df, size=4).orderBy("row_number").collect()
    assert [r.id for r in rows] == want
    assert [r.label for r in rows] == ["000001-000004"] * 4 + ["000005-000008"] * 4 + ["000009-000010"] * 2
    cut = ordering.slice_rows(df, 2, 5, [F.desc("created_at"), F.asc("id")]).orderBy("row_number")
    assert [r.id for r in cut.collect()] == want[2:5]


def test_orders(make):
    df = make([(1, 5), (2, 9), (3, 9)], "id bigint, created_at int")
    assert [r.id for r in ordering.recent_first(df).collect()] == [2, 3, 1]
    assert [r.id for r in ordering.popular_first(df, "created_at", "id").collect()] == [2, 3, 1]
    p = make([("b", None), ("a", None), ("c", 0.5), ("d", 0.1)], "factor string, u_pval double")
    assert [r.factor for r in ordering.most_significant_first(p).collect()] == ["d", "c", "a", "b"]


def test_sorted_distinct_keeps_every_value(make):
    df = make([(i % 25,) for i in range(100)] + [(None,)], "v int")
    rows = ordering.sorted_distinct(df, "v", per_row=10).collect()
    assert [r.part for r in rows] == [0, 1, 2]
    assert ", ".join(r.listing for r in rows) == ", ".join(map(str, range(25)))


def test_ties_are_broken_by_the_named_columns(make, values):
    rows = make([(1, i) for i in range(300)], "k int, id int")
    got = ordering.slice_rows(rows, 10, 13, ["k"], tie_break=["id"])
    assert values(got, "id", "row_number") == [(10, 11), (11, 12), (12, 13)]
