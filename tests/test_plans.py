"""Composite plans: lint density, selection, candidates, comparisons."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest

from repometrics import plans
from repometrics.operators import reshape
from repometrics.plans.lint import lint_cells

LINT = "repo bigint, path string, type string, symbol string, message_id string, parse_error boolean, internal_error boolean"


def corpus(seed):
    rng = random.Random(seed)
    lint, loc, labels = [], [], []
    for repo in range(1, 26):
        for f in range(rng.randint(1, 6)):
            path = f"{repo}/{f}"
            for _ in range(rng.randint(0, 5)):
                symbol = rng.choice(["s1", "s2", "s3"])
                lint.append((repo, path, rng.choice(["warning", "warning", "fatal", None]), symbol, f"M{symbol}",
                             rng.random() < 0.05, rng.random() < 0.05))
            if rng.random() < 0.3:
                lint.append((repo, path, None, None, None, False, False))
            if rng.random() < 0.9:
                loc.append((repo, path, rng.choice([None, 0, rng.randint(1, 80), rng.randint(1, 80)]), False))
            if rng.random() < 0.8 and repo != 3:
                labels.append((repo, path, rng.choice(["ml0", "test", "no-ml-dependency", None])))
    # a symbol that occurs only in an empty file keeps its place in the tables
    lint.append((1, "1/x", "warning", "s9", "M9", False, False))
    loc.append((1, "1/x", 0, False))
    return lint, loc, labels, [(r,) for r in range(1, 9)]


def wide_reference(lint, loc, labels, ds, keys):
    """Dense table by way of a wide frame."""
    lint = pd.DataFrame(lint, columns=["repo", "path", "type", "symbol", "mid", "pe", "ie"])
    lint = lint[~lint.pe & ~lint.ie & (lint.type != "fatal")]
    wide = lint.pivot_table(index=["repo", "path"], columns="symbol", values="mid", aggfunc="count").reset_index()
    symbols = [c for c in wide.columns if c not in ("repo", "path")]
    labels = pd.DataFrame(labels, columns=["repo", "path", "cat"])
    merged = wide.merge(pd.DataFrame(loc, columns=["repo", "path", "loc", "ie"]), how="left", on=["repo", "path"])
    merged = merged.merge(labels, how="left", on=["repo", "path"])
    known = set(labels.repo[labels.cat.notna()]) | set(labels.repo)
    merged["is_ml_repo"] = [r in {d[0] for d in ds} and r in known for r in merged.repo]
    merged = merged[merged["loc"] > 0].copy()
    merged["cat"] = merged["cat"].where(merged["cat"].notna(), "0")
    tall = merged.melt(id_vars=["repo", "path", "cat", "loc", "is_ml_repo"], value_vars=symbols, var_name="symbol").fillna({"value": 0})
    out = tall.groupby([*keys, "symbol"])[["value", "loc"]].sum().reset_index()
    return {tuple(r[k] for k in keys) + ("lint_" + r["symbol"],): (int(r["value"]), int(r["loc"]), r["value"] / r["loc"])
            for _, r in out.iterrows()}


@pytest.fixture(params=[1, 2])
def tables(request, make):
    raw = corpus(request.param)
    lint, loc, labels, ds = raw
    frames = (make(lint, LINT), make(loc, "repo bigint, path string, nonblank_loc bigint, internal_error boolean"),
              make(labels, "repo bigint, path string, cat string"), make(ds, "id bigint"))
    return raw, frames


def as_dict(df, keys):
    return {tuple(r[k] for k in keys) + (r.variable,): (r.value, r.loc, r.normval) for r in df.collect()}


def test_sparse_equals_dense_n2_n3_n4(tables):
    raw, frames = tables
    for keys, plan in ((["repo", "is_ml_repo"], plans.lint_density_by_repo),
                       (["repo", "is_ml_repo", "cat"], plans.lint_density_by_category)):
        want = wide_reference(*raw, keys)
        assert as_dict(plan(*frames, dense=True), keys) == want
        assert as_dict(plan(*frames), keys) == {k: v for k, v in want.items() if v[0] > 0}
        assert as_dict(plan(*frames, dense=True, symbols=["s1"]), keys) == {k: v for k, v in want.items() if k[-1] == "lint_s1"}


def test_clean_files_can_join_the_denominator_n2(make):
    lint = make([(1, "a", "w", "s", "M", False, False), (1, "b", None, None, None, False, False)], LINT)
    loc = make([(1, "a", 10, False), (1, "b", 30, False)], "repo bigint, path string, nonblank_loc bigint, internal_error boolean")
    labels, ds = make([(1, "a", "ml0")], "repo bigint, path string, cat string"), make([(1,)], "id bigint")
    assert plans.lint_density_by_repo(lint, loc, labels, ds).first().normval == 0.1
    full = plans.lint_density_by_repo(lint, loc, labels, ds, include_clean_files=True)
    assert [tuple(r) for r in full.collect()] == [(1, True, "lint_s", 1, 40, 0.025)]


def test_histogram_holds_the_zeros(tables):
    raw, frames = tables
    want = {}
    for (repo, ml, variable), (_, _, x) in wide_reference(*raw, ["repo", "is_ml_repo"]).items():
        cell = want.setdefault((variable, x), [0, 0])
        cell[0 if ml else 1] += 1
    hist = plans.repo_histogram(lint_cells(*frames))
    got = {(r.factor, r.x): [r.a, r.b] for r in hist.collect() if r.a + r.b}
    assert got == want and ("lint_s9", 0.0) in got


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_significance_of_selected_repositories(spark, tables, make, threshold):
    raw, frames = tables
    lint, loc, labels, ds = frames
    chosen_ds, chosen_other = make([(r,) for r in (1, 2, 3, 4)], "id bigint"), make([(r,) for r in range(9, 20)], "id bigint")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r.factor: r for r in plans.lint_significance(lint, loc, labels, chosen_ds, chosen_other).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    ids = {1, 2, 3, 4} | set(range(9, 20))
    rows = [r for r in raw[0] if r[0] in ids]
    cells = wide_reference(rows, raw[1], raw[2], [(i,) for i in (1, 2, 3, 4)], ["repo", "is_ml_repo"])
    for factor in {k[-1] for k in cells}:
        a = [v[2] for k, v in cells.items() if k[-1] == factor and k[1]]
        b = [v[2] for k, v in cells.items() if k[-1] == factor and not k[1]]
        assert got[factor].meana == pytest.approx(sum(a) / len(a)) and got[factor].meanb == pytest.approx(sum(b) / len(b))
        assert got[factor].medb == pytest.approx(pd.Series(b).median())


def test_by_category_outputs(tables):
    raw, frames = tables
    keys = ["repo", "is_ml_repo", "cat"]
    dense = wide_reference(*raw, keys)
    out = plans.lint_by_category(*frames)
    cats = {}
    for repo, _, cat, _ in dense:
        cats.setdefault(repo, set()).add(cat)
    deep = {r for r, c in cats.items() if {"ml0", "test", "no-ml-dependency"} <= c}
    assert {r.repo for r in out["deep_repos"].collect()} == deep
    frame = pd.DataFrame([(*k, *v) for k, v in dense.items()], columns=[*keys, "variable", "value", "loc", "normval"])
    want = frame[frame.repo.isin(deep)].groupby(["is_ml_repo", "cat"])["loc"].describe()
    got = {(r.is_ml_repo, r.cat): r for r in out["deep_sizes"].collect()}
    assert set(got) == set(want.index)
    for key, w in want.iterrows():
        assert (got[key]["count"], got[key]["mean"], got[key]["std"], got[key]["q25"], got[key]["max"]) == pytest.approx(
            (w["count"], w["mean"], w["std"], w["25%"], w["max"]))
    summary, plain = out["density_summary"].first(), frame["normval"].describe()
    assert (summary["count"], summary["mean"], summary["std"], summary["q75"]) == pytest.approx(
        (plain["count"], plain["mean"], plain["std"], plain["75%"]))
    assert {r.grp for r in out["curves_nonds"].collect()} <= {"ml0", "no-ml-dependency", "test"}


def test_wide_export_and_melt(tables, make):
    raw, (lint, loc, labels, ds) = tables
    cc = make([(1, "1/0", "function", 4)], "repo bigint, path string, type string, complexity int")
    wide = reshape.feature_table(lint, loc, labels, cc, ds)
    assert {"lint_s1", "lint_s2", "lint_s3", "lint_s9", "loc", "cat", "complexity", "frac_ml", "is_ml_repo"} <= set(wide.columns)
    clean = [r for r in raw[0] if not r[5] and not r[6] and r[2] != "fatal" and r[3]]
    assert wide.count() == len({r[:2] for r in clean})
    melted = reshape.melt_features(wide)
    assert melted.filter("variable like 'lint%'").agg({"value": "sum"}).first()[0] == len(clean)


# --- selection -------------------------------------------------------------

def utc(*ymd):
    return dt.datetime(*ymd, tzinfo=dt.timezone.utc)


@pytest.fixture
def repos(make):
    day = 86400
    meta = make([(i, f"r{i}", utc(2017, 1, 1), utc(2018, 1, 1)) for i in range(1, 9)]
                + [(20, "old", utc(2015, 12, 31), utc(2018, 1, 1)), (21, "odd", utc(2017, 1, 1), utc(2016, 6, 1)),
                   (22, "edge", utc(2016, 1, 1), utc(2016, 1, 1)), (23, "long", utc(2017, 1, 1), utc(2018, 1, 1)),
                   (24, "back", utc(2017, 1, 1), utc(2018, 1, 1)), (25, "zip", utc(2017, 1, 1), utc(2018, 1, 1))],
                "id bigint, name string, created_at timestamp, pushed_at timestamp")
    spans = {i: (0, 100 * day) for i in range(1, 9)} | {20: (0, day), 21: (0, day), 22: (5, 5), 23: (0, 1500 * day),
                                                        24: (10, 0), 25: (None, None)}
    git = make([(k, *v) for k, v in spans.items()], "repo bigint, first_committed_date bigint, last_committed_date bigint")
    ver = make([(i, "only3", i != 2) for i in spans if i != 4], "repo bigint, summary string, select boolean")
    loc = make([(1, "a", 5), (1, "b", None)], "repo bigint, path string, nonblank_loc bigint")
    cc = make([(1, "a", "method", 3)], "repo bigint, path string, type string, complexity int")
    return meta, git, ver, loc, cc


def test_select_ds(repos):
    got = {r.id: r for r in plans.select_ds(*repos, blacklist=(3,)).collect()}
    # 2 is not usable, 3 is blacklisted, 4 has no version; an unknown age stays
    assert set(got) == {1, 5, 6, 7, 8, 20, 21, 22, 23, 24, 25}
    assert (got[1].loc, got[1].complexity, got[1].age) == (5, 3.0, 100.0)
    assert got[5]["loc"] is None and got[25].age is None


def test_select_nonds_drops_all_ds_ids_n8_and_unknown_ages_n5(repos, make):
    # 3 is blacklisted as data science and must not come back on the other side
    got = plans.select_nonds(*repos, make([(3,), (5,)], "id bigint"))
    assert {r.id for r in got.collect()} == {1, 6, 7, 8, 22}


def test_candidates(make, values):
    projects = make([(1, "p", "u", "a web thing", "Python", None), (2, "q", "u", "deep LEARNING", "Python", None),
                     (3, "r", "u", "web", "Ruby", None), (4, "s", "u", "web", "Python", 1), (5, "t", "u", "", "Python", None),
                     (6, "v", "u", "quiet", "Python", None)],
                    "id bigint, name string, url string, description string, language string, forked_from bigint")
    watchers = make([(i, u) for i in (1, 2, 3, 4, 5) for u in range(80)] + [(6, u) for u in range(79)], "repo_id bigint, user_id bigint")
    assert values(plans.candidate_repos(projects, watchers), "id", "stars") == [(1, 80)]


def test_extraction_lists(make):
    ds = make([(1, utc(2010, 1, 1)), (2, utc(2012, 1, 1))], "id bigint, created_at timestamp")
    other = make([(2, utc(2016, 1, 1)), (3, utc(2015, 7, 1)), (4, utc(2015, 6, 30))], "id bigint, created_at timestamp")
    out = plans.extraction_lists(ds, other, size=1)
    assert {(r.id, r.label) for r in out["ds"].collect()} == {(2, "000001-000001"), (1, "000002-000002")}
    assert {(r.id, r.label) for r in out["nonds"].collect()} == {(2, "000001-000001"), (3, "000002-000002")}
    assert [r.id for r in out["duplicates"].collect()] == [2]


def test_versions_are_tabulated_per_group_n17(make, values):
    ver = make([(1, "a", "python3"), (1, "b", "python2"), (2, "a", "either")], "repo bigint, path string, ver string")
    out = plans.version_analysis(ver)
    assert values(out["by_summary"]) == [("either", 1), ("mix", 1)]
    assert values(out["by_select"]) == [(True, 2)]


def test_import_analysis(make, values):
    imports = make([(1, "1/a", "m", "numpy.x", False), (1, "1/b", "m", None, True), (2, "2/a", "m", "pandas", False)],
                   "repo bigint, path string, module_name string, import_name string, parse_error boolean")
    out = plans.import_analysis(imports)
    assert values(out["popular_libraries"]) == [("numpy", 1), ("pandas", 1)]
    assert values(out["label_counts"]) == [("ml0", 2), ("no-ml-dependency", 1)]
    assert values(out["cardinality"]) == [("import_name", 2), ("module_name", 1), ("path", 3), ("repo", 2)]


def test_compare_distributions(make):
    rng = random.Random(4)
    schema = "language string, stars bigint, age double"
    ds = [(rng.choice(["Python", None]), rng.choice([None, rng.randint(0, 50)]), rng.random() * 9) for _ in range(60)]
    other = [("Python", rng.randint(0, 90), rng.choice([None, rng.random() * 9])) for _ in range(80)]
    out = plans.compare_distributions(make(ds, schema), make(other, schema), log_dims=("stars",), linear_dims=("age",))
    n = {(r.dim, r.grp): r["count"] for r in out["summary"]().collect()}
    assert n[("stars", "DS")] == sum(r[1] is not None for r in ds) and n[("age", "non-DS")] == sum(r[2] is not None for r in other)
    a, b = [r[1] for r in ds if r[1] is not None], [r[1] for r in other]
    d = max(abs(sum(v <= p for v in a) / len(a) - sum(v <= p for v in b) / len(b)) for p in set(a + b))
    assert {r.factor: r.ks_stat for r in out["tests"]().collect()}["stars"] == pytest.approx(d)
    assert out["curves_log"]().count() == 2 * 999 and out["curves_linear"]().count() == 2 * 999
    share = {r.language: r.share for r in out["languages_ds"]().collect()}
    assert share == {"Python": pytest.approx(sum(r[0] is not None for r in ds) / 60)}
