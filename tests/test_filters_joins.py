"""Null rules of filters, joins and set operations, with and without hot keys."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from repometrics.operators import aggregates as agg
from repometrics.operators import filters, joins, sets

LINT = "repo bigint, path string, type string, symbol string, message_id string, parse_error boolean, internal_error boolean"


@pytest.fixture
def lint(make):
    return make([
        (1, "a", "convention", "s", "C1", False, False),
        (1, "b", None, None, None, False, False),
        (1, "c", "fatal", "f", "F1", False, False),
        (1, "d", "error", "e", "E0001", True, False),
        (1, "d", "warning", "w", "W1", True, False),
        (2, "e", None, None, None, False, True),
        (2, "f", "warning", "w", "W1", False, True),
    ], LINT)


def test_clean_rows_keep_null_types_n1(lint, values):
    assert values(filters.clean_lint_rows(lint), "path") == [("a",), ("b",)]


def test_syntax_error_flags_all_rows_n11(lint, values):
    rows = filters.syntax_error_files(lint.withColumn("parse_error", F.lit(False)))
    assert {r.path for r in rows.filter("parse_error").collect()} == {"d"}
    assert rows.filter("parse_error").count() == 2 and rows.count() == 7


def test_error_with_message_probe_n14(lint):
    checks = {"both": F.col("internal_error") & F.col("type").isNotNull(), "fatal": F.col("type") == "fatal"}
    got = {r.probe: (r.hits, r.total) for r in filters.quality_probes(lint, checks).collect()}
    assert got == {"both": (1, 7), "fatal": (1, 7)}


def test_age_needs_a_known_value_n5(make, values):
    ages = make([(0.0,), (-0.1,), (1499.9,), (1500.0,), (None,)], "age double")
    assert values(filters.age_between(ages)) == [(0.0,), (1499.9,)]


def test_age_in_days(make):
    git = make([(1, 0, 129600), (2, None, None)], "repo bigint, first_committed_date bigint, last_committed_date bigint")
    assert [r.age for r in filters.repo_age_days(git).orderBy("repo").collect()] == [1.5, None]


def test_creation_threshold_is_inclusive(make):
    utc = dt.timezone.utc
    rows = make([
        (1, dt.datetime(2016, 1, 1, tzinfo=utc), dt.datetime(2015, 1, 1, tzinfo=utc)),
        (2, dt.datetime(2015, 12, 31, 23, 59, tzinfo=utc), dt.datetime(2016, 1, 1, tzinfo=utc)),
        (3, dt.datetime(2017, 1, 1, tzinfo=utc), dt.datetime(2017, 1, 1, tzinfo=utc)),
        (4, dt.datetime(2017, 1, 1, tzinfo=utc), None),
    ], "id bigint, created_at timestamp, pushed_at timestamp")
    assert {r.id for r in filters.created_since(rows).collect()} == {1, 3, 4}
    assert {r.id for r in filters.drop_push_before_create(rows).collect()} == {2, 3}


def test_selected_rows_only(make):
    rows = make([(1, True), (2, False), (3, None)], "id bigint, select boolean")
    assert [r.id for r in filters.keep_selected(rows).collect()] == [1]


def test_word_match_treats_missing_as_no(make, values):
    rows = make([("a/test_x.py", None), ("a/b.py", "unittest"), ("a/c.py", None)], "path string, import_name string")
    assert values(filters.test_name_match(rows), "path") == [("a/b.py",), ("a/test_x.py",)]


def test_keywords_ignore_case_and_missing_text(make):
    rows = make([(1, "Big DATA tool"), (2, "web server"), (3, None), (4, "HTML parser"), (5, "")], "id bigint, description string")
    assert [r.id for r in filters.keyword_exclusion(rows).orderBy("id").collect()] == [2, 5]
    base = rows.withColumns({"forked_from": F.when(F.col("id") == 1, 9), "language": F.lit("Python")})
    assert [r.id for r in filters.base_repo_predicate(base).orderBy("id").collect()] == [2, 4]


def test_small_projections(make, values):
    assert values(filters.name_empty(make([("",), ("x",)], "n string"), "n")) == [("None",), ("x",)]
    assert values(filters.fill_missing(make([(None,), (2,)], "n int"))) == [(0,), (2,)]
    long = make([("lint_a", 1), ("loc", 2)], "variable string, value int")
    assert values(filters.cast_value(filters.variable_prefix(long))) == [("lint_a", 1.0)]
    assert values(filters.nonempty_files(make([(0,), (None,), (3,)], "loc int"))) == [(3,)]


# --- joins: the broadcast way, and the way for a lookup side that is too large

@pytest.fixture(params=["broadcast", "hot keys split"])
def way(request, spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param != "broadcast":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_semi_anti_and_flag(make, values, way):
    rows = make([(1, "a")] * 40 + [(2, "b"), (3, "c"), (4, "d"), (4, "d"), (None, "n")], "repo bigint, path string")
    ids = make([(1,), (3,), (3,), (9,), (None,)], "id bigint")
    assert values(joins.semi_by_ids(rows, ids)) == [(1, "a")] * 40 + [(3, "c")]
    assert values(joins.anti_by_ids(rows, ids)) == [(2, "b"), (4, "d"), (4, "d"), (None, "n")]
    flags = values(joins.membership_flag(rows, ids, name="m"), "repo", "m")
    assert flags == [(1, True)] * 40 + [(2, False), (3, True), (4, False), (4, False), (None, False)]


def test_left_and_inner_lookup(make, values, way):
    rows = make([(1, "a")] * 5 + [(2, "b"), (None, "n")], "repo bigint, path string")
    profile = make([(1, 10), (3, 30)], "repo bigint, total int")
    left = values(joins.attach_repo_profile(rows, profile), "repo", "path", "total")
    assert left == [(1, "a", 10)] * 5 + [(2, "b", None), (None, "n", None)]


def test_half_of_the_rows_on_one_key(make, values, way):
    rows = make([(1, f"p{i}") for i in range(3000)] + [(i, "q") for i in range(2, 3002)], "repo bigint, path string")
    ids = make([(i,) for i in range(1, 3002, 2)], "id bigint")
    assert joins.semi_by_ids(rows, ids).count() == 3000 + 1500
    assert joins.anti_by_ids(rows, ids).count() == 1500
    assert joins.membership_flag(rows, ids, name="m").filter("m").count() == 4500


def test_each_side_is_read_once(spark, tmp_path, make):
    """No forced broadcast, and no second read of a side."""
    make([(1, "a")], "repo bigint, path string").write.parquet(str(tmp_path / "rows"))
    make([(1,)], "id bigint").write.parquet(str(tmp_path / "ids"))
    rows, ids = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "ids"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (joins.semi_by_ids(rows, ids), joins.anti_by_ids(rows, ids), joins.membership_flag(rows, ids)):
            text = joined._jdf.queryExecution().executedPlan().toString()
            assert text.count("FileScan") == 2 and "Broadcast" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)



def test_star_join_counts_before_joining(make, values):
    projects = make([(1, "p"), (2, "q")], "id bigint, name string")
    watchers = make([(1, 5), (1, 6), (1, None), (7, 8), (None, 3)], "repo_id bigint, user_id bigint")
    assert values(joins.star_join(projects, watchers), "id", "stars") == [(1, 2), (2, 0)]


def test_repeated_projects_add_up(make, values):
    joined = make([(1, "p", "u", "d", "Python", 50)] * 2 + [(2, "q", "u", "d", "Python", 79)],
                  "id bigint, name string, url string, description string, language string, stars bigint")
    assert values(agg.starred_repos(joined), "id", "stars") == [(1, 100)]


def test_merge_prefers_the_first_group_n8(make, values):
    ds = make([(1, "x"), (2, "y")], "repo bigint, path string")
    nonds = make([(2, "z"), (3, "w")], "repo bigint, path string")
    merged = sets.merge_result_chunks(ds, nonds, make([(1,), (2,)], "id bigint"))
    assert values(merged) == [(1, "x"), (2, "y"), (3, "w")]


def test_merge_fills_missing_columns(make, values):
    ds = make([(1, "x")], "repo bigint, path string")
    nonds = make([(3, "w", 4)], "repo bigint, path string, extra int")
    assert values(sets.merge_result_chunks(ds, nonds, make([(1,)], "id bigint"))) == [(1, "x", None), (3, "w", 4)]


def test_id_sets(make, values):
    a, b = make([(1,), (1,), (2,)], "id bigint"), make([(2,), (3,)], "id bigint")
    assert values(sets.id_union(a, b)) == [(1,), (2,), (3,)]
    assert values(sets.id_intersection(a, b)) == [(2,)]
    assert values(sets.set_sizes(a, b)) == [(3, 2, 2, 2, 1)]
