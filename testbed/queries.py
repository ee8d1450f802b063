"""One query per operator, each over whole test tables.

Doubles are rounded to six places so that two engines can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repometrics import plans, schemas, sources
from repometrics.constants import CATEGORIES
from repometrics.functions import days_between
from repometrics.functions import import_short_name as short_name
from repometrics.operators import (
    aggregates as agg,
    curves,
    filters,
    joins,
    ordering,
    reports,
    reshape,
    sets,
    stats,
    textlint,
)
from repometrics.session import scratch_path, settle
from testbed.bindings import DS_SEGMENT, LIBS, SYMBOLS, TERMS, TESTS, Tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a builder under its own name."""
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, probabilities to six digits."""
    return df.select(*[
        F.col(f"`{n}`") if t != "double" else _digits(n) if "_pval" in n else r6(f"`{n}`").alias(n) for n, t in df.dtypes])


def _digits(name: str) -> Column:
    """The decimal logarithm of a probability: small ones keep six digits."""
    return F.when(F.col(name) > 1e-300, F.round(F.log10(name), 6)).alias(name)


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


# --- imports ---------------------------------------------------------------

@query
def popular_imports(t):
    return agg.popular_imports(t.imports(), " ")


@query
def library_sets(t):
    rows = agg.library_sets(t.imports(), LIBS, " ")
    return rows.select("repo", F.array_join("importset", ",").alias("importset"))


@query
def library_set_popularity(t):
    rows = agg.library_set_popularity(agg.library_sets(t.imports(), LIBS, " "))
    return rows.select(F.array_join("importset", ",").alias("importset"), "num_repos")


@query
def popular_libraries(t):
    return plans.import_analysis(t.imports(), LIBS, TESTS, " ")["popular_libraries"]


@query
def column_cardinality(t):
    return agg.column_cardinality(t.imports(), ["repo", "path", "module_name", "import_name"])


@query
def cardinality_sketches(t):
    """Sketches per supplier nation, stored, merged; the error bound is four standard errors."""
    rows = t.raw("lineitem").withColumn("chunk", F.col("l_suppkey") % 10)
    columns = ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_extendedprice"]
    path = scratch_path(t.spark, f"sketches-{uuid.uuid4().hex}")
    sources.write_table(agg.cardinality_sketches(rows, columns, ["chunk"], precision=14), path)
    found = agg.sketched_cardinality(sources.read_intermediate(t.spark, path))
    exact = agg.column_cardinality(rows, columns).withColumnRenamed("distinct_values", "exact")
    within = F.abs(F.col("distinct_values") - F.col("exact")) <= 4 * 0.83 / 128 * F.col("exact")
    return found.join(exact, "column").select("column", "known", "exact", within.alias("within"))


@query
def category_labels(t):
    return agg.label_files(t.imports(), LIBS, TESTS, " ")


@query
def label_counts(t):
    return plans.import_analysis(t.imports(), LIBS, TESTS, " ")["label_counts"]


@query
def test_name_match(t):
    return agg.dedupe_labels(filters.test_name_match(t.imports(), "ring"), ["path"])


@query
def library_in_list(t):
    rows = t.imports().withColumn("import_short_name", short_name("import_name", " "))
    return agg.dedupe_labels(filters.library_in_list(rows, LIBS), ["repo", "path", "import_short_name"])


@query
def import_short_name(t):
    rows = t.imports().select("repo", short_name("import_name", " ").alias("import_short_name"))
    return rows.groupBy("repo", "import_short_name").agg(F.count(F.lit(1)).alias("n"))


@query
def import_analysis(t):
    rows = plans.import_analysis(t.imports(), LIBS, TESTS, " ")["library_sets"]
    return rows.select("repo", F.array_join("importset", ",").alias("importset"))


@query
def dedupe_labels(t):
    return agg.dedupe_labels(t.imports())


# --- versions --------------------------------------------------------------

@query
def py_version_label(t):
    return t.versions()


@query
def count_by_repo_version(t):
    return agg.count_by_repo_version(t.versions())


@query
def version_pivot(t):
    return agg.version_pivot(t.versions())


@query
def version_summary(t):
    return t.version_tab()


@query
def version_summary_counts(t):
    return agg.version_summary_counts(t.version_tab(), "summary")


@query
def version_select(t):
    return plans.version_analysis(t.versions())["by_select"]


@query
def version_analysis(t):
    return plans.version_analysis(t.versions())["by_summary"]


# --- filters, joins, sets --------------------------------------------------

@query
def restrict_to_repos(t):
    return filters.restrict_to_repos(t.loc(), t.ds_ids())


@query
def exclude_repos(t):
    return filters.exclude_repos(t.loc(), t.ds_ids())


@query
def membership_flag(t):
    return joins.membership_flag(t.labels(), t.ds_ids(), name="is_ml_repo")


@query
def merge_result_chunks(t):
    # The first group is also present in the second table and must not be doubled.
    loc = t.loc()
    return sets.merge_result_chunks(filters.restrict_to_repos(loc, t.ds_ids()), loc, t.ds_ids())


@query
def merged_metrics(t):
    # all tables and rows; the first group is in both inputs and must not be doubled
    ds = t.ds_ids()
    tables = {name: getattr(t, name)() for name in ("loc", "versions", "labels", "cc", "lint", "imports")}
    merged = plans.merged_metrics({n: filters.restrict_to_repos(d, ds) for n, d in tables.items()}, tables, ds)
    shown = [
        d.select(
            F.lit(n).alias("metric"), "repo", "path",
            F.concat_ws("|", *[F.col(c).cast("string") for c in tables[n].columns if c not in ("repo", "path") and (n, c) != ("imports", "parse_error")]).alias("fields"),
        )
        for n, d in merged.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), shown)


def _active(t):
    return t.raw("orders").filter(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("id"))


@query
def semi_by_ids(t):
    return joins.semi_by_ids(t.labels(), _active(t))


@query
def anti_by_ids(t):
    return joins.anti_by_ids(t.labels(), _active(t))


@query
def three_way_intersection(t):
    cats = [t.labels().filter(F.col("cat") == c).select(F.col("repo").alias("id")) for c in CATEGORIES]
    return sets.id_intersection(*cats)


@query
def id_union(t):
    return sets.id_union(t.ds_ids(), _active(t))


@query
def id_intersection(t):
    return sets.id_intersection(t.ds_ids(), _active(t))


@query
def set_sizes(t):
    return sets.set_sizes(_active(t), t.ds_ids())


@query
def created_since(t):
    return filters.created_since(t.meta(), "1995-06-01T00:00:00Z").select("id", day("created_at"))


@query
def drop_push_before_create(t):
    rows = filters.drop_push_before_create(t.meta())
    return rows.select("id", day("created_at"), day("pushed_at"))


@query
def age_between(t):
    rows = filters.age_between(filters.repo_age_days(t.git()), 0, 2000)
    return rows.select("repo", r6("age").alias("age"))


@query
def repo_age_days(t):
    return filters.repo_age_days(t.git()).select("repo", "git_error", r6("age").alias("age"))


@query
def days_between_dates(t):
    return t.meta().select("id", r6(days_between("created_at", "pushed_at")).alias("days"))


@query
def project(t):
    return t.lint().select("repo", "path", "symbol", "message_id")


@query
def derive_rename(t):
    return t.loc().withColumn("loc", F.col("nonblank_loc")).withColumnRenamed("path", "file")


@query
def keep_selected(t):
    return filters.keep_selected(t.version_tab()).select("repo", "summary")


@query
def clean_lint_rows(t):
    return filters.clean_lint_rows(t.lint())


@query
def syntax_error_files(t):
    rows = filters.syntax_error_files(t.lint())
    return rows.groupBy("repo", "parse_error").agg(F.count(F.lit(1)).alias("n"))


@query
def function_blocks(t):
    return filters.function_blocks(t.cc())


@query
def nonempty_files(t):
    return filters.nonempty_files(t.loc().withColumnRenamed("nonblank_loc", "loc"))


@query
def keyword_exclusion(t):
    return filters.keyword_exclusion(t.projects(), "description", TERMS).select("id", "language")


@query
def keyword_exclusion_default_terms(t):
    return filters.keyword_exclusion(t.projects()).select("id", "language")


@query
def base_repo_predicate(t):
    return filters.base_repo_predicate(t.projects(), "en").select("id", "name")


@query
def star_join(t):
    return joins.star_join(t.projects().select("id", "name"), t.watchers())


@query
def starred_repos(t):
    joined = joins.star_join(t.projects(), t.watchers())
    return agg.starred_repos(joined, 60).select("id", "name", "language", "stars")


@query
def candidate_repos(t):
    rows = plans.candidate_repos(t.projects(), t.watchers(), TERMS, 60, "en")
    return rows.select("id", "name", "url", F.length("description").alias("description_length"), "stars")


@query
def quality_probes(t):
    checks = {
        "parse_error": F.col("parse_error"),
        "internal_error": F.col("internal_error"),
        "error_with_message": F.col("internal_error") & F.col("type").isNotNull(),
        "fatal": F.col("type") == "fatal",
        "no_message": F.col("symbol").isNull(),
    }
    return filters.quality_probes(t.lint(), checks)


@query
def repo_probes(t):
    rows = joins.enrich_repos(
        t.meta(), filters.repo_age_days(t.git()), t.version_tab(),
        agg.loc_by_repo(t.loc()), agg.mean_complexity_by_repo(t.cc()),
    )
    return filters.quality_probes(rows, filters.repo_probes())


@query
def error_probes(t):
    rows = t.loc().withColumn("path", F.concat(F.when(F.col("repo") % 3 == 0, "a/env3/").otherwise("src/"), "path"))
    return filters.quality_probes(rows, filters.error_probes())


@query
def fill_missing(t):
    return filters.fill_missing(t.loc(), 0, ["nonblank_loc"])


@query
def commit_span(t):
    return t.git()


REPO_COLUMNS = (
    "id", "name", "stars", "size", "language", "forks_count", "open_issues_count", "watch", "number_of_contributors",
    "age", "summary", "loc", "complexity",
)


@query
def enrich_repos(t):
    rows = joins.enrich_repos(
        t.meta(), filters.repo_age_days(t.git()), t.version_tab(),
        agg.loc_by_repo(t.loc()), agg.mean_complexity_by_repo(t.cc()),
    )
    return rounded(rows.select(*REPO_COLUMNS, "select"))


@query
def select_ds(t):
    rows = plans.select_ds(t.ds_meta(), t.git(), t.version_tab(), t.loc(), t.cc(), blacklist=(31,))
    return rounded(rows.select(*REPO_COLUMNS))


def _nonds(t):
    # all repositories are offered, so those of the first group must be taken out
    return plans.select_nonds(
        t.meta(), t.git(), t.version_tab(), t.loc(), t.cc(), t.ds_ids(),
        since="1995-03-01T00:00:00Z", max_age=2200,
    )


@query
def select_nonds(t):
    return rounded(_nonds(t).select(*REPO_COLUMNS))


# --- size, complexity, labels ----------------------------------------------

@query
def loc_by_repo(t):
    return agg.loc_by_repo(t.loc())


@query
def mean_complexity_by_repo(t):
    return rounded(agg.mean_complexity_by_repo(t.cc()))


@query
def mean_complexity_by_file(t):
    return rounded(agg.mean_complexity_by_file(t.cc()))


@query
def repo_label_profile(t):
    return rounded(agg.repo_label_profile(t.labels()))


@query
def repos_with_all_categories(t):
    return agg.repos_with_all_categories(t.labels())


@query
def value_counts(t):
    return agg.value_counts(t.loc(), "nonblank_loc", with_null=True)


@query
def value_share(t):
    return rounded(agg.value_share(t.repo_json(), "language"))


@query
def describe_numeric(t):
    return rounded(agg.describe_numeric(t.loc(), "nonblank_loc"))


@query
def describe_grouped(t):
    sized = t.labels().join(t.loc(), ["repo", "path"])
    return rounded(agg.describe_grouped(sized, "nonblank_loc", ["cat"]))


@query
def describe_time(t):
    rows = agg.describe_time(t.meta(), "updated_at")
    return rows.select("count", day("min"), day("max"))


# --- ordering --------------------------------------------------------------

@query
def recent_first(t):
    return ordering.recent_first(t.meta()).select("id", day("created_at"))


@query
def chunk_list(t):
    rows = ordering.chunk_list(t.meta(), size=40)
    return rows.select("id", "row_number", "chunk", "label")


@query
def slice_rows(t):
    return ordering.slice_rows(t.meta(), 40, 110, [F.desc("created_at"), F.asc("id")]).select("id", "row_number")


@query
def extraction_lists(t):
    lists = plans.extraction_lists(t.ds_meta(), t.meta(), since="1995-03-01T00:00:00Z", size=100)
    parts = [lists[g].select(F.lit(g).alias("grp"), "id", "label") for g in ("ds", "nonds")]
    both = lists["duplicates"].select(F.lit("duplicates").alias("grp"), "id", F.lit(None).cast("string").alias("label"))
    return parts[0].unionByName(parts[1]).unionByName(both)


@query
def sorted_distinct(t):
    return ordering.sorted_distinct(t.lint(), "message_id")


@query
def sorted_distinct_repos(t):
    return ordering.sorted_distinct(agg.repos_with_all_categories(t.labels()), "repo", per_row=50)


@query
def most_significant_first(t):
    rows = stats.significance_table(_repo_hist(t))
    return rows.select("factor", _digits("u_pval"))


@query
def popular_first(t):
    counts = t.imports().groupBy("module_name").agg(F.count(F.lit(1)).alias("n"))
    return ordering.popular_first(counts, "n", "module_name")


# --- text ------------------------------------------------------------------

@query
def nonblank_loc(t):
    return reports.nonblank_loc(t.source())


@query
def text_lint_rules(t):
    rows = textlint.text_lint_rules(t.source())
    return rows.select("repo", "path", "line", "symbol", "message_id", "message")


@query
def text_lint_rules_pages(t):
    rows = textlint.text_lint_rules(t.pages(), max_line=80, max_lines=2)
    return rows.select("repo", "line", "symbol", "message_id")


@query
def text_lint_strings(t):
    """Tags count in comments, not in strings."""
    rows = textlint.text_lint_rules(t.quoted_source()).filter("symbol = 'fixme'")
    return rows.select("repo", "path", "line", "message")


@query
def text_lint_counts(t):
    rows = reshape.lint_counts(textlint.text_lint_rules(t.source()))
    return rows.groupBy("symbol").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("files"))


# --- reports ---------------------------------------------------------------

@query
def lint_report_rows(t):
    return reports.lint_report_rows(t.lint_reports())


@query
def cc_report_rows(t):
    return reports.cc_report_rows(t.block_reports())


@query
def raw_report_rows(t):
    return reports.raw_report_rows(t.counter_reports())


@query
def import_listing_rows(t):
    return reports.import_listing_rows(t.import_listings())


@query
def diff_line_counts(t):
    return reports.diff_line_counts(t.diff_reports())


@query
def line_count_rows(t):
    return reports.line_count_rows(t.count_reports())


@query
def fetch_outcome(t):
    return reports.fetch_outcome(t.responses()).select("id", "outcome")


@query
def repo_meta_flatten(t):
    rows = t.repo_json().select(
        F.from_json(F.to_json(F.struct("*")), schemas.REPO_JSON).alias("doc")
    ).select("doc.*")
    flat = reports.repo_meta_flatten(rows)
    return flat.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("created_at", "updated_at", "pushed_at")})


@query
def repo_meta_full(t):
    rows = t.repo_json().select(
        F.from_json(F.to_json(F.struct("*")), schemas.REPO_JSON).alias("doc")
    ).select("doc.*")
    full = reports.repo_meta_full(rows, t.contributors())
    return full.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("created_at", "updated_at", "pushed_at")})


@query
def contributor_count(t):
    return reports.contributor_count(t.contributors())


# --- sources and sinks -----------------------------------------------------

@query
def read_metric_csv(t):
    path = scratch_path(t.spark, "lint")
    sources.write_table(reports.lint_report_rows(t.lint_reports()), path, fmt="csv")
    return sources.read_metric_csv(t.spark, path, "lint_messages")


@query
def read_id_list(t):
    path = scratch_path(t.spark, "ids")
    sources.write_table(t.ds_ids(), path, fmt="csv")
    return sources.read_id_list(t.spark, path)


@query
def read_repo_json(t):
    path = scratch_path(t.spark, "json")
    sources.write_table(t.repo_json(), path, fmt="json")
    rows = sources.read_repo_json(t.spark, path, multi_line=False)
    flat = reports.repo_meta_flatten(rows)
    return flat.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("created_at", "updated_at", "pushed_at")})


@query
def read_repo_meta(t):
    path = scratch_path(t.spark, "meta")
    columns = [c.strip().split(" ")[0] for c in schemas.REPO_META.split(",")]
    meta = t.meta().withColumns({
        "full_name": F.col("name"), "url": F.lit(None).cast("string"), "html_url": F.lit("h"),
        "description": F.concat(F.lit('a "b", c\n'), F.col("name")),
    })
    sources.write_table(meta.select(*columns), path, fmt="csv")
    rows = sources.read_repo_meta(t.spark, path)
    return rows.withColumns({c: day(c) for c in ("created_at", "updated_at", "pushed_at")})


@query
def read_result_chunks(t):
    root = scratch_path(t.spark, "chunks")
    for chunk, how in (("ds-1", filters.restrict_to_repos), ("nonds-1", filters.exclude_repos)):
        sources.write_table(how(t.loc(), t.ds_ids()), f"{root}/{chunk}/loc.csv", fmt="csv")
    return sources.read_result_chunks(t.spark, [f"{root}/ds-1", f"{root}/nonds-1"], "loc.csv", "file_loc")


@query
def append_rows(t):
    path = scratch_path(t.spark, "append")
    sources.write_table(t.ds_ids(), path, fmt="csv")
    sources.append_rows(t.nonds_ids(), path)
    return sources.read_id_list(t.spark, path)


@query
def append_run(t):
    """A run that is started twice leaves its rows once."""
    path = scratch_path(t.spark, f"runs-{uuid.uuid4().hex}")
    for run, rows in (("ds", t.ds_ids()), ("nonds", t.nonds_ids()), ("ds", t.ds_ids())):
        sources.append_run(rows, path, run)
    return t.spark.read.parquet(path).select("run", "id")


@query
def write_with_probes(t):
    checks = {"parse_error": F.col("parse_error"), "fatal": F.col("type") == "fatal", "no_message": F.col("symbol").isNull(), "rows read back": F.lit(True)}
    path = scratch_path(t.spark, f"probed-{uuid.uuid4().hex}")
    probes = sources.write_with_probes(t.lint(), path, checks)
    again = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
    return probes.join(again, F.col("probe") == "rows read back", "left").select("probe", "hits", "total", "n")


@query
def enrich_files_bucketed(t):
    """``enrich_files`` over tables dealt by (repo, path)."""
    name = f"b{uuid.uuid4().hex}"
    tables = (filters.clean_lint_rows(t.lint()), t.loc(), t.labels(), t.cc())
    buckets = sources.bucket_count(tables, least=8)
    sides = [
        sources.write_bucketed(side, f"{name}_{k}", scratch_path(t.spark, f"{name}-{k}"), buckets=buckets)
        for k, side in enumerate(tables)
    ]
    wide = reshape.lint_pivot(sides[0], SYMBOLS)
    rows = joins.enrich_files(wide, sides[1], sides[2], agg.mean_complexity_by_file(sides[3]))
    return rounded(rows.select("repo", "path", "lint_AF", "loc", "cat", "complexity"))


@query
def scan_source_files(t):
    root, _ = t.source_tree()
    rows = sources.scan_source_files(t.spark, root, manifest=sources.list_source_files(t.spark, root), batch_bytes=300_000)
    return rows.select("repo", "path", F.length("content").alias("n_chars"), F.md5("content").alias("md5"))


@query
def scan_source_files_of_repos(t):
    """Paths as the tree was written, repositories by id; other files are not opened."""
    root, paths = t.source_tree()
    ids = t.raw("nation").select(F.col("n_nationkey").alias("id")).filter("id % 3 = 0")
    rows = sources.scan_source_files(t.spark, root, ids, manifest=paths)
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("n_chars"), F.count_if(F.col("content") == "").alias("empty"))


@query
def list_source_files(t):
    root, _ = t.source_tree()
    ids = t.raw("nation").select(F.col("n_nationkey").alias("id")).filter("id % 3 = 0")
    return sources.list_source_files(t.spark, root, ids)


@query
def write_by_outcome(t):
    path = scratch_path(t.spark, "outcome")
    sources.write_by_outcome(reports.fetch_outcome(t.responses()), path)
    rows = t.spark.read.schema("id bigint, name string, message string, outcome string").json(path)
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"))


@query
def write_chunks(t):
    path = scratch_path(t.spark, "labels-by-chunk")
    sources.write_chunks(ordering.chunk_list(t.meta(), size=40).select("id", "label"), path)
    return t.spark.read.schema("id bigint, label string").option("header", "true").csv(path)


@query
def read_intermediate(t):
    path = scratch_path(t.spark, "labels")
    sources.write_table(t.labels(), path)
    return agg.value_counts(sources.read_intermediate(t.spark, path), "cat")


@query
def write_table(t):
    path = scratch_path(t.spark, "versions")
    sources.write_table(t.version_tab(), path, fmt="json")
    rows = t.spark.read.schema("repo bigint, either bigint, python3 bigint, summary string, select boolean").json(path)
    return rows.select("repo", "either", "python3", "summary", "select")


@query
def scan_warehouse(t):
    t.watchers().createOrReplaceTempView("watchers")
    rows = sources.scan_warehouse(t.spark, "watchers")
    return rows.groupBy("repo_id").agg(F.count("user_id").alias("stars"))


# --- lint per line ---------------------------------------------------------

@query
def lint_counts(t):
    return reshape.lint_counts(filters.clean_lint_rows(t.lint()))


@query
def lint_pivot(t):
    return reshape.lint_pivot(filters.clean_lint_rows(t.lint()), SYMBOLS)


@query
def enrich_files(t):
    wide = reshape.lint_pivot(filters.clean_lint_rows(t.lint()), SYMBOLS)
    rows = joins.enrich_files(wide, t.loc(), t.labels(), agg.mean_complexity_by_file(t.cc()))
    return rounded(rows.select("repo", "path", "lint_AF", "loc", "cat", "complexity"))


@query
def attach_repo_profile(t):
    return rounded(joins.attach_repo_profile(t.loc(), agg.repo_label_profile(t.labels())))


@query
def feature_table(t):
    return rounded(reshape.feature_table(t.lint(), t.loc(), t.labels(), t.cc(), t.ds_ids(), SYMBOLS))


def _as_text(features):
    return F.array_join(F.transform(F.map_entries(features), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@query
def lint_features(t):
    rows = reshape.lint_features(filters.clean_lint_rows(t.lint()))
    return rows.select("repo", "path", _as_text("lint").alias("lint"))


@query
def widen_features(t):
    return reshape.widen_features(reshape.lint_features(filters.clean_lint_rows(t.lint())), SYMBOLS)


@query
def feature_index(t):
    return reshape.feature_index(reshape.lint_features(filters.clean_lint_rows(t.lint())))


@query
def feature_arrays(t):
    rows = settle(reshape.lint_features(filters.clean_lint_rows(t.lint())))
    arrays = reshape.feature_arrays(rows, reshape.feature_index(rows))
    return arrays.select("repo", "path", F.array_join("indices", ",").alias("indices"), F.array_join(F.transform("values", lambda v: v.cast("int")), ",").alias("values"))


@query
def sparse_feature_table(t):
    sparse = reshape.sparse_feature_table(t.lint(), t.loc(), t.labels(), t.cc(), t.ds_ids())
    return rounded(reshape.widen_features(sparse, SYMBOLS))


@query
def melt_features(t):
    wide = reshape.feature_table(t.lint(), t.loc(), t.labels(), t.cc(), t.ds_ids(), SYMBOLS)
    return rounded(reshape.melt_features(wide))


@query
def variable_prefix(t):
    wide = reshape.feature_table(t.lint(), t.loc(), t.labels(), t.cc(), t.ds_ids(), SYMBOLS)
    rows = filters.cast_value(filters.variable_prefix(reshape.melt_features(wide)))
    return rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query
def cast_value(t):
    counts = reshape.lint_counts(t.lint()).withColumnRenamed("n", "value")
    return filters.cast_value(counts)


def _lint_inputs(t):
    return t.lint(), t.loc(), t.labels(), t.ds_ids()


@query
def lint_density_by_repo(t):
    return rounded(plans.lint_density_by_repo(*_lint_inputs(t)))


@query
def lint_density_by_repo_dense(t):
    return rounded(plans.lint_density_by_repo(*_lint_inputs(t), dense=True))


@query
def lint_density_with_clean_files(t):
    return rounded(plans.lint_density_by_repo(*_lint_inputs(t), include_clean_files=True))


@query
def lint_density_by_category(t):
    return rounded(plans.lint_density_by_category(*_lint_inputs(t)))


@query
def lint_density_by_category_dense(t):
    return rounded(plans.lint_density_by_category(*_lint_inputs(t), dense=True, symbols=SYMBOLS))


def _repo_hist(t):
    return plans.repo_histogram(plans.lint.lint_cells(*_lint_inputs(t)))


# --- two-sample statistics -------------------------------------------------

def _measures(t):
    """Price and quantity of line items, returned items against the others."""
    rows = t.raw("lineitem").select(
        (F.col("l_returnflag") == "R").alias("in_a"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("price"),
    ).unpivot(["in_a"], ["quantity", "discount", "price"], "factor", "x")
    return stats.two_group_histogram(rows, "factor", "x", F.col("in_a"))


@query
def average_rank(t):
    return rounded(stats.average_rank(_measures(t)))


@query
def ecdf(t):
    return rounded(stats.ecdf(_measures(t)))


@query
def two_group_summary(t):
    return rounded(stats.two_group_summary(_measures(t)))


@query
def ks_two_sample(t):
    return rounded(stats.ks_two_sample(_measures(t)))


@query
def anova_f(t):
    return rounded(stats.anova_f(_measures(t)))


@query
def kruskal_h(t):
    return rounded(stats.kruskal_h(_measures(t)))


@query
def mann_whitney_u(t):
    return rounded(stats.mann_whitney_u(_measures(t)))


def _small_groups(t):
    """Prices of a customer's orders, finished ones against the others: groups of a few, hardly any ties."""
    rows = t.raw("orders").select(F.col("o_custkey").alias("factor"), F.col("o_totalprice").alias("x"), (F.col("o_orderstatus") == "F").alias("in_a"))
    return stats.two_group_histogram(rows, "factor", "x", F.col("in_a"))


@query
def mann_whitney_u_exact(t):
    rows = stats.mann_whitney_u(_small_groups(t), exact_up_to=40).filter("u_stat IS NOT NULL")
    return rows.select("factor", "u_stat", *[_digits(c) for c in ("u_pval", "u_pval_less", "u_pval_greater")])


@query
def ks_two_sample_exact(t):
    rows = stats.ks_two_sample(_small_groups(t), exact_pairs=10_000).filter("n_a > 0 AND n_b > 0")
    return rows.select("factor", "n_a", "n_b", r6("ks_stat").alias("ks_stat"), _digits("ks_pval"))


@query
def significance_table(t):
    return rounded(stats.significance_table(_repo_hist(t)))


@query
def lint_significance(t):
    ds = plans.select_ds(t.ds_meta(), t.git(), t.version_tab(), t.loc(), t.cc()).select("id")
    return rounded(plans.lint_significance(t.lint(), t.loc(), t.labels(), ds, _nonds(t).select("id")))


# --- curves and comparisons ------------------------------------------------

def _grouped_meta(t):
    return t.meta().withColumn("grp", F.when(F.col("language") == DS_SEGMENT, "DS").otherwise("non-DS"))


@query
def survival_curve_log(t):
    return rounded(curves.survival_curve_log(_grouped_meta(t), "stars", "grp"))


@query
def survival_curve_linear(t):
    return rounded(curves.survival_curve_linear(_grouped_meta(t), "number_of_contributors", "grp"))


@query
def survival_curve_clipped(t):
    return rounded(curves.survival_curve_clipped(_repo_hist(t), cap=0.0002))


@query
def survival_curve_by_category(t):
    cells = plans.lint.lint_cells(*_lint_inputs(t), by_category=True)
    return rounded(curves.survival_curve_by_category(plans.category_histogram(cells, False), cap=0.0005))


def _comparison(t):
    # the selected repositories of both groups, all nine measures
    ds = plans.select_ds(t.ds_meta(), t.git(), t.version_tab(), t.loc(), t.cc(), blacklist=(31,))
    return plans.compare_distributions(ds, _nonds(t))


@query
def compare_distributions_tests(t):
    return rounded(_comparison(t)["tests"]())


@query
def compare_distributions(t):
    return rounded(_comparison(t)["languages_nonds"]())


@query
def compare_distributions_summary(t):
    return rounded(_comparison(t)["summary"]())


@query
def compare_distributions_curves(t):
    return rounded(_comparison(t)["curves_log"]())


@query
def compare_distributions_curves_linear(t):
    return rounded(_comparison(t)["curves_linear"]())


@query
def compare_distributions_languages_ds(t):
    return rounded(_comparison(t)["languages_ds"]())


def _lint_curves(t):
    cells = plans.lint.lint_cells(*_lint_inputs(t))
    return plans.lint_curves(cells, {"lint_AF": 0.0001, "lint_NO": 0.0004, "lint_RF": 1.0})


@query
def lint_curves(t):
    return rounded(_lint_curves(t)["curves"]())


@query
def lint_curve_tests(t):
    return rounded(_lint_curves(t)["tests"]())


def _category_cells(t):
    return settle(plans.lint.lint_cells(*_lint_inputs(t), by_category=True))


@query
def lint_by_category_sizes(t):
    return rounded(plans.lint.deep_sizes(_category_cells(t)))


@query
def lint_by_category_summary(t):
    return rounded(plans.lint.density_summary(_category_cells(t)))


@query
def lint_by_category_repos(t):
    cells = plans.lint.lint_cells(*_lint_inputs(t), by_category=True)
    return plans.lint.deep_cells(cells).select("repo").distinct()


@query
def lint_by_category_curves(t):
    hist = plans.category_histogram(plans.lint.lint_cells(*_lint_inputs(t), by_category=True), True)
    return rounded(curves.survival_curve_by_category(hist, cap=0.0005))


@query
def lint_by_category(t):
    return rounded(plans.lint_by_category(*_lint_inputs(t))["density"])
