"""Aggregations.  Every one combines on the map side before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.functions import import_short_name, version_select, version_summary
from repometrics.operators.filters import function_blocks
from repometrics.operators.ordering import running_totals
from repometrics.session import settle


# --- imports ---------------------------------------------------------------

def popular_imports(imports: DataFrame, sep: str = ".") -> DataFrame:
    """Repositories per imported library, most used first."""
    short = imports.select("repo", import_short_name("import_name", sep).alias("import_short_name"))
    counts = short.groupBy("import_short_name").agg(F.countDistinct("repo").alias("num_repos"))
    return counts.orderBy(F.desc("num_repos"), F.asc("import_short_name"))


def library_sets(imports: DataFrame, libs: Sequence[str] = C.DS_LIBRARIES, sep: str = ".") -> DataFrame:
    """Sorted known libraries per repository; none gives an empty list."""
    short = import_short_name("import_name", sep)
    known = F.when(short.isin(*libs), short)
    return imports.groupBy("repo").agg(F.array_sort(F.collect_set(known)).alias("importset"))


def library_set_popularity(sets: DataFrame) -> DataFrame:
    """Repositories per combination of libraries, most common first."""
    counts = sets.groupBy("importset").agg(F.count("repo").alias("num_repos"))
    return counts.orderBy(F.desc("num_repos"), F.asc("importset"))


def dedupe_labels(df: DataFrame, columns: Sequence[str] = ("repo", "path")) -> DataFrame:
    """Distinct combinations of the columns."""
    return df.select(*columns).distinct()


def label_files(
    imports: DataFrame,
    libs: Sequence[str] = C.DS_LIBRARIES,
    test_frameworks: Sequence[str] = C.TEST_FRAMEWORKS,
    sep: str = ".",
) -> DataFrame:
    """Category per file; a test stays a test whatever else it imports."""
    short = import_short_name("import_name", sep)
    flags = imports.groupBy("repo", "path").agg(
        F.bool_or(short.isin(*libs)).alias("_library"),
        F.bool_or(short.isin(*test_frameworks)).alias("_test"),
    )
    cat = F.when(F.col("_test"), C.CAT_TEST).when(F.col("_library"), C.CAT_LIBRARY).otherwise(C.CAT_NONE)
    return flags.select("repo", "path", cat.alias("cat"))


# --- versions --------------------------------------------------------------

def count_by_repo_version(ver: DataFrame) -> DataFrame:
    """Files per repository and version label."""
    return ver.groupBy("repo", "ver").agg(F.count("path").alias("vercnt"))


def version_pivot(ver: DataFrame, versions: Sequence[str] = C.VERSIONS) -> DataFrame:
    """One row per repository with a file count for each version label."""
    labelled = ver.filter(F.col("ver").isNotNull())
    return labelled.groupBy("repo").agg(
        *[F.count_if((F.col("ver") == v) & F.col("path").isNotNull()).alias(v) for v in versions]
    )


def version_table(ver: DataFrame) -> DataFrame:
    """Version counts with their one-word summary and the selection flag."""
    counts = [F.col(v) for v in C.VERSIONS]
    return version_pivot(ver).withColumns(
        {"summary": version_summary(*counts), "select": version_select(*counts)}
    )


def version_summary_counts(tab: DataFrame, column: str = "summary") -> DataFrame:
    """Repositories per summary word, or per selection flag."""
    return tab.groupBy(column).agg(F.count(F.lit(1)).alias("num_repos"))


# --- size and complexity ---------------------------------------------------

def loc_by_repo(loc: DataFrame) -> DataFrame:
    """Nonblank lines per repository; unreadable files count as nothing."""
    return loc.groupBy("repo").agg(F.coalesce(F.sum("nonblank_loc"), F.lit(0)).alias("loc"))


def mean_complexity_by_repo(cc: DataFrame) -> DataFrame:
    """Mean complexity of functions and methods per repository."""
    return function_blocks(cc).groupBy("repo").agg(F.avg("complexity").alias("complexity"))


def mean_complexity_by_file(cc: DataFrame) -> DataFrame:
    """Mean complexity of functions and methods per file."""
    return function_blocks(cc).groupBy("repo", "path").agg(F.avg("complexity").alias("complexity"))


# --- labels ----------------------------------------------------------------

def repo_label_profile(labels: DataFrame, cats: Sequence[str] = C.CATEGORIES) -> DataFrame:
    """Distinct files per category, their total over all categories and the share that uses a library."""
    files = labels.filter(F.col("cat").isNotNull() & F.col("path").isNotNull())
    counts = (
        files.select("repo", "path", "cat").distinct()
        .groupBy("repo").agg(*[F.count_if(F.col("cat") == c).alias(c) for c in cats], F.count(F.lit(1)).alias("total"))
    )
    return counts.withColumn(
        "frac_ml", F.try_divide(F.col(C.CAT_LIBRARY), F.col("total"))
    )


def repos_with_all_categories(df: DataFrame, cats: Sequence[str] = C.CATEGORIES) -> DataFrame:
    """Repositories that have rows in each category."""
    seen = df.groupBy("repo").agg(*[F.bool_or(F.col("cat") == c).alias(f"_{i}") for i, c in enumerate(cats)])
    for i in range(len(cats)):
        seen = seen.filter(F.col(f"_{i}"))
    return seen.select("repo")


# --- profiles --------------------------------------------------------------

def column_cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct known values per column, one row per column."""
    counts = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "distinct_values")


def cardinality_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), precision: int = 12) -> DataFrame:
    """``by``, ``column``, ``known`` (rows with a value) and a mergeable ``sketch`` of the distinct values.

    All columns are sketched in one pass with one row in the plan for each row read, where exact distinct counts expand
    every row once a column.  Chunks may be sketched on their own and stored; a sketch has 2**``precision`` bytes at most.
    """
    texts = {c: F.col(c).cast("string") for c in columns}
    sketched = df.groupBy(*by).agg(*[
        F.struct(F.count(x).alias("known"), F.hll_sketch_agg(x, precision).alias("sketch")).alias(c) for c, x in texts.items()])
    return sketched.unpivot(list(by), list(columns), "column", "_s").select(*by, "column", "_s.known", "_s.sketch")


def sketched_cardinality(sketches: DataFrame) -> DataFrame:
    """``column, known, distinct_values`` from sketches of any number of chunks.

    The relative standard error is about 0.83 / sqrt(2**precision), 1.3 % by default; small counts are exact.
    """
    merged = sketches.groupBy("column").agg(F.sum("known").alias("known"), F.hll_union_agg("sketch").alias("_all"))
    return merged.select("column", "known", F.hll_sketch_estimate("_all").alias("distinct_values"))


def value_counts(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    """Rows per value."""
    rows = df if with_null else df.filter(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Share of all rows per known value; rows without one stay in the denominator."""
    # one row per value, so the input is read once
    counts = settle(value_counts(df, column, with_null=True))
    rows = counts.agg(F.sum("n")).scalar()
    return counts.filter(F.col(column).isNotNull()).select(column, (F.col("n") / rows).alias("share"))


def describe_grouped(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per known group.

    Equal values are counted first; quartiles are read from running counts, so
    no group has to fit into one task.
    """
    values = df.select(*keys, F.col(column).cast("double").alias("x")).dropna()
    return describe_counted(values.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n")), keys)


def describe_counted(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``describe_grouped`` from rows (keys, x, n)."""
    keys = list(keys)
    ranked = running_totals(counted, keys, ["x"], {"n": F.col("n")}, {"nx": F.col("n") * F.col("x")})
    mean = F.col("total_nx") / F.col("total_n")

    def at(share: float) -> tuple:
        spot = (F.col("total_n") - 1) * F.lit(share)

        def value(rank):
            inside = (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
            return F.max(F.when(inside, F.col("x")))

        return value(F.floor(spot)), value(F.ceil(spot)), F.max(spot - F.floor(spot))

    quarters = {name: at(share) for name, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))}
    summed = ranked.groupBy(*keys).agg(
        F.max("total_n").alias("count"),
        F.max(mean).alias("mean"),
        F.sum(F.col("n") * (F.col("x") - mean) ** 2).alias("_ss"),
        F.min("x").alias("min"),
        *[
            part.alias(f"_{name}_{i}")
            for name, parts in quarters.items()
            for i, part in enumerate(parts)
        ],
        F.max("x").alias("max"),
    )
    return summed.select(
        *keys, "count", "mean",
        F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1))).alias("std"),
        "min",
        *[
            (F.col(f"_{q}_0") + (F.col(f"_{q}_1") - F.col(f"_{q}_0")) * F.col(f"_{q}_2")).alias(q)
            for q in quarters
        ],
        "max",
    )


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """``describe_grouped`` over the whole table."""
    return describe_grouped(df, column, [])


def describe_time(df: DataFrame, column: str) -> DataFrame:
    """Count and extremes of a timestamp column."""
    return df.agg(F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"))


# --- candidates ------------------------------------------------------------

def starred_repos(joined: DataFrame, min_stars: int = C.MIN_STARS) -> DataFrame:
    """Projects with enough watchers, repeated project rows added up."""
    columns = ["id", "name", "url", "description", "language"]
    return joined.groupBy(*columns).agg(F.sum("stars").alias("stars")).filter(F.col("stars") >= min_stars)
