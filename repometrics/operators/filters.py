"""Row filters and small projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.functions import epoch_days
from repometrics.operators.joins import anti_by_ids, semi_by_ids

restrict_to_repos = semi_by_ids
exclude_repos = anti_by_ids


def repo_age_days(git: DataFrame) -> DataFrame:
    """Add ``age``: days between the first and the last commit."""
    span = F.col("last_committed_date") - F.col("first_committed_date")
    return git.withColumn("age", epoch_days(span))


def created_since(df: DataFrame, since: str = C.SELECT_SINCE) -> DataFrame:
    """Rows created at or after a moment."""
    return df.filter(F.col("created_at") >= F.to_timestamp(F.lit(since)))


def drop_push_before_create(df: DataFrame) -> DataFrame:
    """Rows pushed at or after their creation."""
    return df.filter(F.col("pushed_at") >= F.col("created_at"))


def age_between(df: DataFrame, lo: float = 0, hi: float = C.MAX_AGE_DAYS) -> DataFrame:
    """Rows with a known age in [lo, hi)."""
    return df.filter((F.col("age") >= lo) & (F.col("age") < hi))


def keep_selected(df: DataFrame) -> DataFrame:
    """Rows whose version selection is known and true."""
    return df.filter(F.col("select"))


def clean_lint_rows(lint: DataFrame) -> DataFrame:
    """Lint rows of files that were read without errors; rows without a type stay."""
    return lint.filter(
        ~F.col("parse_error") & ~F.col("internal_error") & ~F.col("type").eqNullSafe("fatal")
    )


def syntax_error_files(lint: DataFrame) -> DataFrame:
    """Flag all rows of a file when one of its messages is a syntax error."""
    flagged = (
        lint.filter(F.col("message_id") == C.SYNTAX_ERROR_ID)
        .select("repo", "path").distinct().withColumn("_syntax", F.lit(True))
    )
    joined = lint.join(flagged, ["repo", "path"], "left")
    return joined.withColumn("parse_error", F.coalesce("_syntax", F.lit(False))).drop("_syntax")


def function_blocks(cc: DataFrame, types: Sequence[str] = C.FUNCTION_TYPES) -> DataFrame:
    """Complexity rows of functions and methods."""
    return cc.filter(F.col("type").isin(*types))


def nonempty_files(df: DataFrame) -> DataFrame:
    """Rows of files with at least one nonblank line."""
    return df.filter(F.col("loc") > 0)


def variable_prefix(df: DataFrame, prefix: str = C.LINT_PREFIX) -> DataFrame:
    """Long rows whose variable starts with ``prefix``."""
    return df.filter(F.col("variable").startswith(prefix))


def library_in_list(df: DataFrame, libs: Sequence[str], column: str = "import_short_name") -> DataFrame:
    """Rows whose library is one of ``libs``."""
    return df.filter(F.col(column).isin(*libs))


def test_name_match(df: DataFrame, word: str = "test") -> DataFrame:
    """Rows whose path or import holds ``word``; missing text does not match."""
    hit = F.coalesce(F.col("path").contains(word), F.lit(False)) | F.coalesce(
        F.col("import_name").contains(word), F.lit(False)
    )
    return df.filter(hit)


# The name starts with "test"; keep pytest from collecting it.
test_name_match.__test__ = False  # type: ignore[attr-defined]


def keyword_exclusion(
    df: DataFrame, column: str = "description", terms: Sequence[str] = C.EXCLUDED_TERMS
) -> DataFrame:
    """Rows whose text holds none of the terms, in any case; missing text is dropped."""
    # one pass over the text, terms as they are
    pattern = "|".join(rf"\Q{term}\E" for term in terms)
    return df.filter(~F.lower(column).rlike(pattern)) if terms else df.filter(F.col(column).isNotNull())


def base_repo_predicate(df: DataFrame, language: str = C.LANGUAGE) -> DataFrame:
    """Projects that are no fork, have the language and a description."""
    return df.filter(
        F.col("forked_from").isNull()
        & (F.col("language") == language)
        & (F.col("description") != "")
    )


def quality_probes(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row per check: how many rows meet it, and of how many."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(check).alias(name) for name, check in checks.items()],
    )
    return counts.unpivot(["_rows"], list(checks), "probe", "hits").withColumnRenamed("_rows", "total")


def repo_probes() -> dict[str, Column]:
    """Checks of selected repositories: each should meet none of them."""
    return {
        "unknown_select": F.col("select").isNull(),
        "no_lines": ~F.coalesce(F.col("loc") > 0, F.lit(False)),
        "no_complexity": ~F.coalesce(F.col("complexity") > 0, F.lit(False)),
        "negative_age": F.col("age") < 0,
    }


def error_probes(folders: Sequence[str] = ("env", "lib")) -> dict[str, Column]:
    """Checks of file rows: internal errors, and those outside folders of installed packages."""
    installed = F.col("path").rlike("(^|/)(" + "|".join(folders) + ")[^/]*/")
    return {"internal_error": F.col("internal_error"), "own_internal_error": F.col("internal_error") & ~installed}


def fill_missing(df: DataFrame, value: float = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become ``value``."""
    return df.na.fill(value, list(columns) if columns is not None else None)


def name_empty(df: DataFrame, column: str, label: str = "None") -> DataFrame:
    """The empty name is shown as ``label``."""
    return df.withColumn(column, F.when(F.col(column) == "", label).otherwise(F.col(column)))


def cast_value(df: DataFrame, column: str = "value") -> DataFrame:
    """The value column as a double."""
    return df.withColumn(column, F.col(column).cast("double"))
