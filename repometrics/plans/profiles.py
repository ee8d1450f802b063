"""Import and language-version profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.operators.aggregates import (
    column_cardinality,
    label_files,
    library_set_popularity,
    library_sets,
    popular_imports,
    value_counts,
    version_summary_counts,
    version_table,
)
from repometrics.operators.filters import library_in_list, name_empty


def import_analysis(
    imports: DataFrame,
    libs: Sequence[str] = C.DS_LIBRARIES,
    test_frameworks: Sequence[str] = C.TEST_FRAMEWORKS,
    sep: str = ".",
) -> dict[str, DataFrame]:
    """Popular imports, library combinations and file labels."""
    popular = popular_imports(imports, sep)
    shown = name_empty(popular, "import_short_name")
    labels = label_files(imports, libs, test_frameworks, sep)
    sets = library_sets(imports, libs, sep)
    return {
        "cardinality": column_cardinality(imports, ["repo", "path", "module_name", "import_name"]),
        "popular": popular,
        "popular_libraries": library_in_list(shown, libs),
        "library_sets": sets,
        "library_set_popularity": library_set_popularity(sets),
        "labels": labels,
        "label_counts": value_counts(labels, "cat").orderBy(F.desc("n"), F.asc("cat")),
    }


def version_analysis(ver: DataFrame) -> dict[str, DataFrame]:
    """Version table of one group of repositories and its two counts."""
    table = version_table(ver)
    return {
        "table": table,
        "by_summary": version_summary_counts(table, "summary"),
        "by_select": version_summary_counts(table, "select"),
    }
