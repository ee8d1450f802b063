"""From project and watcher tables to candidate lists and merged metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.operators.aggregates import starred_repos
from repometrics.operators.filters import base_repo_predicate, created_since, keyword_exclusion
from repometrics.operators.joins import star_join
from repometrics.operators.ordering import chunk_list
from repometrics.operators.sets import id_intersection, merge_result_chunks


def candidate_repos(
    projects: DataFrame,
    watchers: DataFrame,
    terms: Sequence[str] = C.EXCLUDED_TERMS,
    min_stars: int = C.MIN_STARS,
    language: str = C.LANGUAGE,
) -> DataFrame:
    """Original projects in a language, free of the excluded terms, with enough watchers."""
    wanted = keyword_exclusion(base_repo_predicate(projects, language), "description", terms)
    columns = ["id", "name", "url", "description", "language"]
    return starred_repos(star_join(wanted.select(*columns), watchers, min_stars), min_stars)


def extraction_lists(
    ds: DataFrame, nonds: DataFrame, since: str = C.LISTS_SINCE, size: int = C.CHUNK_SIZE
) -> dict[str, DataFrame]:
    """Chunked id lists of both groups, newest first, and the ids in both."""
    recent = created_since(nonds, since)
    columns = ["id", "created_at"]
    order = [F.desc("created_at"), F.asc("id")]
    return {
        "ds": chunk_list(ds.select(*columns), order, size),
        "nonds": chunk_list(recent.select(*columns), order, size),
        "duplicates": id_intersection(recent, ds),
    }


def merged_metrics(
    ds_tables: Mapping[str, DataFrame], nonds_tables: Mapping[str, DataFrame], ds_ids: DataFrame
) -> dict[str, DataFrame]:
    """``merge_result_chunks`` for every metric table."""
    return {
        name: merge_result_chunks(ds_tables[name], nonds_tables[name], ds_ids) for name in ds_tables
    }
