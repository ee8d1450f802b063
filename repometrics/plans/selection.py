"""Which repositories are compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.operators.aggregates import loc_by_repo, mean_complexity_by_repo
from repometrics.operators.filters import (
    age_between,
    created_since,
    drop_push_before_create,
    keep_selected,
    repo_age_days,
)
from repometrics.operators.joins import enrich_repos


def _enriched(meta: DataFrame, git: DataFrame, ver: DataFrame, loc: DataFrame, cc: DataFrame) -> DataFrame:
    return enrich_repos(
        meta, repo_age_days(git), ver, loc_by_repo(loc), mean_complexity_by_repo(cc)
    )


def select_ds(
    meta: DataFrame,
    git: DataFrame,
    ver: DataFrame,
    loc: DataFrame,
    cc: DataFrame,
    blacklist: Sequence[int] = C.BLACKLISTED_IDS,
) -> DataFrame:
    """Data-science repositories usable from Python 3, with all their measures.

    ``ver`` is the table of ``version_table``; one row per repository in all
    inputs but ``loc`` and ``cc``.
    """
    kept = meta.filter(~F.col("id").isin(*blacklist)) if blacklist else meta
    return keep_selected(_enriched(kept, git, ver, loc, cc))


def select_nonds(
    meta: DataFrame,
    git: DataFrame,
    ver: DataFrame,
    loc: DataFrame,
    cc: DataFrame,
    ds_ids: DataFrame,
    since: str = C.SELECT_SINCE,
    max_age: float = C.MAX_AGE_DAYS,
) -> DataFrame:
    """Comparable other repositories: recent, consistent dates, limited age, Python 3.

    ``ds_ids`` are all data-science ids, also those blacklisted later.
    """
    # metadata has one row per repository, so no key is hot in this join
    others = meta.join(ds_ids.select(F.col("id")).distinct(), "id", "left_anti")
    recent = drop_push_before_create(created_since(others, since))
    return keep_selected(age_between(_enriched(recent, git, ver, loc, cc), 0, max_age))
