"""Equi-joins of long tables with tables of one row per key.

They are written as plain joins: each side is read once, Spark broadcasts a
side by its own estimate, and adaptive execution splits the partitions of a key that
holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ids(ids: DataFrame, key: str) -> DataFrame:
    name = "id" if "id" in ids.columns else ids.columns[0]
    return ids.select(F.col(name).alias(key)).dropna().distinct()


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str = "repo") -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(_ids(ids, key), key, "left_semi")


def anti_by_ids(df: DataFrame, ids: DataFrame, key: str = "repo") -> DataFrame:
    """Rows whose key is not in ``ids``; a missing key stays."""
    return df.join(_ids(ids, key), key, "left_anti")


def membership_flag(
    df: DataFrame, ids: DataFrame, key: str = "repo", name: str = "is_member"
) -> DataFrame:
    """Add a boolean column: is the key in ``ids``?"""
    known = _ids(ids, key).withColumn(name, F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def enrich_repos(
    meta: DataFrame, git: DataFrame, versions: DataFrame, loc: DataFrame, complexity: DataFrame
) -> DataFrame:
    """Repository metadata with git dates, versions, size and complexity.

    Every side has one row per repository and is joined on the same column, so
    each is shuffled at most once.
    """
    base = meta.withColumn("repo", F.col("id"))
    for side in (git, versions, loc, complexity):
        base = base.join(side, "repo", "left")
    return base.drop("repo")


def enrich_files(lint: DataFrame, loc: DataFrame, labels: DataFrame, complexity: DataFrame) -> DataFrame:
    """Per-file lint rows with size, category and mean complexity."""
    keys = ["repo", "path"]
    sized = loc.select(*keys, F.col("nonblank_loc").alias("loc"))
    return (
        lint.join(sized, keys, "left")
        .join(labels.select(*keys, "cat"), keys, "left")
        .join(complexity.select(*keys, "complexity"), keys, "left")
    )


def attach_repo_profile(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Add per-repository columns to per-file rows."""
    return df.join(profile, "repo", "left")


def star_join(projects: DataFrame, watchers: DataFrame, min_stars: int = 0) -> DataFrame:
    """Projects with at least ``min_stars`` watchers, zero where there is none.

    Watchers are counted before the join, so a project with very many of them
    costs one row; with ``min_stars`` only well-watched projects meet the join.
    """
    stars = (
        watchers.filter(F.col("repo_id").isNotNull())
        .groupBy(F.col("repo_id").alias("id"))
        .agg(F.count("user_id").alias("stars"))
    )
    if min_stars > 0:
        return projects.join(stars.filter(F.col("stars") >= min_stars), "id")
    return projects.join(stars, "id", "left").withColumn("stars", F.coalesce("stars", F.lit(0)))
