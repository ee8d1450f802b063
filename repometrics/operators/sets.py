"""Set operations on id tables and the merge of result chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repometrics.operators.joins import anti_by_ids


def merge_result_chunks(ds: DataFrame, nonds: DataFrame, ds_ids: DataFrame) -> DataFrame:
    """All rows of the first group, and those of the second whose repo is not in it."""
    return ds.unionByName(anti_by_ids(nonds, ds_ids), allowMissingColumns=True)


def id_union(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids in at least one table."""
    return a.select(key).union(b.select(key)).distinct()


def _membership(tables: Sequence[DataFrame], key: str) -> DataFrame:
    # All tables in one aggregation: repeated ids shrink before the shuffle.
    tagged = [
        df.select(key, *[F.lit(int(i == j)).alias(f"_{j}") for j in range(len(tables))])
        for i, df in enumerate(tables)
    ]
    rows = reduce(DataFrame.unionAll, tagged).filter(F.col(key).isNotNull())
    return rows.groupBy(key).agg(*[F.sum(f"_{j}").alias(f"rows_{j}") for j in range(len(tables))])


def id_intersection(*tables: DataFrame, key: str = "id") -> DataFrame:
    """Ids in every one of the tables."""
    in_all = reduce(lambda cond, j: cond & (F.col(f"rows_{j}") > 0), range(len(tables)), F.lit(True))
    return _membership(tables, key).filter(in_all).select(key)


def set_sizes(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows and distinct ids of two tables, and the size of their overlap."""
    in_a, in_b = F.col("rows_0") > 0, F.col("rows_1") > 0
    return _membership([a, b], key).agg(
        F.sum("rows_0").alias("rows_a"), F.count_if(in_a).alias("ids_a"),
        F.sum("rows_1").alias("rows_b"), F.count_if(in_b).alias("ids_b"),
        F.count_if(in_a & in_b).alias("overlap"),
    )
