"""Comparison of repository measures between the two groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.functions import clamp_below
from repometrics.operators.aggregates import describe_counted, value_share
from repometrics.operators.curves import survival_curves
from repometrics.operators.stats import ks_two_sample
from repometrics.session import settle


def count_measures(ds: DataFrame, nonds: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts (dim, grp, x, n) of every measure in one pass over both groups."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("grp"), *[F.col(d).cast("double").alias(d) for d in dims])

    rows = side(ds, "DS").unionByName(side(nonds, "non-DS"))
    tall = rows.unpivot(["grp"], list(dims), "dim", "x")
    return tall.groupBy("dim", "grp", "x").agg(F.count(F.lit(1)).alias("n"))


def compare_distributions(
    ds: DataFrame,
    nonds: DataFrame,
    log_dims: Sequence[str] = C.LOG_DIMENSIONS,
    linear_dims: Sequence[str] = C.LINEAR_DIMENSIONS,
) -> dict[str, Callable[[], DataFrame]]:
    """Language shares, summaries, survival curves and Kolmogorov-Smirnov tests, each built when called.

    The measures are counted and written once, by the first result that needs them.
    """
    @cache
    def counted() -> DataFrame:
        return settle(count_measures(ds, nonds, [*log_dims, *linear_dims]))

    def known() -> DataFrame:
        return counted().filter(F.col("x").isNotNull())

    def curves_log() -> DataFrame:
        raised = (
            counted().filter(F.col("dim").isin(*log_dims))
            .withColumn("x", clamp_below("x", C.CURVE_FLOOR))
            .groupBy("dim", "grp", "x").agg(F.sum("n").alias("n"))
        )
        return survival_curves(raised, log=True)

    def tests() -> DataFrame:
        return ks_two_sample(known().groupBy(F.col("dim").alias("factor"), "x").agg(
            F.sum(F.when(F.col("grp") == "DS", F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("grp") == "DS", 0).otherwise(F.col("n"))).alias("b"),
        ))

    return {
        "languages_ds": lambda: value_share(ds, "language"),
        "languages_nonds": lambda: value_share(nonds, "language"),
        "summary": lambda: describe_counted(known(), ["dim", "grp"]),
        "curves_log": curves_log,
        "curves_linear": lambda: survival_curves(known().filter(F.col("dim").isin(*linear_dims))),
        "tests": tests,
    }
