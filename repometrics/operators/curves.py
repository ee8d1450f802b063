"""Survival curves: the share of a group that lies in a bin or above it.

Bins follow ``CURVE_EDGES`` edges between the smallest and the largest value
of all groups together.  Values are counted once, so a curve costs one small
row per distinct value, and a curve itself has at most 999 rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.functions import clamp_below
from repometrics.session import settle


def _edge(k: Column, log: bool, edges: int) -> Column:
    step = (F.col("_stop") - F.col("_start")) / F.lit(float(edges - 1))
    position = F.when(k == edges - 1, F.col("_stop")).otherwise(k * step + F.col("_start"))
    return F.pow(F.lit(10.0), position) if log else position


def survival_curves(counted: DataFrame, log: bool = False, edges: int = C.CURVE_EDGES) -> DataFrame:
    """Curves for counts (dim, grp, x, n): one per dim and group, edges shared within a dim."""
    low, high = F.min("x"), F.max("x")
    if log:
        low, high = F.log10(low), F.log10(high)
    limits = counted.groupBy("dim").agg(low.alias("_start"), (high + C.CURVE_PAD).alias("_stop"))
    bins = edges - 1
    scaled = F.log10("x") if log else F.col("x")
    guess = F.floor((scaled - F.col("_start")) / (F.col("_stop") - F.col("_start")) * bins)
    placed = (
        counted.join(limits, "dim")
        .withColumn("_guess", F.greatest(F.lit(0), F.least(F.lit(bins - 1), guess)).cast("bigint"))
        # division may be off by one bin; the edges themselves decide
        .withColumn(
            "bin",
            F.when((F.col("x") < _edge(F.col("_guess"), log, edges)) & (F.col("_guess") > 0), F.col("_guess") - 1)
            .when(
                (F.col("x") >= _edge(F.col("_guess") + 1, log, edges)) & (F.col("_guess") < bins - 1),
                F.col("_guess") + 1,
            )
            .otherwise(F.col("_guess")),
        )
        .groupBy("dim", "grp", "bin")
        .agg(F.sum("n").alias("n"), F.first("_start").alias("_start"), F.first("_stop").alias("_stop"))
    )
    curve = Window.partitionBy("dim", "grp")
    upward = curve.orderBy("bin")
    reached = placed.withColumns({
        "_share": F.sum("n").over(curve.orderBy(F.desc("bin"))) / F.sum("n").over(curve),
        "_from": F.coalesce(F.lag("bin").over(upward) + 1, F.lit(0).cast("bigint")),
        "_to": F.when(F.lead("bin").over(upward).isNull(), F.lit(bins - 1).cast("bigint")).otherwise(F.col("bin")),
    })
    # Bins without a value repeat the share of the next one above them.
    return reached.select(
        "dim", "grp", "_start", "_stop", "_share", F.col("bin").alias("_own"),
        F.explode(F.sequence("_from", "_to")).alias("bin"),
    ).select(
        "dim", "grp", "bin",
        _edge(F.col("bin"), log, edges).alias("edge"),
        F.when(F.col("bin") <= F.col("_own"), F.col("_share")).otherwise(0.0).alias("survival"),
    )


def _count_values(df: DataFrame, column: str, group: str, value: Column) -> DataFrame:
    rows = df.select(F.lit(column).alias("dim"), F.col(group).alias("grp"), value.cast("double").alias("x"))
    # read twice below: once for the edges, once for the bins
    return settle(rows.dropna().groupBy("dim", "grp", "x").agg(F.count(F.lit(1)).alias("n")))


def survival_curve_log(
    df: DataFrame, column: str, group: str, edges: int = C.CURVE_EDGES, floor: float = C.CURVE_FLOOR
) -> DataFrame:
    """Curve on a log scale; values at or below ``floor`` and missing ones become ``floor``."""
    return survival_curves(_count_values(df, column, group, clamp_below(column, floor)), log=True, edges=edges)


def survival_curve_linear(df: DataFrame, column: str, group: str, edges: int = C.CURVE_EDGES) -> DataFrame:
    """Curve on a linear scale; missing values are left out."""
    return survival_curves(_count_values(df, column, group, F.col(column)), edges=edges)


def _cap(cap: float | Mapping[str, float], default: float) -> Column:
    """The cap of a row's factor."""
    if not isinstance(cap, Mapping):
        return F.lit(float(cap))
    caps = F.create_map(*[F.lit(x) for item in cap.items() for x in (item[0], float(item[1]))]) if cap else None
    return F.lit(default) if caps is None else F.coalesce(F.try_element_at(caps, F.col("factor")), F.lit(default))


def _clipped(
    hist: DataFrame,
    groups: Mapping[str, str],
    dims: Sequence[str] | None,
    cap: float | Mapping[str, float],
    edges: int,
) -> DataFrame:
    rows = hist if dims is None else hist.filter(F.col("factor").isin(*dims))
    tall = rows.select(
        F.col("factor").alias("dim"), F.least("x", _cap(cap, C.CURVE_CAP)).alias("x"),
        *[F.col(f"`{column}`").alias(label) for column, label in groups.items()],
    ).unpivot(["dim", "x"], [F.col(f"`{label}`") for label in groups.values()], "grp", "n")
    # read twice: for the edges and for the bins
    counted = settle(tall.filter(F.col("n") > 0).groupBy("dim", "grp", "x").agg(F.sum("n").alias("n")))
    return survival_curves(counted, edges=edges)


def survival_curve_clipped(
    hist: DataFrame,
    dims: Sequence[str] | None = None,
    cap: float | Mapping[str, float] = C.CURVE_CAP,
    edges: int = C.CURVE_EDGES,
) -> DataFrame:
    """Curves of both repository groups, values above ``cap`` at ``cap``, all dims at once.

    ``cap`` is one number, or one for each dim (others: ``CURVE_CAP``).
    """
    return _clipped(hist, {"a": "DS", "b": "non-DS"}, dims, cap, edges)


def survival_curve_by_category(
    hist: DataFrame,
    dims: Sequence[str] | None = None,
    cap: float | Mapping[str, float] = C.CURVE_CAP,
    edges: int = C.CURVE_EDGES,
    cats: Sequence[str] = C.CATEGORIES,
) -> DataFrame:
    """Curves by file category from a histogram with one count column per category."""
    return _clipped(hist, {c: c for c in cats}, dims, cap, edges)
