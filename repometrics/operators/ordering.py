"""Sorting, row numbers and running totals without a one-task window.

A window over a whole table, or over one key that holds a third of it, runs in
one task.  ``running_totals`` splits the ordered rows into ranges first: each
range is summed on its own, and a short table of range totals carries the sums
of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.session import settle

_SLICE = "_slice"


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    totals: Mapping[str, Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``before_<name>`` (sum over earlier rows) and ``total_<name>`` per key.

    ``totals`` lists sums for which only the total is wanted; ``ranges`` is the
    number of ranges (default: ``spark.sql.shuffle.partitions``).  Key columns must
    not be null.  The rows are written once: their range number must be the
    same wherever it is read.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    totals = dict(totals or {})
    measured = {**sums, **totals}
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    spread = settle(ranged.withColumn(_SLICE, F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # one row per key and range
    per_slice = spread.groupBy(*keys, _SLICE).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in measured.items()])
    offsets = per_slice.select(
        *keys, _SLICE,
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(f"total_{n}") for n in measured],
    )
    local = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.select(
        "*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"_b_{n}") for n, c in sums.items()]
    )
    joined = inside.join(offsets, [*keys, _SLICE])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.col(f"_b_{n}")).alias(f"before_{n}") for n in sums],
        *[f"total_{n}" for n in measured],
    )


def row_numbers(df: DataFrame, order: Sequence[Column | str], tie_break: Sequence[str] = ()) -> DataFrame:
    """Add ``row_number`` (from 1) and ``row_count`` in the given order.

    ``tie_break`` names columns that tell rows of equal ``order`` apart; without
    it equal rows have arbitrary numbers and fall into one range.
    """
    counted = running_totals(df, [], [*order, *tie_break], {"n": F.lit(1)})
    return counted.select(
        *df.columns,
        (F.col("before_n") + 1).alias("row_number"),
        F.col("total_n").alias("row_count"),
    )


def recent_first(df: DataFrame) -> DataFrame:
    """Newest rows first, ids break ties."""
    return df.orderBy(F.desc("created_at"), F.asc("id"))


def popular_first(df: DataFrame, count: str, key: str) -> DataFrame:
    """Largest counts first, the key breaks ties."""
    return df.orderBy(F.desc(count), F.asc(key))


def most_significant_first(df: DataFrame) -> DataFrame:
    """Smallest two-sided rank-test probability first, missing last."""
    return df.orderBy(F.asc_nulls_last("u_pval"), F.asc("factor"))


def sorted_distinct(df: DataFrame, column: str, sep: str = ", ", per_row: int = 1000) -> DataFrame:
    """Sorted distinct values as text, ``per_row`` values in a row, all of them kept."""
    values = df.select(column).dropna().distinct()
    numbered = row_numbers(values, [column])
    part = F.floor((F.col("row_number") - 1) / per_row).cast("bigint")
    grouped = numbered.groupBy(part.alias("part")).agg(F.sort_array(F.collect_list(column)).alias("_values"))
    return grouped.select(
        "part", F.array_join(F.transform("_values", lambda v: v.cast("string")), sep).alias("listing")
    ).orderBy("part")


def chunk_list(
    df: DataFrame,
    order: Sequence[Column | str] | None = None,
    size: int = C.CHUNK_SIZE,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Ordered rows in chunks of ``size``; ``label`` is first-last, six digits each."""
    order = order or [F.desc("created_at"), F.asc("id")]
    numbered = row_numbers(df, order, tie_break)
    first = F.floor((F.col("row_number") - 1) / size) * size + 1
    last = F.least(first + size - 1, F.col("row_count"))

    def padded(number: Column) -> Column:
        # wider numbers stay whole
        text = number.cast("string")
        return F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))

    return numbered.select(
        *df.columns,
        "row_number",
        F.floor((F.col("row_number") - 1) / size).cast("bigint").alias("chunk"),
        F.concat(padded(first), F.lit("-"), padded(last)).alias("label"),
    )


def slice_rows(
    df: DataFrame, start: int, stop: int, order: Sequence[Column | str], tie_break: Sequence[str] = ()
) -> DataFrame:
    """Rows ``start`` (from 0) up to but not including ``stop`` in the given order."""
    numbered = row_numbers(df, order, tie_break)
    return numbered.filter(
        (F.col("row_number") > start) & (F.col("row_number") <= stop)
    ).select(*df.columns, "row_number")
