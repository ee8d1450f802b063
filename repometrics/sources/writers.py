"""Writers.  Output stays split over files; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table as Parquet, or as CSV/JSON for other tools."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(header="true", escape='"', quoteAll="false")
    writer.format(fmt).save(path)


def append_rows(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add rows to a table that grows run by run."""
    write_table(df, path, fmt=fmt, mode="append")


def append_run(df: DataFrame, path: str, run: str, fmt: str = "parquet") -> None:
    """Add the rows of one run, a folder ``run=...`` of the table; the same run written again replaces its own rows.

    A run that failed half way, or was started twice, so leaves each row once.  Other runs are not touched.
    A run without rows leaves the folder it had, if any.
    """
    writer = df.withColumn("run", F.lit(run)).write.mode("overwrite").partitionBy("run")
    if fmt == "csv":
        writer = writer.options(header="true", escape='"', quoteAll="false")
    writer.option("partitionOverwriteMode", "dynamic").format(fmt).save(path)


def bucket_count(tables: Sequence[DataFrame], rows: int = 500_000, least: int = 8) -> int:
    """How many buckets hold about ``rows`` rows each of the largest table; ``least`` for small ones.

    A bucket is read, joined and grouped by one task, so a fixed number would make tasks as large as the input.  Tables to be
    joined need one number for all of them.  Each table is counted in a pass of its own; only its count goes to the driver.
    """
    return max(least, *(-(-table.count() // rows) for table in tables))


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str] = ("repo", "path"), buckets: int = 200) -> DataFrame:
    """Write a catalog table whose files are dealt and sorted by ``keys``, and read it.

    Joins and groupings on all of ``keys`` of tables with equally many buckets need no shuffle, run after run.  Rows are dealt
    before they are written, so there is one file for a bucket.  ``bucket_count`` finds a number that follows the rows.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_with_probes(df: DataFrame, path: str, checks: Mapping[str, Column], fmt: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Write a table, and count in the same pass how many rows meet each check: (probe, hits, total) as ``quality_probes``.

    The counts are metrics observed by the tasks that write, so the rows are neither read again nor kept.  Names of checks are
    free; one row a check goes through the driver.
    """
    seen = Observation()
    named = {f"_{k}": check for k, check in enumerate(checks.values())}
    counts = [F.count_if(check).alias(name) for name, check in named.items()]
    write_table(df.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts), path, fmt, mode)
    found = seen.get
    rows = [(probe, found[name], found["_rows"]) for probe, name in zip(checks, named, strict=True)]
    return df.sparkSession.createDataFrame(rows, "probe string, hits bigint, total bigint")


def write_by_outcome(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON rows in one folder per ``outcome`` value."""
    df.write.mode(mode).partitionBy("outcome").json(path)


def write_chunks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV rows in one folder per ``label`` made by ``chunk_list``."""
    df.write.mode(mode).option("header", "true").partitionBy("label").csv(path)
