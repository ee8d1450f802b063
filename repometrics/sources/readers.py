"""Readers.  All schemas are explicit, so no reader runs an inference job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repometrics import schemas
from repometrics.operators.joins import semi_by_ids
from repometrics.sources.manifest import read_listed

# Quotes are doubled inside quoted fields.
# A file with several columns of one name is read by position.
CSV_OPTIONS = {
    "header": "true",
    "enforceSchema": "true",
    "escape": '"',
    "mode": "PERMISSIVE",
}


#: Tables with free text, whose fields may hold line breaks; their files cannot be split.
FREE_TEXT = ("lint_messages",)


def _csv(spark: SparkSession, paths: str | Sequence[str], schema: str, free_text: bool = False) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=free_text).csv(paths)


def read_repo_meta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Repository metadata CSV with parsed timestamps."""
    return _csv(spark, path, schemas.REPO_META, free_text=True)


def read_metric_csv(spark: SparkSession, paths: str | Sequence[str], table: str) -> DataFrame:
    """One metric table (a key of ``schemas.METRIC_TABLES``) from CSV."""
    return _csv(spark, paths, schemas.METRIC_TABLES[table], table in FREE_TEXT)


def read_intermediate(spark: SparkSession, path: str) -> DataFrame:
    """A derived table written by ``write_table``."""
    return spark.read.parquet(path)


def read_id_list(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One-column list of repository ids."""
    return _csv(spark, path, schemas.ID_LIST)


def read_repo_json(
    spark: SparkSession, glob: str, responses: bool = False, multi_line: bool = True
) -> DataFrame:
    """Repository objects; ``responses=True`` also reads failure fields.

    ``multi_line=False`` reads one object per line, which large files need to be split.
    """
    schema = schemas.FETCH_RESPONSE if responses else schemas.REPO_JSON
    return spark.read.schema(schema).option("multiLine", multi_line).json(glob)


def read_result_chunks(spark: SparkSession, dirs: Sequence[str], name: str, table: str) -> DataFrame:
    """The same result file from several chunk folders; ``chunk`` is the folder name."""
    paths = [f"{d.rstrip('/')}/{name}" for d in dirs]
    # A chunk may be one file or a folder of part files.
    folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), f"/{name}", 1), "/", -1)
    rows = _csv(spark, paths, schemas.METRIC_TABLES[table], table in FREE_TEXT)
    return rows.select("*", folder.alias("chunk"))


def scan_warehouse(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table such as ``projects`` or ``watchers``."""
    return spark.table(name)


def scan_source_files(
    spark: SparkSession,
    root: str,
    ids: DataFrame | None = None,
    suffix: str = ".py",
    manifest: DataFrame | None = None,
    batch_bytes: int = 64_000_000,
) -> DataFrame:
    """Source files below ``root``: (repo, path, content), one row per file.

    ``path`` is relative to ``root`` and ``repo`` is its first folder.  Bytes
    that are not UTF-8 become replacement characters.  With a ``manifest``
    (relative ``path``, ``bytes`` if known; see ``list_source_files``) exactly the files it
    names are read, in partitions of about ``batch_bytes`` (more where there would be over 500, see ``read_listed``), and only those of ``ids`` are opened; a file that is not
    there has no content.  Without one Spark lists the tree in the driver, and skips files without bytes and names that begin with ``_``.
    """
    if manifest is not None:
        named = manifest.filter(F.endswith("path", F.lit(suffix)))
        if ids is not None:
            named = semi_by_ids(named.withColumn("repo", _repo_of("path")), ids).drop("repo")
        found = read_listed(spark, root, named, batch_bytes)
        return found.select(_repo_of("path").alias("repo"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    texts = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    # "file:/a", "file:///a" and "/a" name the same folder.
    prefix = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    relative = F.get(F.split(F.concat(F.lit("/"), "path"), rf"\Q{prefix}\E", 2), F.lit(1))
    rows = texts.select(relative.alias("path"), "content").select(_repo_of("path").alias("repo"), "path", "content")
    return rows if ids is None else semi_by_ids(rows, ids)


def _repo_of(path: str) -> Column:
    return F.substring_index(path, "/", 1).try_cast("bigint")
