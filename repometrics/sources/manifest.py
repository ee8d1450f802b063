"""Source files read by a manifest, so that no list of files is held in the driver.

A manifest is a table: ``path`` (relative to a root) and, if known, ``bytes``.  ``list_source_files`` makes one
in tasks, a folder each.  ``read_listed`` deals it into batches of about ``batch_bytes`` by running totals (more where
there would be very many batches, as each costs a task and a folder),
writes the batches to the shared checkpoint folder and reads them through a data source of its own whose partitions
are the batches: the driver knows their number, a task reads its batch and then the files it names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from repometrics.operators.ordering import running_totals
from repometrics.session import scratch_path

SOURCE = "listed_files"
#: What a file costs besides its bytes, and one of unknown size.
PER_FILE, UNKNOWN = 4_096, 16_384
#: More batches than this are made only of so many bytes each, or of ``batch_bytes`` if that is more.
BATCHES, FULL = 500, 64_000_000
#: A task hands its rows on when it holds so many bytes.
HELD = 16_000_000


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """Of a path or address that all executors share."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    fs, path = (pafs.LocalFileSystem(), root) if root.startswith("/") else pafs.FileSystem.from_uri(root)
    return fs, path.rstrip("/") or "/"


class ListedFiles(DataSource):
    """``path, content`` of the files that batches of a manifest name."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ListedFilesReader(self.options["root"], self.options["manifest"], int(self.options["batches"]))


class ListedFilesReader(DataSourceReader):
    def __init__(self, root: str, manifest: str, batches: int):
        self.root, self.manifest, self.batches = root, manifest, batches

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.batches)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            # no batch at all
            return
        lists, folder = file_system(self.manifest)
        found = lists.get_file_info(pafs.FileSelector(f"{folder}/batch={partition.value}", allow_not_found=True))
        fs, root = file_system(self.root)
        paths: list[str] = []
        contents: list[bytes | None] = []
        held = 0
        for part in sorted(f.path for f in found if f.path.endswith(".parquet")):
            for path in pq.ParquetFile(lists.open_input_file(part)).read(["path"]).column(0).to_pylist():
                content = None
                if fs.get_file_info(f"{root}/{path}").type == pafs.FileType.File:
                    with fs.open_input_file(f"{root}/{path}") as file:
                        content = file.read()
                paths.append(path)
                contents.append(content)
                held += len(content or b"")
                if held > HELD:
                    yield _rows(paths, contents)
                    paths, contents, held = [], [], 0
        yield _rows(paths, contents)


def _rows(paths: list[str], contents: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])


def _below(root: str, suffix: str, deep: bool):
    """Entries of folders: files with the suffix, and folders if only one level is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                at = f"{top}/{folder}" if folder else top
                entries = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=deep))
                kept = [e for e in entries if (e.type == pafs.FileType.File and e.path.endswith(suffix)) or (not deep and e.type == pafs.FileType.Directory)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([e.path[len(top):].lstrip("/") for e in kept], pa.string()),
                    pa.array([e.size for e in kept], pa.int64()),
                    pa.array([e.type == pafs.FileType.Directory for e in kept], pa.bool_()),
                ], ["path", "bytes", "folder"])

    return run


def list_source_files(spark: SparkSession, root: str, ids: DataFrame | None = None, suffix: str = ".py") -> DataFrame:
    """``path, bytes`` of the files below ``root``, or below the folders named by ``ids``.

    One task lists the root; then each of its folders is listed by a task of its own.
    """
    schema = "path string, bytes bigint, folder boolean"
    if ids is not None:
        folders = ids.select(F.col("id" if "id" in ids.columns else ids.columns[0]).cast("string").alias("path")).dropna().distinct()
        loose = None
    else:
        top = spark.range(1).select(F.lit("").alias("path")).mapInArrow(_below(root, suffix, False), schema)
        folders, loose = top.filter("folder").select("path"), top.filter("NOT folder")
    found = folders.repartition("path").mapInArrow(_below(root, suffix, True), schema)
    return (found if loose is None else found.unionByName(loose)).select("path", "bytes")


def read_listed(spark: SparkSession, root: str, manifest: DataFrame, batch_bytes: int = 64_000_000) -> DataFrame:
    """``path, content`` (bytes) of the files a manifest names; a file that is not there has no content.

    Where batches of ``batch_bytes`` would be more than ``BATCHES``, they hold as many bytes as make it that many, up to
    ``FULL``.  A task hands its rows on as it reads, so it holds no more of a larger batch.
    """
    known = F.col("bytes") if "bytes" in manifest.columns else F.lit(None).cast("bigint")
    listed = manifest.dropna(subset=["path"]).select("path", F.coalesce(known, F.lit(UNKNOWN)).alias("bytes")).dropDuplicates(["path"])
    dealt = running_totals(listed, [], ["path"], {"cost": F.col("bytes") + PER_FILE})
    size = F.greatest(F.lit(batch_bytes), F.least(F.lit(FULL), F.ceil(F.col("total_cost") / BATCHES)))
    dealt = dealt.select("path", F.floor(F.col("before_cost") / size).cast("int").alias("batch"))
    folder = scratch_path(spark, f"manifest-{uuid.uuid4().hex}")
    seen = Observation()
    # with a number given the batches are not put into few tasks, small as they are: a folder costs more than its rows
    writers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt.observe(seen, F.max("batch").alias("last")).repartition(writers, "batch").write.partitionBy("batch").parquet(folder)
    last = seen.get["last"]
    spark.dataSource.register(ListedFiles)
    return (
        spark.read.format(SOURCE)
        .options(root=root, manifest=folder, batches=str(0 if last is None else last + 1))
        .load()
    )
