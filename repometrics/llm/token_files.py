"""Operator 3: token ids in flat binary files.

``write_tokens`` deals the documents out by ranges of ``doc_id``, so files
number the documents in ascending order.  Each file set of a range is

* ``NNNNN.ids``  flat unsigned integers, the smallest type that holds the vocabulary;
* ``NNNNN.off``  64-bit offsets into them, one more than documents, from 0;
* ``NNNNN.doc``  64-bit document ids (the least 64-bit integer stands for a missing id).

Where a range begins among all ids is the prefix sum of the lengths before
it; only one row for each range goes to the driver for that.  A task writes
to names of its own and renames them at its end, so a repeated task
leaves the same files.  ``read_tokens`` maps the files into memory.

Missing text is empty text and yields the end id alone.  Rows with equal
``doc_id`` lie in the order of their texts.  An empty table makes no files
and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import texts
from .wordbpe import encoder as word_encoder

NO_ID = -(2**63)


class Shard(NamedTuple):
    shard: int
    docs: int
    tokens: int
    base: int


class TokenFiles(NamedTuple):
    folder: str
    dtype: str
    shards: list[Shard]


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Of a path or address that all executors share."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (pafs.LocalFileSystem(), folder) if folder.startswith("/") else pafs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, shards: int | None = None) -> TokenFiles:
    """Encode whole texts, end each document with ``end_id``, write the files."""
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        number, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        encoder, ids, ends, total = word_encoder(tokenizer), [], [0], 0
        with fs.open_output_stream(f"{root}/{own}.ids") as out:
            for batch in batches:
                ids += [NO_ID if x is None else x for x in batch.column(0).to_pylist()]
                for text in batch.column(1).to_pylist():
                    tokens = np.append(encoder.encode(text), np.uint32(end_id)).astype(dtype)
                    out.write(tokens.tobytes())
                    total += len(tokens)
                    ends.append(total)
        if not ids:
            fs.delete_file(f"{root}/{own}.ids")
            return
        for kind, values in (("off", ends), ("doc", ids)):
            with fs.open_output_stream(f"{root}/{own}.{kind}") as out:
                out.write(np.asarray(values, "<i8").tobytes())
        for kind in ("ids", "off", "doc"):
            fs.move(f"{root}/{own}.{kind}", f"{root}/{number:05d}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [number], "docs": [len(ids)], "tokens": [total]})

    rows = texts(docs)
    rows = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions("doc_id", "text").select("doc_id", F.encode("text", "UTF-8"))
    base, found = 0, []
    for shard, n, tokens in sorted(tuple(r) for r in rows.mapInArrow(run, "shard long, docs long, tokens long").collect()):
        found.append(Shard(shard, n, tokens, base))
        base += tokens
    return TokenFiles(folder, dtype, found)


def _mapped(fs: pafs.FileSystem, path: str, dtype: str):
    """The file as an array; only what is used of it is read where the file system is local."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, and its ``ids`` if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    folder, dtype = files.folder, files.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{root}/{row['shard']:05d}"
                ids, ends, docs = _mapped(fs, f"{stem}.ids", dtype), _mapped(fs, f"{stem}.off", "<i8"), _mapped(fs, f"{stem}.doc", "<i8")
                for at in range(0, len(docs), 2000):
                    own, cut = docs[at : at + 2000].tolist(), ends[at : at + 2001].tolist()
                    parts = [ids[a:b].astype("<u4") for a, b in zip(cut, cut[1:])]
                    columns = {
                        "doc_id": pa.array([None if x == NO_ID else x for x in own], pa.int64()),
                        "start": pa.array([row["base"] + x for x in cut[:-1]], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in parts], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                    } | ({"ids": pa.array([x.tolist() for x in parts], pa.list_(pa.int64()))} if with_ids else {})
                    yield pa.RecordBatch.from_pydict(columns)

    rows = spark.createDataFrame(files.shards or [Shard(0, 0, 0, 0)], "shard long, docs long, tokens long, base long").filter("docs > 0")
    return rows.repartition(max(1, len(files.shards))).mapInArrow(run, schema)
