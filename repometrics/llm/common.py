"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The six ASCII characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: Arrow's types of result columns.
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and whole ``text``; a missing text counts as an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def map_documents(docs: DataFrame, worker: Callable[[], Callable[[bytes], dict]], schema: str) -> DataFrame:
    """One result row per document.

    ``worker()`` runs once in a task and returns the function that turns the
    UTF-8 bytes of a text into the columns of ``schema`` after ``doc_id``.
    """
    fields = [f.split() for f in f"doc_id long, {schema}".split(", ")]
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = worker()
        for batch in batches:
            rows = [each(x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0)] + [pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return texts(docs).select("doc_id", F.encode("text", "UTF-8")).mapInArrow(run, f"doc_id long, {schema}")
