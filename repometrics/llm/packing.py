"""Operator 9: best-fit packing of documents into sequences of bounded length.

Only lengths matter for packing, and there are at most ``capacity`` of them.
Spark counts the pieces of each length; ``plan`` packs the counts, not the
pieces, so its work and its result depend on the capacity alone.  Then each
piece, numbered among those of its length, looks its place up in the plan.

``plan`` is large-item matching: pieces above a third of the capacity go at
most two to a sequence, each with the longest other one that still fits, from
the longest down.  Shorter pieces then go, longest first, to the least gap
that holds them; new sequences are opened only when no gap does.

Size of the plan: matching makes at most two kinds of sequence for each
length, a short length splits or opens at most two, and a gap that takes a
piece shrinks to less than half, so a kind has at most log2(capacity) + 2 slots.

Missing text is empty text and makes one piece of the end id alone.
Documents with equal ``doc_id`` are packed each for itself.  An empty table has no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle
from .common import texts
from .wordbpe import encoder as word_encoder


class Slot(NamedTuple):
    length: int      # of the pieces that go here
    rank: int        # of the first such piece
    pieces: int      # so many pieces in all
    copies: int      # of them in each sequence
    sequence: int    # the first sequence
    offset: int      # of the first copy in a sequence


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Where pieces of each length go. ``counts``: how many there are of a length."""
    left = {n: c for n, c in counts.items() if c}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    kinds: list[list] = []  # number of sequences, [(length, copies), ...]
    gaps: dict[int, list[list]] = {}

    def opened(number: int, *pieces: tuple[int, int]) -> None:
        kinds.append(kind := [number, list(pieces)])
        gaps.setdefault(capacity - sum(n * k for n, k in pieces), []).append(kind)

    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and m + n <= capacity and left[m] > (m == n)), None)
            if mate is None:
                opened(left[n], (n, 1))
                left[n] = 0
            elif mate == n:
                opened(left[n] // 2, (n, 2))
                left[n] %= 2
            else:
                number = min(left[n], left[mate])
                opened(number, (n, 1), (mate, 1))
                left[n] -= number
                left[mate] -= number

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= n):
            fit = gap // n
            while left[n] and gaps[gap]:
                kind = gaps[gap].pop()
                number = min(kind[0], left[n] // fit) or 1
                copies = min(fit, left[n])
                if number < kind[0]:
                    rest = [kind[0] - number, list(kind[1])]
                    kinds.append(rest)
                    gaps[gap].append(rest)
                    kind[0] = number
                kind[1].append((n, copies))
                left[n] -= number * copies
                gaps.setdefault(gap - n * copies, []).append(kind)
            if not left[n]:
                break
        fit = capacity // n
        if left[n] >= fit:
            opened(left[n] // fit, (n, fit))
        if left[n] % fit:
            opened(1, (n, left[n] % fit))
        left[n] = 0

    slots, rank, sequence = [], {}, 0
    for number, pieces in kinds:
        offset = 0
        for n, copies in pieces:
            slots.append(Slot(n, rank.get(n, 0), number * copies, copies, sequence, offset))
            rank[n] = rank.get(n, 0) + number * copies
            offset += n * copies
        sequence += number
    return slots


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of whole texts; only documents above the capacity are cut."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, i, at, len(part), zlib.crc32(part.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).select("doc_id", F.encode("text", "UTF-8")).mapInArrow(run, schema)


def place(rows: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length``."""
    rows = settle(rows.withColumn("_part", F.spark_partition_id()))
    # a row for each length and part of the input, however often the length occurs
    counts = settle(rows.groupBy("length", "_part").count())
    slots = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count"))
    order = Window.partitionBy("_part", "length").orderBy(*(c for c in rows.columns if c not in ("_part", "length")))
    ranked = rows.withColumn("_nth", F.row_number().over(order) - 1).join(before.drop("count"), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth"))

    slots.sort()
    table = np.asarray(slots, "i8").reshape(-1, 6)
    wide = 1 << 44  # more than pieces of one length
    keys = table[:, 0] * wide + table[:, 1]
    columns = [c for c in rows.columns if c != "_part"]
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in columns) + ", sequence_id long, offset long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank, length = frame["_rank"].to_numpy("i8"), frame["length"].to_numpy("i8")
            at = table[np.searchsorted(keys, length * wide + rank, "right") - 1]
            nth = rank - at[:, 1]
            out = frame[columns].copy()
            out["sequence_id"] = at[:, 4] + nth // at[:, 3]
            out["offset"] = at[:, 5] + nth % at[:, 3] * length
            yield out

    return ranked.select(*columns, "_rank").mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pieces of all documents with their places in as few sequences as the plan finds."""
    return place(pieces(docs, tokenizer, end_id, capacity), capacity)
