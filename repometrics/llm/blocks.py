"""Documents in blocks, and questions that blocks ask each other.

The repeat operators look at all windows of all texts.  A row per window would
be many times the text, so a window stays a few bytes in an array.
``in_blocks`` deals documents out by hash into blocks of about
``block_bytes``.  A block sorts its keys, cuts them by key range
(``part``) and sends each range one array.  A range compares the arrays of all blocks and sends
each one an answer per key.  A key is sent once by a block, however often it
occurs there, so a key of a third of all rows makes no more than one entry for
each block.  The texts are shuffled once; later steps reuse that shuffle.
Blocks and ranges are counted from the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_of

#: Stands for a missing id; it comes first.
NO_ID = -(2**63)
ANSWER = "block long, part int, kind int, data binary"
FRAGMENT = ANSWER

_random = np.random.default_rng(20_240_501)
_LETTER = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_random.integers(1, 2**62)) * 8 + 5
_UNBASE = pow(_BASE, -1, 1 << 64)
FACTORS = _random.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    known = 1
    while known < n:
        step = min(known, n - known)
        out[known : known + step] = out[:step] * np.uint64(pow(base, known, 1 << 64))
        known += step
    return out[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """Hashes of any ranges of a byte array, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * powers(_BASE, n), out=self._sums[1:])
        self._back = powers(_UNBASE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._back[start]
        return mixed(raw + (end - start).astype(np.uint64) * FACTORS[0, 63])

    def fixed(self, size: int) -> np.ndarray:
        """Of the range of ``size`` bytes at each place where it ends inside."""
        n = len(self._sums) - size
        return mixed((self._sums[size:] - self._sums[:n]) * self._back[:n]) if n > 0 else np.zeros(0, np.uint64)


class Docs(NamedTuple):
    """The documents of a block in the order of ``doc_id`` and text."""

    ids: np.ndarray      # 64-bit, NO_ID for a missing one
    texts: list[bytes]
    rows: list[int] = []  # of the table, in this order

    def id_column(self) -> pa.Array:
        return pa.array([None if x == NO_ID else x for x in self.ids.tolist()], pa.int64())


def read_docs(table: pa.Table) -> Docs:
    ids, found = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    rows = sorted((NO_ID if i is None else i, t, k) for k, (i, t) in enumerate(zip(ids, found, strict=True)))
    return Docs(np.asarray([i for i, _, _ in rows], np.int64), [t for _, t, _ in rows], [k for _, _, k in rows])


def in_blocks(docs: DataFrame, block_bytes: int, carried: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """``block, doc_id, text`` (bytes), columns carried along as ``_0``, ``_1``, ..., and the number of blocks."""
    extra = [docs[f"`{c}`"].alias(f"_{k}") for k, c in enumerate(carried)]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), *extra)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", F.encode("text", "UTF-8").alias("text"), *(f"_{k}" for k in range(len(carried))))
    return rows, blocks


def fragments(block: int, kind: int, parts: np.ndarray, arrays: Iterable[np.ndarray]) -> Iterator[tuple]:
    """Rows of ``FRAGMENT``: for each part, the slices of the arrays. ``parts`` is sorted."""
    arrays = list(arrays)
    cuts = np.flatnonzero(np.diff(parts)) + 1
    edges = [0, *cuts.tolist(), len(parts)] if len(parts) else []
    for a, b in zip(edges, edges[1:]):
        yield block, int(parts[a]), kind, b"".join(x[a:b].tobytes() for x in arrays)


def to_table(rows: Iterable[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "part", "kind", "data"])


def answers(table: pa.Table, kind: int) -> bytes:
    """The answers of one kind, parts in ascending order."""
    rows = zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True)
    return b"".join(d for _, d in sorted((p, d) for k, p, d in rows if k == kind))


class Cells(NamedTuple):
    """A block's own part of the count-min sketch.

    The sketch has ``parts`` times 2**32 cells, so it widens with the input
    and few windows share one.  A block holds its non-empty cells.
    """

    cells: np.ndarray     # part * 2**32 + cell, sorted
    of_key: np.ndarray    # which of them a key counts in
    counts: np.ndarray    # keys of this block in each


def cells_of(keys: np.ndarray, parts: int) -> Cells:
    high, low = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    cells, of_key, counts = np.unique((high * np.uint64(parts) >> np.uint64(32)) << np.uint64(32) | low, return_inverse=True, return_counts=True)
    return Cells(cells, of_key.astype(np.int64), counts)


def sketch_rows(block: int, own: Cells) -> Iterator[tuple]:
    return fragments(block, 0, (own.cells >> np.uint64(32)).astype(np.int64), [(own.cells & np.uint64(0xFFFFFFFF)).astype("<u4")])


def merge_sketches(sent: DataFrame, hot: int = 255) -> DataFrame:
    """For each block's cell, in how many blocks it is not empty: one byte, ``hot`` at most."""

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() if table.num_rows else 0
        own = [np.frombuffer(x, "<u4") for x in table.column("data").to_pylist()]
        cells, counts = np.unique(np.concatenate(own), return_counts=True)
        counts = np.minimum(counts, hot).astype(np.uint8)
        return to_table((b, part, 0, counts[np.searchsorted(cells, x)].tobytes()) for b, x in zip(table.column("block").to_pylist(), own, strict=True))

    return sent.groupBy("part").applyInArrow(merge, ANSWER)


def id_type(ids: np.ndarray) -> str:
    """The smaller type that holds all ids."""
    return "<u4" if not len(ids) or (ids.min() >= 0 and ids.max() < 1 << 32) else "<i8"
