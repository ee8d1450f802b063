"""Operator 7: repeated windows of words, with a count-min prefilter.

A window is ``size`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document.
First pass: each block of documents counts its windows in its part of a count-min
sketch; merged, a cell tells at least how many blocks hold a window of it.
Counts are never too low, so a window whose cell is used once occurs once.
Second pass: only windows of cells used more often are grouped,
exactly: by 64 bits of hash (of the hashes of its words, each 64 bits) beside the bits that chose the key range.  The least
``doc_id`` of a group decides; each word covered by a window that starts in a
document with a smaller ``doc_id`` is removed.

Windows are judged on the input.  Rows with equal ``doc_id`` don't remove each other's
words; a missing ``doc_id`` is smaller than any.  Missing text has no words.
An empty table has no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .blocks import ANSWER, FACTORS, FRAGMENT, Cells, Docs, answers, cells_of, fragments, id_type, in_blocks, merge_sketches, mixed, read_docs, sketch_rows, to_table


class Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def hashed_words(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of hash of every word, and how many words each text has; a distinct word is hashed once."""
    numbers, found = Numbers(), []
    for text in texts:
        words = text.split()
        found.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in numbers), np.uint64, len(numbers))
    return hashes[np.concatenate(found)] if len(numbers) else hashes, np.asarray([len(x) for x in found], np.int64)


class Windows:
    """All windows of a block's documents."""

    def __init__(self, docs: Docs, size: int, seed: int = 0):
        words, lengths = hashed_words(docs.texts, seed)
        #: index of a document's first word, and one more
        self.first = np.concatenate(([0], np.cumsum(lengths)))
        n = max(0, len(words) - size + 1)
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(size):
            one += words[k : k + n] * FACTORS[0, k]
            two += words[k : k + n] * FACTORS[1, k]
        doc = np.repeat(np.arange(len(docs.texts)), np.diff(self.first))
        whole = doc[:n] == doc[size - 1 :][:n]
        #: place of each window's first word, its document, and two hashes
        self.at = np.flatnonzero(whole)
        self.doc = doc[self.at]
        self.one, self.two = mixed(one[self.at]), mixed(two[self.at])
        self.words = len(words)


class Groups:
    """Distinct windows of a block that may be repeated."""

    def __init__(self, windows: Windows, own: Cells, parts: int, counts: np.ndarray):
        shared = counts[own.of_key] > 1
        self.places = np.flatnonzero(shared | (own.counts[own.of_key] > 1))
        self.hashes, first, self.of_place = np.unique(windows.two[self.places], return_index=True, return_inverse=True)
        first = self.places[first]
        self.doc = windows.doc[first]
        part = (own.cells[own.of_key[first]] >> np.uint64(32)).astype(np.int64)
        #: those that other blocks may hold too, by part
        sent = np.flatnonzero(shared[first])
        self.sent = sent[np.argsort(part[sent], kind="stable")]
        self.parts = part[self.sent]


def _lesser(table: pa.Table) -> pa.Table:
    """For each window sent: does another block have it in a smaller document?"""
    hashes, ids = [], []
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        n = len(data) // (8 + kind)
        hashes.append(np.frombuffer(data, "<u8", n))
        ids.append(np.frombuffer(data, "<u4" if kind == 4 else "<i8", n, 8 * n).astype(np.int64))
    h, d = np.concatenate(hashes), np.concatenate(ids)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    h, least = h[first], d[first]
    part = table.column("part")[0].as_py()
    return to_table(
        (b, part, 1, (own > least[np.searchsorted(h, x)]).astype(np.uint8).tobytes())
        for b, x, own in zip(table.column("block").to_pylist(), hashes, ids, strict=True)
    )


def remove_repeats(docs: DataFrame, size: int = 13, block_bytes: int = 8_000_000, carried: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``. ``seed``: of the words' hashes; a secret one where words may be chosen to collide.

    With names of columns to carry along also these, as ``_0``, ``_1``, ..., and the
    ``kept`` text: words joined by one space, or the text itself if nothing is removed.
    """
    rows, blocks = in_blocks(docs, block_bytes, carried or ())
    parts = -(-blocks // 2)

    def sketch(table: pa.Table) -> pa.Table:
        windows = Windows(read_docs(table), size, seed)
        return to_table(sketch_rows(table.column("block")[0].as_py(), cells_of(windows.one, parts)))

    def candidates(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_table([])
        found = read_docs(left)
        windows = Windows(found, size, seed)
        groups = Groups(windows, own := cells_of(windows.one, parts), parts, np.frombuffer(answers(right, 0), np.uint8))
        ids = found.ids[groups.doc[groups.sent]]
        kind = id_type(ids)
        return to_table(fragments(key[0].as_py(), np.dtype(kind).itemsize, groups.parts, [groups.hashes[groups.sent], ids.astype(kind)]))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    with_text = carried is not None
    if with_text:
        kinds = dict(docs.dtypes)
        schema += ", kept string" + "".join(f", _{k} {kinds[c]}" for k, c in enumerate(carried))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = read_docs(left) if left.num_rows else Docs(np.zeros(0, np.int64), [])
        windows = Windows(found, size, seed)
        groups = Groups(windows, cells_of(windows.one, parts), parts, np.frombuffer(answers(right, 0), np.uint8))
        lesser = np.zeros(len(groups.hashes), bool)
        lesser[groups.sent] = np.frombuffer(answers(right, 1), np.uint8) > 0
        again = found.ids[windows.doc[groups.places]] > found.ids[groups.doc[groups.of_place]]
        starts = windows.at[groups.places[lesser[groups.of_place] | again]]
        cover = np.zeros(windows.words + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + size, -1)
        kept = np.cumsum(cover[:-1]) == 0
        out = []
        for k, text in enumerate(found.texts):
            own = kept[windows.first[k] : windows.first[k + 1]]
            words = text.split()
            whole = bool(own.all())
            left_over = b" ".join(words if whole else compress(words, own.tolist()))
            out.append((len(own), len(own) - int(own.sum()), hashlib.sha256(left_over).hexdigest(), (text if whole else left_over).decode() if with_text else None))
        n, gone, sha, kept_text = zip(*out, strict=True) if out else ((), (), (), ())
        columns = {"doc_id": found.id_column(), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            columns["kept"] = pa.array(kept_text, pa.string())
            columns |= {name: left.column(name).take(pa.array(found.rows, pa.int64())) for name in left.column_names if name[0] == "_"}
        return pa.table(columns)

    estimates = merge_sketches(rows.groupBy("block").applyInArrow(sketch, FRAGMENT))
    exact = rows.groupBy("block").cogroup(estimates.groupBy("block")).applyInArrow(candidates, FRAGMENT).groupBy("part").applyInArrow(_lesser, ANSWER)
    return rows.groupBy("block").cogroup(estimates.unionByName(exact).groupBy("block")).applyInArrow(finish, schema)


def clean(docs: DataFrame, size: int = 13, block_bytes: int = 8_000_000) -> DataFrame:
    """All documents with all their columns, repeated words removed from ``text``; ``n_chars`` follows it."""
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, size, block_bytes, carried)
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"_{k}") for k, c in enumerate(carried)}
    if "n_chars" in values:
        values["n_chars"] = F.length("kept").cast(dict(docs.dtypes)["n_chars"])
    return found.select(*(values[c].alias(c) for c in docs.columns))
