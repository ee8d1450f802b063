"""Operator 5: near copies by Jaccard similarity of word n-grams, with MinHash LSH.

A text is the set of its ``size``-word shingles (hashes of 64 bits); a text of fewer
words has one shingle, all its words.  Texts with equal sets, the empty one
included, are copies and become one node.

Plain banding: each node has ``trees`` bands of minimum hashes.  A band is as long, up to ``length``, as
it may be for two nodes at the threshold to meet in some band with the target recall (``depth``).
Nodes with an equal band are linked to the least of them, not to each other, a node of several bands to the
least of those; the connected parts of that graph are the candidates.

Candidates are verified exactly, inside numpy, on the counts of shared
shingles.  Small parts fill a bin together; a part of more than ``most`` nodes is cut
into slices, and each pair of slices is a group by itself, so no group grows with
the part and no pair is a row.  Every pair of a part is compared, and no pair of two
parts, so the links of a node don't depend on what else is in its bin.

Result: one row for each document: ``class_id`` (least ``doc_id`` connected
by links), ``n_links`` (other documents at the threshold or above, copies
included) and ``n_copies`` (documents of the same set, itself included).
Missing text is empty.  Repeated rows are copies.  A missing ``doc_id`` is a
document as others are, but names a class only if all its ids are missing.  An
empty table has no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle
from .blocks import FACTORS, Docs, mixed
from .common import SPACES, text_of, texts
from .components import components
from .substring_dedup import Windows, hashed_words

CHUNK = 3_000_000
WHITE = SPACES.encode()


def depth(threshold: float, trees: int, length: int, recall: float) -> int:
    """The longest band by which enough pairs at the threshold meet in at least one of ``trees``."""
    size = length
    while size > 1 and 1 - (1 - threshold**size) ** trees < recall:
        size -= 1
    return size


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    ids, found = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
    at = 0
    while at < len(ids):
        stop, taken = at, 0
        while stop < len(ids) and (taken < CHUNK or stop == at):
            taken += len(found[stop])
            stop += 1
        yield list(range(at, stop)), found[at:stop]
        at = stop


def shingle_sets(found: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    windows = Windows(Docs(np.zeros(len(found), np.int64), found), size)
    cuts = np.searchsorted(windows.doc, np.arange(len(found) + 1))
    out = []
    for k, text in enumerate(found):
        own = windows.one[cuts[k] : cuts[k + 1]]
        if not len(own) and text.strip(WHITE):
            # all its words, fewer than a window has
            words = hashed_words([text], 0)[0]
            with np.errstate(over="ignore"):
                own = mixed((words * FACTORS[1, : len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
        out.append(np.unique(own))
    return out


def set_key(hashes: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return mixed(np.asarray([hashes.sum(dtype=np.uint64) ^ np.uint64(len(hashes)), mixed(hashes ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)], np.uint64)).tobytes()


def signatures(docs: DataFrame, size: int, trees: int, prefix: int) -> DataFrame:
    """``doc_id, text_key, node`` (key of the shingle set) ``, labels``: a hash of each band."""
    salt = np.random.default_rng(7).integers(1, 2**63, (trees, prefix), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, found in _chunks(batch):
                sets = shingle_sets(found, size)
                full = [k for k, s in enumerate(sets) if len(s)]
                labels: list = [[]] * len(sets)
                if full:
                    every = np.concatenate([sets[k] for k in full])
                    starts = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
                    keys = np.zeros((trees, len(full)), np.uint64)
                    for t in range(trees):
                        for d in range(prefix):
                            keys[t] = mixed(keys[t] * np.uint64(31) + np.minimum.reduceat((every ^ salt[t, d]) * np.uint64(0x9E3779B97F4A7C15), starts))
                    for k, own in zip(full, keys.T.view(np.int64) if keys.flags.f_contiguous else np.ascontiguousarray(keys.T).view(np.int64), strict=True):
                        labels[k] = own.tolist()
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), batch.column("text_key").take(pa.array(rows)), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(labels, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "node", "labels"])

    rows = texts(docs).select("doc_id", F.encode("text", "UTF-8").alias("text"), F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, node binary, labels array<long>")


def shared_counts(sets: list[np.ndarray], common: int = 48) -> np.ndarray:
    """For each two sets, how many elements they share. Elements of many sets go through matrix products."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, element, times = np.unique(np.concatenate(sets) if n else np.zeros(0), return_inverse=True, return_counts=True)
    order = np.argsort(element, kind="stable")
    owner, times = owner[order], times
    begin = np.cumsum(times) - times
    out = np.zeros((n, n), np.int32)
    for k in range(2, common + 1):
        starts = begin[times == k]
        if len(starts):
            rows = owner[starts[:, None] + np.arange(k)]
            for a in range(k - 1):
                flat = (rows[:, a, None] * n + rows[:, a + 1 :]).ravel()
                where, many = np.unique(flat, return_counts=True)
                out.ravel()[where] += many.astype(np.int32)
    out += out.T
    often = np.flatnonzero(times > common)
    for at in range(0, len(often), 2048):
        part = often[at : at + 2048]
        there = np.zeros((n, len(part)), np.float32)
        for c, e in enumerate(part):
            there[owner[begin[e] : begin[e] + times[e]], c] = 1
        out += np.rint(there @ there.T).astype(np.int32)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 .. n - 1 that each is connected with by the edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        rows = {}
        for node, copies, side, label, data in zip(*(table.column(c).to_pylist() for c in ("node", "copies", "side", "label", "shingles")), strict=True):
            rows[node] = (copies, side, np.frombuffer(data, "<u8"), label)
        nodes = sorted(rows)
        copies = np.asarray([rows[x][0] for x in nodes], np.int64)
        side = np.asarray([rows[x][1] for x in nodes])
        both = shared_counts([rows[x][2] for x in nodes])
        sizes = np.diagonal(both)
        near = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        np.fill_diagonal(near, False)
        near &= both > 0
        # parts that share a bin
        _, part = np.unique(np.asarray([rows[x][3].hex() for x in nodes]), return_inverse=True)
        near &= part[:, None] == part[None, :]
        if side.max() == 0:
            links, root = near @ copies, _roots(len(nodes), *np.nonzero(np.triu(near)))
        else:
            # two slices of a large part: the pairs between them only.  What is joined within a slice, its own group
            # says; here one edge is enough to join two such parts of slices
            within = side[:, None] == side[None, :]
            inner = _roots(len(nodes), *np.nonzero(np.triu(near & within)))
            near &= ~within
            a, b = np.nonzero(np.triu(near))
            links, root = near @ copies, np.where(inner == np.arange(len(nodes)), _roots(len(nodes), inner[a], inner[b]), np.arange(len(nodes)))
        return pa.table({"node": pa.array(nodes, pa.binary()), "links": pa.array(links, pa.int64()), "root": pa.array([nodes[r] for r in root.tolist()], pa.binary())})

    return run


def classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, trees: int = 12, length: int = 8, recall: float = 0.9995, most: int = 1000) -> DataFrame:
    """``doc_id, text_key, class_node, class_id, n_links, n_copies`` of every document."""
    signed = settle(signatures(docs, size, trees, depth(threshold, trees, length, recall)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key"))
    nodes = signed.groupBy("node").agg(first.alias("_first"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels"))
    nodes = settle(nodes.select("node", F.col("_first.doc_id").alias("doc_id"), F.col("_first.text_key").alias("text_key"), "copies", "labels"))

    below = nodes.select("node", F.posexplode("labels").alias("tree", "label"))
    tops = below.groupBy("tree", "label").agg(F.min("node").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # a node of several bands joins the least of their least ones, and so do the others: about one edge for each node
    stars = below.join(tops, ["tree", "label"]).groupBy("node").agg(F.min("top").alias("b"), F.collect_set("top").alias("tops"))
    ends = F.explode(F.array_union(F.array("node"), "tops"))
    parts = components(stars.select(ends.alias("a"), "b").filter("a <> b").distinct())

    # slices of large parts, bins of small ones
    counts = parts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("slices", F.ceil(F.col("n") / most).cast("int"))
    counts = settle(counts)
    small = counts.filter("slices = 1").agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-small // most))
    dealt = parts.join(counts, "label").withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), "slices").cast("int"))
    other = F.explode(F.when(F.col("slices") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.withColumn("other", other).select(
        "node", "label",
        F.when(F.col("slices") == 1, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.xxhash64("label", F.least("slice", "other"), F.greatest("slice", "other"))).alias("group"),
        F.when(F.col("slices") == 1, F.lit("bin")).otherwise(F.hex("label")).alias("part"),
        # 0: all pairs within one slice; 1 and 2: the two slices whose pairs count
        F.when((F.col("slices") == 1) | (F.col("slice") == F.col("other")), F.lit(0)).when(F.col("slice") < F.col("other"), F.lit(1)).otherwise(F.lit(2)).alias("side"),
    )
    dealt = settle(dealt)

    # one document of each node: a missing id alone doesn't name one, its text does
    unknown = F.lit(-(2**63))
    wanted = parts.join(nodes.select("node", "doc_id", "text_key", "copies"), "node").select("node", "copies", F.coalesce("doc_id", unknown).alias("_id"), F.col("text_key").alias("_key"))
    rows = texts(docs).select(F.coalesce("doc_id", unknown).alias("_id"), F.xxhash64("text").alias("_key"), F.encode("text", "UTF-8").alias("text"))
    rows = rows.join(wanted, ["_id", "_key"]).select("_id", "text", "node", "copies")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns(["doc_id", "text", "node", "copies"])
            for places, found in _chunks(batch):
                sets = shingle_sets(found, size)
                part = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("copies"), pa.array([set_key(s) == n for s, n in zip(sets, part.column("node").to_pylist(), strict=True)]), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                    ["node", "copies", "own", "shingles"])

    sets = rows.mapInArrow(shingled, "node binary, copies long, own boolean, shingles binary").filter("own").drop("own")
    checked = sets.join(dealt, "node").groupBy("part", "group").applyInArrow(_verify(threshold), "node binary, links long, root binary")
    checked = settle(checked)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(checked.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))

    of = nodes.select("node", "doc_id", "copies").join(joined, "node", "left").join(links, "node", "left")
    of = of.withColumn("_class", F.coalesce("label", "node"))
    # written, so that the join deals both sides anew and a large class can be split
    least = settle(of.groupBy("_class").agg(F.min("doc_id").alias("class_id")))
    of = of.join(least, "_class").select("node", F.col("_class").alias("class_node"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return signed.drop("labels").join(of, "node").select("doc_id", "text_key", "class_node", "class_id", "n_links", "n_copies")


def near_copies(docs: DataFrame, **parameters: float) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` of every document; parameters as of ``classes``."""
    return classes(docs, **parameters).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, **parameters: float) -> DataFrame:
    """One document of each class, the one with the least ``doc_id``, with all its columns."""
    chosen = classes(docs, **parameters).groupBy("class_node").agg(F.min(F.struct("doc_id", "text_key")).alias("_one"))
    chosen = chosen.select(F.col("_one.doc_id").alias("_id"), F.col("_one.text_key").alias("_key"))
    rows = docs.select(docs["doc_id"].cast("long").alias("_own"), F.xxhash64(text_of(docs)).alias("_text"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    # equal ids and texts: any one of them
    nth = Window.partitionBy("_id", "_key").orderBy("_id")
    rows = rows.join(chosen, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")))
    return rows.withColumn("_nth", F.row_number().over(nth)).filter("_nth = 1").select("_row.*")
