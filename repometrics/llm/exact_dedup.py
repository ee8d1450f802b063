"""Operator 12: exact duplicates by an extendible-hash index.

Texts are compared without the characters ``[\\x20\\x09-\\x0D]``; 64 bits of hash of what is left are the key.

Index: the first ``depth`` bits of a key are its slot of the directory.  Doubling the directory (one more bit)
splits the buckets that hold more than ``capacity`` bytes of text, so a bucket is the shortest prefix whose texts fit,
a range of keys.  What still doesn't fit at full depth holds a large group of copies; it gets overflow pages, to
which its documents are dealt.  Keys, directory and entries are files in the shared checkpoint folder; the
directory is broadcast only if it has at most ``SLOTS`` slots, which its depth says, else joined.

Owners: each page goes to one task, which sorts it by key and text.  Documents of one key are chained, and within a chain
those of equal bytes form a group; no digest decides.  Groups of a bucket with one page are complete.  For a paged bucket each
page sends one document of each group on; these few are compared again, byte by byte, and every page gets the answer.
A text is shuffled once, however large its group is.  All steps are columns.

Of equal texts the one with the most characters (as given) stays, then that with the least ``doc_id``, a missing one last; of
repeated rows one.  Missing text is empty; empty texts are equal to each other.  A text of any length is one entry.  An empty
table has no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .common import SPACES, text_of

#: A directory with more slots is not broadcast (a slot takes some 40 bytes).
SLOTS = 1 << 20
LEAST_CAPACITY, MOST_CAPACITY = 1 << 16, 1 << 28
#: How much shallower than the full depth a bucket may be; the average bucket there is four times too full.
SHALLOWER = 3


class Directory(NamedTuple):
    depth: int
    #: ``slot, bucket, pages``
    slots: DataFrame


def bare(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def slot_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int | None = None) -> Directory:
    """Buckets of at most ``capacity`` bytes for ``keys`` (``key, bytes``).

    By default a bucket is a quarter of a shuffle partition's share, within bounds.
    """
    keys = settle(keys)
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    if capacity is None:
        partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        capacity = min(max(total // (4 * partitions), LEAST_CAPACITY), MOST_CAPACITY)
    depth = (-(-total // capacity)).bit_length() + 1 if total > capacity else 0
    cells = keys.groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.sum("bytes").alias("bytes"))
    least = max(0, depth - SHALLOWER)
    bucket, pages = F.col("slot"), F.greatest(F.lit(1), F.ceil(F.col("bytes") / capacity)).cast("int")
    for d in reversed(range(least, depth)):
        prefix = F.shiftright("slot", depth - d)
        fits = F.col(f"fill_{d}") <= capacity
        cells = cells.withColumn(f"fill_{d}", F.sum("bytes").over(Window.partitionBy(prefix)))
        bucket, pages = F.when(fits, F.shiftleft(prefix, depth - d)).otherwise(bucket), F.when(fits, F.lit(1)).otherwise(pages)
    return Directory(depth, settle(cells.select("slot", bucket.alias("bucket"), pages.alias("pages"))))


def entries(docs: DataFrame, capacity: int | None = None, key: Column | None = None) -> DataFrame:
    """The index: ``doc_id, n_chars, key, digest, bucket, page, pages`` and a document's place in its page.

    ``chain``: number of its text among the texts of its key; ``nth``: its place among documents of that text, ``first`` those of
    the first one, ``size`` how many there are; ``text``: only of the first one, and only in paged buckets.
    ``key``: another hash of ``bare`` (tests use a weak one).
    """
    key = F.xxhash64("bare") if key is None else key
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), bare(text).alias("bare")).withColumn("key", key)
    depth, slots = build_directory(rows.select("key", (F.octet_length("bare") + 16).cast("long").alias("bytes")), capacity)
    if depth <= SLOTS.bit_length() - 1:
        slots = F.broadcast(slots)
    rows = rows.withColumn("slot", slot_of(F.col("key"), depth)).join(slots, "slot")
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "key", "bare", "bucket", "pages",
        F.when(F.col("pages") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "text"), "pages")).cast("int").alias("page"))
    equal = Window.partitionBy("bucket", "page", "key", "bare")
    best = equal.orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    rows = rows.repartition("bucket", "page").select(
        "doc_id", "n_chars", "key", "bucket", "page", "pages", "bare",
        F.row_number().over(best).alias("nth"), F.first(F.struct("doc_id", "n_chars")).over(best).alias("first"), F.count(F.lit(1)).over(equal).alias("size"),
        F.dense_rank().over(Window.partitionBy("bucket", "page", "key").orderBy("bare")).alias("chain"))
    return settle(rows.select(
        "doc_id", "n_chars", "key", F.sha2(F.col("bare").cast("binary"), 256).alias("digest"), "bucket", "page", "pages", "nth", "first", "size", "chain",
        F.when((F.col("pages") > 1) & (F.col("nth") == 1), F.col("bare")).alias("text")))


def groups(docs: DataFrame, capacity: int | None = None, key: Column | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    index = entries(docs, capacity, key)
    whole = index.filter("pages = 1").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("nth") == 1).alias("kept"), F.col("digest").alias("text_sha256"))

    # one document of each text and page
    paged = index.filter("pages > 1")
    sent = paged.filter("nth = 1").select("bucket", "page", "key", "chain", "text", "size", F.struct(
        (-F.col("first.n_chars")).alias("longest"), F.col("first.doc_id").isNull().alias("unknown"), F.col("first.doc_id").alias("doc_id"), F.col("page").alias("page")).alias("first"))
    texts = settle(sent.groupBy("key", "text").agg(F.sum("size").alias("group_size"), F.min("first").alias("best")))
    # a key of one text needs no further comparison
    chains = texts.groupBy("key").agg(F.count(F.lit(1)).alias("chains"))
    texts = texts.join(chains, "key").select("key", F.when(F.col("chains") > 1, F.col("text")).alias("_text"), "group_size", "best")
    answers = sent.join(texts, "key").filter("_text IS NULL OR _text = text").select("bucket", "page", "key", "chain", "group_size", "best")
    split = paged.join(answers, ["bucket", "page", "key", "chain"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", ((F.col("nth") == 1) & (F.col("page") == F.col("best.page"))).alias("kept"), F.col("digest").alias("text_sha256"))
    return whole.unionByName(split)
