"""Operator 2: SimHash fingerprints and the search for near ones.

The terms of a text are its pairs of neighbouring words (its one word, if it has
but one).  A term weighs as often as it occurs.  Its 64-bit hash votes on
the 64 bits; a bit is set if more than half of the weight is for it.  Two bit
counts share one long, so a text needs 32 sums, built where the words are.
The likeness of two fingerprints is the share of equal bits.

``near_pairs`` finds all fingerprints within a Hamming radius by block
tables: 64 bits are cut into ``blocks``, and a table for each choice of
``blocks - radius`` of them is keyed by these; two fingerprints within the
radius agree on at least one table's blocks.  Equal fingerprints are one row there,
and a pair is taken from the first table that has it only.

Missing text is empty text, which has no terms and a fingerprint of zeros.
Repeated rows follow each other in the order of their texts; a missing
``doc_id`` comes first.  The next document of the last one is the first
one.  An empty table has no rows.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .common import texts
from .quality import words_of

HALVES = 32


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, nth, doc_id, text, next_id, next_text``, where rows are dealt by ranges of ``doc_id``.

    ``bucket, nth`` tells rows apart.  The ranges come from ``buckets`` quantiles of the ids.
    """
    rows = texts(docs)
    bounds = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    edges = F.array(*(F.lit(b) for b in sorted({*bounds}))) if bounds else F.array().cast("array<long>")
    rows = rows.withColumn("bucket", F.coalesce(F.size(F.filter(edges, lambda b: b < F.col("doc_id"))), F.lit(0)))
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    ahead = F.lead(F.struct("doc_id", "text")).over(order)
    rows = rows.select("bucket", "doc_id", "text", F.row_number().over(order).alias("nth"), ahead.alias("_next"))
    first = rows.filter("nth = 1").select(F.col("bucket").alias("_first_of"), F.struct("doc_id", "text").alias("_first"))
    # one row for each bucket
    follows = settle(rows.filter("nth = 1").select("bucket"))
    everywhere = Window.orderBy("bucket")
    whole = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = follows.select("bucket", F.coalesce(F.lead("bucket").over(everywhere), F.min("bucket").over(whole)).alias("_first_of"))
    first = follows.join(first, "_first_of").select("bucket", "_first")
    rows = rows.join(first, "bucket")
    following = F.coalesce("_next", "_first")
    return rows.select("bucket", "nth", "doc_id", "text", following["doc_id"].alias("next_id"), following["text"].alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last half of a text (rounded down) replaced by as many first characters of another, or all it has."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(following, half))


def terms(text: Column) -> Column:
    """Hashes of a text's terms."""
    def pairs(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 2, F.transform(words, lambda w: F.xxhash64(w))).otherwise(
            F.transform(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(words, i + 1))))

    return pairs(text)


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``fp`` (long): a fingerprint of the ``text`` of each key."""
    rows = rows.withColumn("_words", words_of(F.col("text"))).select(*keys, terms(F.col("_words")).alias("_terms"))
    rows = rows.select(*keys, F.explode_outer("_terms").alias("h"))
    two = F.lit(0x100000001)
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(two)).alias(f"b{i}") for i in range(HALVES)]
    votes = rows.groupBy(*keys).agg(F.count("h").alias("_n"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(HALVES):
        low, high = F.col(f"b{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"b{i}", 32)
        fp = fp.bitwiseOR(F.when(2 * low > F.col("_n"), F.lit(1 << i)).otherwise(F.lit(0)))
        fp = fp.bitwiseOR(F.when(2 * high > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), i + 32)).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64.0


def near_pairs(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """``fp, other, distance, n``: each distinct query fingerprint with each one of ``prints`` (``fp``) within the radius, itself
    included, how many bits differ, and how many rows of ``prints`` have the other one."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = [signed(sum(c)) for c in combinations(masks, blocks - radius)]
    mask = F.array(*(F.lit(t).cast("long") for t in tables))

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(len(tables) - 1))))
        return rows.withColumn("_key", F.col(name).bitwiseAND(F.get(mask, F.col("_t"))))

    every = dealt(prints.groupBy(F.col("fp").alias("other")).agg(F.count(F.lit(1)).alias("n")), "other")
    asked = dealt(queries.select("fp").distinct(), "fp")
    apart = F.col("fp").bitwiseXOR(F.col("other"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(t).cast("long")) == 0, F.lit(i)) for i, t in enumerate(tables)))
    near = (asked["_t"] == every["_t"]) & (asked["_key"] == every["_key"]) & (F.bit_count(apart) <= radius) & (first == asked["_t"])
    return asked.join(every, near).select("fp", "other", F.bit_count(apart).alias("distance"), "n")


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """``fp, n_near``: for each query fingerprint, rows of ``prints`` (``fp``) within the radius, itself included."""
    return near_pairs(prints, queries, radius, blocks).groupBy("fp").agg(F.sum("n").alias("n_near"))


def near_documents(docs: DataFrame, radius: int = 3, blocks: int = 6) -> tuple[DataFrame, DataFrame]:
    """Which documents have near fingerprints: ``fp, other, distance`` of distinct ones (``fp < other``), and ``doc_id, fp``.

    Documents of one fingerprint are each near to all of its pairs, and to each other at distance 0.
    """
    rows = texts(docs).withColumn("_text", F.xxhash64("text"))
    members = settle(fingerprints(rows, ["doc_id", "_text"]).select("doc_id", "fp"))
    return near_pairs(members, members, radius, blocks).filter("fp < other").drop("n"), members


def compare_with_edited(docs: DataFrame, every: int = 50, radius: int = 3) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses.

    ``n_near``: for documents whose id is divisible by ``every``, how many other
    documents have a fingerprint within the radius; missing for others.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, buckets)
    rows = rows.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    keys = ["bucket", "nth", "doc_id", "next_id", "n_chars", "edited_sha256"]
    rows = rows.select(
        "bucket", "nth", "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text")), F.struct(F.lit(1).alias("v"), F.col("_edited").alias("text")))).alias("_of"),
    )
    prints = fingerprints(rows.select(*keys, "_of.v", "_of.text"), [*keys, "v"])
    prints = settle(prints.groupBy(*keys).agg(F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("edited_fp")))
    # the next row is the next of its bucket, or the first of the next bucket
    last = prints.groupBy("bucket").agg(F.max("nth").alias("_last"))
    everywhere = Window.orderBy("bucket")
    whole = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = last.select("bucket", "_last", F.coalesce(F.lead("bucket").over(everywhere), F.min("bucket").over(whole)).alias("_follows"))
    here = prints.join(last, "bucket")
    here = here.withColumns({
        "_b": F.when(F.col("nth") == F.col("_last"), F.col("_follows")).otherwise(F.col("bucket")),
        "_n": F.when(F.col("nth") == F.col("_last"), F.lit(1)).otherwise(F.col("nth") + 1),
    })
    following = prints.select(F.col("bucket").alias("_b"), F.col("nth").alias("_n"), F.col("fp").alias("next_fp"))
    here = here.join(following, ["_b", "_n"])
    near = near_counts(prints.select("fp"), prints.filter(F.col("doc_id") % every == 0).select("fp"), radius)
    here = here.join(near, "fp", "left")
    return here.select(
        "doc_id", "n_chars", "edited_sha256",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.lpad(F.lower(F.hex("edited_fp")), 16, "0").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("n_near") - 1).alias("n_near"),
    )
