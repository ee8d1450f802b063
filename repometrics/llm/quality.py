"""Operator 1: quality rules with thresholds that adapt to language and source.

Every measure of a text is made of built-in array and string functions, in
the row itself.  The thresholds come from quantile sketches: one for each
measure, language and source, merged into one for each language and one over all.
A sketch counts values in buckets whose bounds grow by a fixed ratio, so a quantile is within ``ACCURACY`` of the
true one (relative).  Sketches merge by adding counts: limits and verdicts don't depend on how rows lie
in partitions, on order or on repeated tasks.  They are built before rows are shuffled, so a source with a third of all
documents sends one sketch from each task.

For a measure that is bad when high, the limit is
``median + spread * max(median - lower quartile, least)``; only the better half of
a group sets it, so it holds while up to half of the group is bad.  A share
is mostly near zero, where that distance says nothing: its limit is ``median +
spread * max(upper quartile - median, least)``, but goes no more than ``REACH`` of the way from
the median to the most that the share can be, so it can reject in every group.  A
group of n documents gets the mean of its own limit (weight n) and of its
language's (weight ``prior``), which in turn leans on the limit over all, so few
documents never make a limit of their own.  Limits and documents are then joined.

Missing text: no words, so the fixed base rule fails.  Missing language or
source is a group like any other.  Repeated rows are judged each for itself.
An empty table has no rows.  Other columns are kept out of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import SPACES, text_of

#: Measures, each with the smallest distance from the quartile to the median that counts. Above its limit, a text is rejected.
MEASURES = {
    "symbols_per_word": 0.02,
    "mean_word_chars": 0.25,
    "dup_line_share": 0.03,
    "repeat_word_share": 0.03,
}
#: Relative error of a quantile, the ratio of a bucket's bounds, and the bucket of zero.
ACCURACY = 0.005
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
ZERO = -(2**31)
#: Measures that are shares, each with the most it can be where the base rule passes.
SHARES = {"dup_line_share": 1.0, "repeat_word_share": 0.5}
#: How far from the median to the most a limit of a share may go.
REACH = 0.75


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "")


def row_key(docs: DataFrame) -> Column:
    """Hash of all that a verdict depends on: with ``doc_id``, equal only for rows with one verdict."""
    return F.xxhash64(text_of(docs), docs["lang"].cast("string"), F.lit("|"), docs["source"].cast("string"))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, row_key`` and the base measures of whole texts."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("lang"), docs["source"].alias("source"), row_key(docs).alias("row_key"), text_of(docs).alias("text"))
    rows = rows.withColumn("_words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id", "lang", "source", "row_key",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    n = F.col("n_words").cast("int")
    rows = rows.withColumn("_grams", F.transform(
        F.slice("_hashes", 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_hashes", i + 1), F.get("_hashes", i + 2)),
    ))
    # sorted by hash, equal windows are neighbours
    rows = rows.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.sort_array(F.transform("_grams", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    ))
    same = F.filter("_sorted", lambda s, i: (s["x"] == F.get("_sorted", i - 1)["x"]) | (s["x"] == F.get("_sorted", i + 1)["x"]))
    places = F.flatten(F.transform(same, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))
    rows = rows.withColumn("n_lines", F.size("_lines").cast("long"))
    rows = rows.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("long"))
    return rows.drop("_lines", "_hashes", "_grams", "_sorted")


def _shares(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return rows.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols_per_word": F.col("n_symbols") / words,
        "mean_word_chars": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
    })


def bucket_of(value: Column) -> Column:
    """Number of the sketch's bucket that holds a value: its logarithm to the base ``GAMMA``, rounded up."""
    return F.when(value > 0, F.ceil(F.log(value) / math.log(GAMMA)).cast("int")).otherwise(ZERO)


def value_of(bucket: Column) -> Column:
    """The value within ``ACCURACY`` of all that a bucket holds."""
    return F.when(bucket == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), bucket) / (GAMMA + 1))


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: a quantile sketch of each measure of each group, a row for each bucket in use."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in MEASURES)))
    return rows.select("lang", "source", each.alias("_")).groupBy("lang", "source", "_.measure", "_.bucket").agg(F.count(F.lit(1)).alias("n"))


def _limits(buckets: DataFrame, keys: list[str], spread: float) -> DataFrame:
    """``keys``, ``measure, n, limit`` from merged sketches: buckets add up, in any order, to the same counts."""
    merged = buckets.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    # at most some thousand buckets, however many rows
    merged = merged.groupBy(*keys, "measure").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("_buckets"))

    def quantile(q: float) -> Column:
        rank = F.floor(q * (F.col("n") - 1))
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("int").alias("bucket"))
        return value_of(F.aggregate("_buckets", start, lambda s, b: F.struct(
            (s["before"] + b["n"]).alias("before"), F.coalesce(s["bucket"], F.when(s["before"] + b["n"] > rank, b["bucket"])).alias("bucket")), lambda s: s["bucket"]))

    merged = merged.select(*keys, "measure", "n", *(quantile(q).alias(c) for c, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75))))
    limit = F.lit(None).cast("double")
    for m, least in MEASURES.items():
        if m in SHARES:
            own = F.col("mid") + F.least(spread * F.greatest(F.col("high") - F.col("mid"), F.lit(least)), REACH * (SHARES[m] - F.col("mid")))
        else:
            own = F.col("mid") + spread * F.greatest(F.col("mid") - F.col("low"), F.lit(least))
        limit = F.when(F.col("measure") == m, own).otherwise(limit)
    return merged.select(*keys, "measure", "n", limit.alias("limit"))


def limits(rows: DataFrame, spread: float, prior: int) -> DataFrame:
    """``lang, source`` and a limit for each measure, from rows that pass the base rule."""
    buckets = settle(sketches(rows))
    own = _limits(buckets, ["lang", "source"], spread)
    by_lang = _limits(buckets, ["lang"], spread).select(F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), F.col("n").alias("n_lang"), F.col("limit").alias("limit_lang"))
    # one number for each measure
    over_all = F.lit(None).cast("double")
    for row in _limits(buckets, [], spread).collect():
        over_all = F.when(F.col("measure") == row["measure"], row["limit"]).otherwise(over_all)
    both = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure")))

    def lean(n: str, own: Column, wider: Column) -> Column:
        return (F.col(n) * own + prior * wider) / (F.col(n) + prior)

    both = both.select("lang", "source", "measure", lean("n", F.col("limit"), lean("n_lang", F.col("limit_lang"), over_all)).alias("limit"))
    return both.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"{m}_limit") for m in MEASURES))


def judge(docs: DataFrame, spread: float = 8.0, prior: int = 20) -> DataFrame:
    """One row for each document: measures, shares, limits, ``base_failed`` and ``kept``."""
    rows = settle(_shares(measures(docs)))
    bounds = limits(rows.filter(~F.col("base_failed")), spread, prior)
    bounds = bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(f"{m}_limit" for m in MEASURES))
    joined = rows.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    above = F.lit(False)
    for m in MEASURES:
        above = above | F.coalesce(F.col(m) > F.col(f"{m}_limit"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~above).drop("_lang", "_source")


def keep(docs: DataFrame, spread: float = 8.0, prior: int = 20) -> DataFrame:
    """The documents that are kept, with all their columns."""
    good = judge(docs, spread, prior).filter("kept").select(F.col("doc_id").alias("_good_id"), "row_key").distinct()
    here = docs["doc_id"].cast("long").eqNullSafe(good["_good_id"]) & (row_key(docs) == good["row_key"])
    return docs.join(good, here, "left_semi")
