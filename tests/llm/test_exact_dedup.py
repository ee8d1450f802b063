"""Groups of equal texts against a plain dictionary, with weak keys, small buckets and pages."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from repometrics.llm import exact_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def expected(rows):
    found = {}
    for d, t in rows:
        found.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d is None, d))
    out = []
    for bare, own in found.items():
        own.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(d, own[0][2], len(own), k == 0, hashlib.sha256(bare.encode()).hexdigest()) for k, (_, _, d) in enumerate(own)]
    return sorted(out, key=str)


def result(docs, **parameters):
    return sorted(map(tuple, exact_dedup.groups(docs, **parameters).collect()), key=str)


def some_rows(n=600):
    """A third are copies of one text with other white space; repeated rows, missing ids, ties."""
    rng = random.Random(3)
    rows = []
    for k in range(n):
        if k % 3 == 0:
            text = " ".join("the same words in all of these".split()) + rng.choice(["", " ", "\n", "\t \v", "\r\n\f"])
        elif k % 3 == 1:
            text = f"{rng.choice('abcdefg')} {rng.choice(['x', ' x', 'x '])}"
        else:
            text = f"only here {k} é \x1c漢"
        rows.append((k * 7 % n, text))
    return [*rows, *rows[:9], *rows[3:6], (None, rows[0][1]), (None, None), (None, ""), (None, "  "), (-4, None), (5000, "\xa0")]


@pytest.mark.parametrize("key", [None, "crc32(bare) % 3", "shiftleft(crc32(bare) % 5, 61)", "7L"])
@pytest.mark.parametrize("capacity", [None, 700])
def test_against_dictionary(spark, key, capacity):
    """Weak keys make chains of many texts; small buckets make pages."""
    rows = some_rows()
    docs = spark.createDataFrame([(d, t, "en", None, 1) for d, t in rows], COLUMNS).withColumns(
        {"key": F.lit("x"), "bare": F.lit(1), "bucket": F.lit(2), "slot": F.lit(None), "a.b": F.lit(0), "first": F.lit(1)})
    assert result(docs, capacity=capacity, key=key and F.expr(key)) == expected(rows)


def test_odd_and_empty_tables(odd_docs, odd_rows, no_docs):
    assert result(odd_docs) == expected(odd_rows)
    assert result(odd_docs, capacity=64) == expected(odd_rows)
    assert result(no_docs) == []


def test_buckets_fit_and_cover_all_slots(spark):
    keys = spark.range(40_000).select(F.xxhash64("id").alias("key"), F.lit(10).cast("long").alias("bytes"))
    keys = keys.unionByName(spark.range(20_000).select(F.lit(12345).cast("long").alias("key"), F.lit(10).cast("long").alias("bytes")))
    depth, slots = exact_dedup.build_directory(keys, 5_000)
    rows = keys.withColumn("slot", exact_dedup.slot_of(F.col("key"), depth)).join(slots, "slot")
    fill = rows.groupBy("bucket").agg(F.sum("bytes").alias("n"), F.max("pages").alias("pages")).collect()
    assert sum(r.n for r in fill) == 600_000 and all(r.n <= 5_000 * r.pages for r in fill)
    # only the hot key has pages; the others were split
    assert [r.n > 200_000 for r in fill if r.pages > 1] == [True] and 80 <= len(fill) <= 400


def test_no_python_and_texts_move_once(odd_docs):
    rows = exact_dedup.groups(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in rows and "InArrow" not in rows and "InPandas" not in rows


def test_very_long_text(spark):
    text = "abc " * 3_000_000
    rows = [(1, text), (2, text + " "), (3, "x"), (4, text[:-4])]
    assert result(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], COLUMNS)) == expected(rows)
