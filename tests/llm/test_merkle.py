"""The tree, its proofs and what tampering does, against a plain recursion."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from repometrics.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(hashes, fanout):
    """The root, and for each hash its siblings (before, after) from the lowest level up."""
    ways, spots = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for w, p in zip(ways, spots, strict=True):
            run = p // fanout * fanout
            w.append(("".join(hashes[run:p]), "".join(hashes[p + 1 : run + fanout])))
        hashes = [sha("".join(hashes[i : i + fanout])) for i in range(0, len(hashes), fanout)]
        spots = [p // fanout for p in spots]
    return hashes[0], ways


def expected(rows, fanout=3):
    """rows: (doc_id, text, lang, source, n_chars)"""
    trees = {}
    for d, t, la, s, n in rows:
        own = leaf(d, s, la, n, t)
        hit = d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and t is not None
        trees.setdefault(s, []).append((d is not None, d or 0, own, leaf(d, s, la, n, t.replace("\n", "")) if hit else own))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: grow([x[2] for x in sorted(trees[s])], fanout) for s in names}
    root, above = grow([below[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above, strict=True):
        for (known, d, own, other), way in zip(sorted(trees[s]), below[s][1], strict=True):
            folded = other
            for b, a in way + up:
                folded = sha(b + folded + a)
            out.append((d if known else None, own, below[s][0], root, sha("".join(b + a for b, a in way + up)), folded, folded == root))
    return sorted(out, key=str)


def checked(docs, fanout=3):
    even = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0
    return merkle.verify(docs, even, F.replace(docs["text"], F.lit("\n"), F.lit("")), fanout)


@pytest.mark.parametrize("fanout", [2, 3])
def test_odd_rows(odd_docs, fanout):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd_docs.collect()]
    got = sorted(map(tuple, checked(odd_docs, fanout).collect()), key=str)
    assert got == expected(rows, fanout)
    assert {r[-1] for r in got} == {True, False}


def test_uneven_sources_names_and_lone_leaves(spark):
    """Runs of every length, a source without a name, an empty one, one leaf, a third of all rows in one source."""
    rows = [(k, f"text {k}\nof it", "en", name, k) for k, name in enumerate(
        ["hot"] * 82 + ["a"] * 27 + ["b"] * 28 + ["é"] * 10 + ["Z"] * 3 + [""] * 4 + [None] * 2 + ["lone"])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int").withColumns(
        {"tree": F.lit(1), "pos": F.lit("x"), "path": F.lit(None), "hash": F.lit(2), "a.b": F.lit(3)})
    assert sorted(map(tuple, checked(docs).collect()), key=str) == expected(rows)


def test_one_row_and_none(spark, no_docs):
    one = [(7, "a\nb", None, None, None)]
    docs = spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r) for r in checked(docs).collect()] == expected(one)
    assert checked(no_docs).count() == 0


def test_any_change_shows(spark):
    """A row that is changed in any column no longer folds to the root; untouched rows do."""
    docs = spark.createDataFrame([(k, f"t{k}", "en", f"s{k % 4}", k) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.verify(docs, F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" ")))
    assert {r.doc_id for r in found.collect() if not r.verified} == set(range(0, 40, 5))
    roots = {docs.withColumn(c, v).transform(merkle.proofs).first().root for c, v in (
        ("text", F.col("text")), ("lang", F.when(F.col("doc_id") != 3, F.col("lang"))), ("n_chars", F.col("n_chars") + (F.col("doc_id") == 9).cast("int")),
        ("source", F.when(F.col("doc_id") == 0, F.lit("s1")).otherwise(F.col("source"))))}
    assert len(roots) == 4


def test_very_long_text(spark):
    text = "word\n" * 4_000_000
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, checked(docs).collect()), key=str) == expected([(1, text, "en", "s", 1), (2, "x", "en", "s", 1)])
