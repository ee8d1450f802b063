"""Phrases against a plain count of all n-grams, whichever prefixes are dealt out as hot ones."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repometrics.llm import collocations

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def expected(rows, least, inside=80, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f[lang or "und" if lang is None else lang].update((tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    out = []
    for lang, counts in f.items():
        n = sum(v for p, v in counts.items() if len(p) == 1)
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            spans = any(100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p))
            if not spans:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def some_rows(seed=5, n=300):
    """Few words, so phrases repeat and tie; one prefix and one line in a third of all rows."""
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "É", "x", "ÿ\xa0y", "w\x1cw", "\x00"] + [f"v{k}" for k in range(12)]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ", ", "\n", "!?", "\x0b"]) for _ in range(rng.randint(0, 60)))
        if k % 3 == 0:
            text += f" very common {rng.choice(words)} {rng.choice(words)}. the same line of words"
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), text))
    return [*rows, ("en", None), ("en", ""), (None, " \t\n.,"), rows[0], rows[0], ("long", "a b c d e f. " * 40_000), ("long", "one " * 3000)]


@pytest.mark.parametrize(("shares", "part", "chunk"), [(None, 8_000_000, 8_000_000), (40, 2_000, 3_000), (5_000, 500, 40_000)])
def test_against_plain_counts(spark, monkeypatch, shares, part, chunk):
    rows = some_rows()
    docs = spark.createDataFrame([(k, t, la, "s", 1) for k, (la, t) in enumerate(rows)], COLUMNS).withColumns(
        {"part": F.lit("x"), "phrase": F.lit(2), "f": F.lit(None), "a.b": F.lit(1), "n": F.lit(3)})
    got = sorted(map(tuple, collocations.collocations(docs, least=5, part_bytes=part, chunk_bytes=chunk, shares=shares).collect()))
    assert got == expected(rows, 5)
    assert {r[0] for r in got} >= {"en", "fr", "und", "", "long"}


def test_first_ones_only(spark):
    rows = some_rows(9, 120)
    docs = spark.createDataFrame([(None, t, la, None, None) for la, t in rows], COLUMNS)
    got = sorted(map(tuple, collocations.collocations(docs, least=4, top=7, part_bytes=3_000).collect()))
    assert got == expected(rows, 4, top=7) and max(r[1] for r in got) == 7


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, collocations.collocations(odd_docs, least=3).collect())) == expected(rows, 3)
    assert collocations.collocations(no_docs).collect() == []
    assert collocations.collocations(odd_docs.filter("text IS NULL")).collect() == []


def test_merging_is_elementwise():
    """Two lists of stripes, each packed with its own words, sum to what the joined text has."""
    texts = [b"a b c d a b c e\xff" * 3, b"a b c d. x a b\xff".replace(b".", b"\xff")]
    numbers, sent = collocations.Numbers(), []
    for t in texts:
        found = collocations.Occurrences(t)
        words, stripes = collocations.pack(*found.stripes(), found.words)
        import numpy as np

        ids = np.asarray([numbers[w] for w in [collocations.END, *words.split(collocations.END)]])
        sent.append(collocations.unpack(stripes, ids))
    prefix, after, count = collocations.merged(*(np.concatenate(x) for x in zip(*sent)))
    known = list(numbers)
    got = {tuple(known[x] for x in (p >> 32, p & 0xFFFFFFFF, q >> 32, q & 0xFFFFFFFF)): n for p, q, n in zip(prefix.tolist(), after.tolist(), count.tolist())}
    whole = collocations.Occurrences(b"".join(texts))
    p, q, n = whole.stripes()
    assert got == {tuple(whole.words[x] for x in (i >> 32, i & 0xFFFFFFFF, j >> 32, j & 0xFFFFFFFF)): m for i, j, m in zip(p.tolist(), q.tolist(), n.tolist())}


def test_chunks_lose_nothing():
    import pyarrow as pa

    texts = [b"One two. three", b"", b"x" * 50 + b"\n" + b"y z " * 40 + b", end", b"no end at all " * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr", "en", "en"]), pa.array(texts, pa.binary())], ["lang", "text"])
    for size in (10, 60, 10_000):
        words = Counter(w for _, data in collocations.chunks([batch], size) for w in data.replace(collocations.END, b" ").split())
        assert words == Counter(w for t in texts for w in re.split(rb"[.,\n ]+", t.lower()) if w)
