"""Suffix-array dedup, substring dedup and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from repometrics.llm import blocks, components, ngram_join, substring_dedup, suffix_array, suffix_dedup

LEAST = -(2**63)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_array.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("symbols", [[], [0], [5] * 50, list(b"banana" * 20), [2, 1] * 30, list(range(40)), list(range(40, 0, -1))])
def test_suffix_array_of_plain_shapes(symbols):
    assert suffix_array.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_range_hash():
    data = np.frombuffer(b"abcabcabcxabc" * 3, np.uint8)
    hashes = blocks.RangeHash(data)
    starts = np.arange(len(data) - 4)
    got = hashes.of(starts, starts + 4)
    assert len(set(got.tolist())) == len({data[k : k + 4].tobytes() for k in starts}) and len(hashes.fixed(4)) == len(data) - 3


def bytes_left(rows, size):
    """Each string against all earlier ones; rows with equal ids are one document."""
    first = {}
    texts = [(LEAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - size + 1):
            first[b[k : k + size]] = min(first.get(b[k : k + size], (2**63, 0)), (i, k))
    out = []
    for (i, _), (n, b) in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < (n, k):
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,block_bytes,hot", [(100, 4_000_000, 64), (30, 2_000, 64), (30, 2_000, 1), (12, 500, 2)])
def test_suffix_dedup(odd_docs, odd_rows, size, block_bytes, hot):
    got = suffix_dedup.remove_repeats(odd_docs, size, block_bytes, hot).collect()
    assert sorted((tuple(r) for r in got), key=str) == bytes_left(odd_rows, size)


def test_suffix_dedup_of_edited_copies(spark):
    rng = random.Random(4)
    base = "".join(rng.choices("abcdef ", k=900))
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(900)] = rng.choice("xyz")
        rows.append((i, "".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (64, 3):
        got = suffix_dedup.remove_repeats(docs, 40, 6_000, hot).collect()
        assert sorted((tuple(r) for r in got), key=str) == bytes_left(rows, 40)


def words_left(rows, size):
    first = {}
    texts = [(LEAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - size + 1):
            first[tuple(w[k : k + size])] = min(i, first.get(tuple(w[k : k + size]), 2**63))
    out = []
    for (i, _), (n, w) in zip(rows, texts):
        gone = {k + d for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < n for d in range(size)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,block_bytes", [(13, 8_000_000), (13, 1_500), (3, 400)])
def test_substring_dedup(odd_docs, odd_rows, size, block_bytes):
    got = substring_dedup.remove_repeats(odd_docs, size, block_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == words_left(odd_rows, size)


def test_clean_keeps_all_columns(odd_docs, odd_rows):
    cleaned = substring_dedup.clean(odd_docs, 13, 1_500)
    assert cleaned.columns == odd_docs.columns and dict(cleaned.dtypes) == dict(odd_docs.dtypes)
    rows = cleaned.collect()
    assert len(rows) == len(odd_rows) and all(r.n_chars == len(r.text) for r in rows)
    # the row numbers of the fixture stay with their rows
    assert all(rows and odd_rows[r.part][0] == r.doc_id for r in rows)
    assert next(r.text for r in rows if r.doc_id == 51) == "line of five words here\n" * 20


def test_empty_tables(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == substring_dedup.remove_repeats(no_docs).count() == ngram_join.near_copies(no_docs).count() == 0
    assert substring_dedup.clean(no_docs).columns == ngram_join.keep_one(no_docs).columns == no_docs.columns


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_by_brute_force(rows, size=5, threshold=0.8):
    sets = [shingles(t, size) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if sets[a] == sets[b] or (union and len(sets[a] & sets[b]) / union >= threshold):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    name = {k: min((i for i in ids if i is not None), default=None) for k, ids in least.items()}
    copies = Counter(sets)
    return sorted(((i, name[find(k)], links[k], copies[sets[k]]) for k, (i, _) in enumerate(rows)), key=str)


def edited_families(seed, families, members, edits):
    rng, rows = random.Random(seed), []
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(rng.randint(60, 150))]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("most", [1000, 7])
def test_near_copies(spark, odd_docs, odd_rows, most):
    got = ngram_join.near_copies(odd_docs, most=most).collect()
    assert sorted((tuple(r) for r in got), key=str) == near_by_brute_force(odd_rows)
    rows = edited_families(1, 12, 12, 3)
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()
    assert sorted((tuple(r) for r in got), key=str) == near_by_brute_force(rows)


def test_parts_that_share_a_bin_are_not_linked():
    """Four equal neighbours in two parts: the links are those within each part, however many parts fill the bin."""
    shared = np.arange(100, dtype="<u8")
    sets = [np.append(shared, np.uint64(1000 + k)).tobytes() for k in range(4)]
    rows = {"node": [b"a", b"b", b"c", b"d"], "copies": [1, 2, 3, 4], "side": [0] * 4, "label": [b"a", b"a", b"c", b"c"], "shingles": sets}
    found = {r["node"]: (r["links"], r["root"]) for r in ngram_join._verify(0.8)(pa.table(rows)).to_pylist()}
    assert found == {b"a": (2, b"a"), b"b": (1, b"a"), b"c": (4, b"c"), b"d": (3, b"c")}


def test_keep_one(odd_docs, odd_rows):
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    classes = {(c if c is not None else "none") for _, c, _, _ in near_by_brute_force(odd_rows)}
    assert "5" not in ids and "7" not in ids and ids.count("12") == 1 and len(ids) >= len(classes)


def test_depth_shortens_until_the_recall():
    assert ngram_join.depth(0.8, 12, 8, 0.9995) == 3 and ngram_join.depth(0.8, 12, 8, 0.99999) == 2 and ngram_join.depth(1.0, 1, 8, 1.0) == 8


def test_shared_counts():
    rng = random.Random(6)
    sets = [np.unique(np.asarray(rng.choices(range(90), k=rng.randint(1, 60)), np.uint64)) for _ in range(80)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for common in (2, 10, 1000):
        assert ngram_join.shared_counts(sets, common).tolist() == expected


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = dict(components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200, 202: 200}


def parity_words():
    """Two words that a polynomial hash modulo a power of two cannot tell apart."""
    bits = [k.bit_count() % 2 for k in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_made_to_collide(spark):
    a, b = parity_words()
    rest = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, a), (4, b), (5, f"{a} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_copies(docs).collect()} == {1: (1, 2, 2), 2: (1, 2, 1), 3: (3, 0, 1), 4: (4, 0, 1), 5: (1, 2, 2)}


def test_hashed_words():
    texts = [b"a b\ta \xc3\xa9\n", b"", b" \n", b"b\x1cb b"]
    hashes, lengths = substring_dedup.hashed_words(texts, 0)
    words = [w for t in texts for w in t.split()]
    assert lengths.tolist() == [4, 0, 0, 2] and len(hashes) == 6
    assert all((hashes[i] == hashes[k]) == (words[i] == words[k]) for i in range(6) for k in range(6))
    assert (substring_dedup.hashed_words(texts, 1)[0] != hashes).all()


def joined_edges(n, most):
    """Edges that verification sends on, of one family of ``n`` texts dealt into slices."""
    shared = np.arange(200, dtype="<u8")
    nodes = [f"{k:05}".encode() for k in range(n)]
    sets = [np.append(shared, np.uint64(1000 + k)).tobytes() for k in range(n)]
    slices, edges, links = range(-(-n // most)), [], Counter()
    for s in slices:
        for t in slices[s:]:
            rows = [(x, 1 if s != t and k % len(slices) == s else 2 if s != t else 0, d) for k, (x, d) in enumerate(zip(nodes, sets)) if k % len(slices) in (s, t)]
            table = pa.table({"node": [x for x, _, _ in rows], "copies": [1] * len(rows), "side": [k for _, k, _ in rows], "label": [b"p"] * len(rows), "shingles": [d for _, _, d in rows]})
            for r in ngram_join._verify(0.8)(table).to_pylist():
                links[r["node"]] += r["links"]
                if r["node"] != r["root"]:
                    edges.append((r["node"], r["root"]))
    assert set(links.values()) == {n - 1}
    return nodes, edges


def test_edges_grow_with_the_nodes():
    """Twice the nodes, and four times the pairs of slices: about twice the edges, and still one class."""
    found = {}
    for n in (200, 400, 800):
        nodes, edges = joined_edges(n, 50)
        root = {x: x for x in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        assert len({find(x) for x in nodes}) == 1
        found[n] = len(edges)
    assert all(found[n] <= n + (n // 50) ** 2 for n in found) and found[800] < 2.6 * found[400]


def test_rows_without_an_id_meet_by_their_text(spark):
    """Many texts without an id: each is found by its text, and near ones are linked."""
    base = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(["x%d" % k, *base])) for k in range(40)] + [(None, f"alone {k} of these words here") for k in range(40)] + [(7, " ".join(base))]
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == near_by_brute_force(rows)


def test_clashing_and_dotted_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4, 5), (2, text, 1, 2, 3, 4, 6)], "doc_id long, text string, _id int, _key int, _nth int, `a.b` int, _row int")
    assert [tuple(r) for r in ngram_join.keep_one(docs).collect()] == [(1, text, 1, 2, 3, 4, 5)] and ngram_join.keep_one(docs).columns == docs.columns
    assert sorted(map(tuple, substring_dedup.clean(docs).collect())) == [(1, text, 1, 2, 3, 4, 5), (2, "", 1, 2, 3, 4, 6)]
