"""Token files, token counts, packing and the piece codec against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from repometrics.llm import packing, piece_codec, piece_counts, token_files, wordbpe

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
ALPHABET = "abcdeth  \n\t▁éßİΣ①漢<>|0x1A.,'́​😀\x85\xa0"


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(WORDS))


@pytest.fixture(scope="module")
def library(vocabulary):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))


def test_words_as_the_library(tokenizer, vocabulary):
    own, rng = wordbpe.encoder(vocabulary(WORDS)), random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 50))) for _ in range(1500)]
    texts += ["<|endoftext|>x", "a<|ENDOFTEXT|>", "Don't DON'T. well-known!! (x) a.b,c ÉCOLE. naïve,", "x" * 3000]
    for text in texts + texts[::7]:
        assert own.encode(text.encode()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_as_the_library(library, vocabulary):
    own, rng = piece_codec.piece_codec(vocabulary(PIECES)), random.Random(2)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 50))) for _ in range(1500)]
    texts += ["", " ", "   a  ", "a" * 700, "漢" * 300, "<0x0A><s></s><unk>", "\r\n\n"]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode(text), text
        assert own.decode(ids) == library.decode(library.encode(text))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_pieces_of_any_text(text):
    from repometrics.llm.queries import vocabulary_path
    import sentencepiece

    if "lib" not in _cache:
        _cache["lib"] = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECES))
    assert piece_codec.piece_codec(vocabulary_path(PIECES)).encode(text) == _cache["lib"].encode(text)


_cache: dict = {}


def test_codec_operator(odd_docs, odd_rows, no_docs, library, vocabulary, values):
    def row(i, text):
        ids = library.encode(text or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    got = values(piece_codec.encode_decode(odd_docs, vocabulary(PIECES)))
    assert sorted(got, key=str) == sorted((row(i, t) for i, t in odd_rows), key=str)
    assert piece_codec.encode_decode(no_docs, vocabulary(PIECES)).count() == 0
    full = piece_codec.encode_decode(odd_docs, vocabulary(PIECES), with_ids=True).filter("doc_id = 11").first()
    assert full.ids == library.encode("one") and full.decoded == "one"


@pytest.mark.parametrize("shards", [1, 5])
def test_token_files(spark, odd_docs, odd_rows, no_docs, tokenizer, vocabulary, tmp_path, shards):
    files = token_files.write_tokens(odd_docs, f"file://{tmp_path}/tokens", vocabulary(WORDS), end_id=2, vocabulary=49_408, shards=shards)
    got = [tuple(r) for r in token_files.read_tokens(spark, files, with_ids=True).orderBy("start").collect()]
    start, expected = 0, []
    for i, text in sorted(((i is not None, i or 0, t or "") for i, t in odd_rows)) and sorted(((token_files.NO_ID if i is None else i, t or "") for i, t in odd_rows)):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        expected.append((None if i == token_files.NO_ID else i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == expected
    flat = np.concatenate([np.fromfile(tmp_path / "tokens" / f"{s.shard:05d}.ids", files.dtype) for s in files.shards])
    assert flat.tolist() == [x for row in expected for x in row[4]]
    empty = token_files.write_tokens(no_docs, f"file://{tmp_path}/none", vocabulary(WORDS), end_id=2, vocabulary=49_408)
    assert not empty.shards and token_files.read_tokens(spark, empty).count() == 0


def test_wide_vocabulary_takes_wider_integers(spark, odd_docs, vocabulary, tmp_path):
    files = token_files.write_tokens(odd_docs, str(tmp_path), vocabulary(WORDS), end_id=70_000, vocabulary=49_408)
    assert files.dtype == "<u4"
    assert token_files.read_tokens(spark, files, with_ids=True).filter("ids[size(ids) - 1] <> 70000").count() == 0


def greedy(word, first, later):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (later if at else first)), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_longest_match_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        first = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))}
        later = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))}
        automaton = piece_counts.LongestMatch(first, later)
        for _ in range(40):
            word = "".join(rng.choices("abcd", weights=[9, 9, 9, 1], k=rng.randint(1, 9)))
            assert automaton.count(word) == greedy(word, first, later), (word, first, later)


def spelt(word, pieces, by_bytes):
    """Longest pieces one after the other, by brute force."""
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None and not by_bytes:
            return 0
        n, at = n + (1 if end else len(word[at].encode())), end or at + 1
    return n


def test_longest_match_by_bytes_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        pieces = {"".join(rng.choices("▁aé漢", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 8))}
        for by_bytes in (False, True):
            automaton = piece_counts.LongestMatch([p for p in pieces if p.startswith("▁")], pieces, by_bytes)
            for _ in range(40):
                word = "▁" + "".join(rng.choices("▁aé漢😀", weights=[2, 9, 9, 9, 2], k=rng.randint(1, 9)))
                assert automaton.count(word) == spelt(word, pieces, by_bytes), (word, pieces, by_bytes)


def test_token_counts(spark, odd_docs, odd_rows, no_docs, library, vocabulary):
    """Words whose first character has no piece with a mark, and characters without a piece, by the model's own pieces."""
    rows = [*odd_rows, (201, "2023"), (202, "1,000"), (203, "中文"), (204, "Ελλάδα"), (205, "▁ ▁▁a a▁b"), (206, "😀😀 x😀"), (207, "7 " * 300), (208, "漢字" * 500)]
    pieces = {library.id_to_piece(i) for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))}
    expected = []
    for i, text in rows:
        words = (text or "").encode().split()
        expected.append((i, len(words), sum(spelt("▁" + w.decode(), pieces, True) for w in words), 0))
    docs = odd_docs.unionByName(spark.createDataFrame(rows[len(odd_rows):], "doc_id long, text string"), allowMissingColumns=True)
    got = [tuple(r) for r in piece_counts.token_counts(docs, vocabulary(PIECES)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert piece_counts.token_counts(no_docs, vocabulary(PIECES)).count() == 0
    counts = {i: n for i, _, n, _ in got}
    assert [counts[k] for k in (201, 202, 203, 204)] == [5, 6, 3, 7] and counts[208] == 2001  # 漢 is three bytes, 字 a piece


def check_packing(rows, capacity):
    """Each piece once, sequences gapless and within the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=120))
def test_plan_places_all(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots = packing.plan(counts, 60)
    bins = {}
    for s in slots:
        assert s.pieces % s.copies == 0
        for k in range(s.pieces):
            bins.setdefault(s.sequence + k // s.copies, []).append((s.offset + k % s.copies * s.length, s.length))
    assert sum(s.pieces for s in slots) == len(lengths)
    for n in counts:
        assert sorted(k for s in slots if s.length == n for k in range(s.rank, s.rank + s.pieces)) == list(range(counts[n]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 60
    # best fit decreasing stays within 11/9 of the best, which is at least the sum
    assert len(bins) <= 11 / 9 * max(-(-sum(lengths) // 60), sum(n > 30 for n in lengths)) * 1.25 + 1


def test_pack(odd_docs, odd_rows, no_docs, tokenizer, vocabulary):
    rows = packing.pack(odd_docs, vocabulary(WORDS), end_id=1, capacity=256).collect()
    expected = []
    for i, text in odd_rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            expected.append((i, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(expected, key=str)
    assert check_packing(rows, 256) == -(-sum(r.length for r in rows) // 256)
    assert packing.pack(no_docs, vocabulary(WORDS)).count() == 0
