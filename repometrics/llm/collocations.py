"""Operator 13: phrases whose words stay together, by the stripes pattern.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``;
everything is counted per ``lang`` (missing: ``und``).

Stripes: a task turns its texts into stripes, one for each prefix of two words, an associative counter of what
follows (the next two words, or the end of the piece), and sends each stripe to the part that owns its prefix.  A part
merges the stripes of a prefix elementwise.  The merged stripe has the counts of all extensions; its sums are
the totals of the prefix and of each next word.  So one shuffle counts phrases of two, three and four words exactly, and an
occurrence travels once, as numbers into the word list of its row.  Words alone are the stripe of the empty prefix.

Hot prefixes: a pass over all texts finds prefixes of two words that hold more than a part's share of all
occurrences, and of three likewise; their number is at most twice the number of parts.  Stripes of a hot
prefix are dealt out by the next word as well, and the partial totals are added up afterwards.  The results don't
depend on which prefixes are held to be hot.

Only phrases of ``least`` occurrences or more leave the parts.  Cuts, subsumption (the greatest count
among phrases one word longer; a phrase inside a still longer one lies in one of these, which occurs no less often) and
ranks are columns.

Missing and empty texts have no words; a language without a candidate has no rows, and an empty table has none.  Repeated rows count
each.  A text longer than a chunk is cut at ends of pieces.  ``doc_id`` may be missing.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle
from .common import text_of

END = b"\xff"  # never part of UTF-8
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: A prefix that a chunk holds less often than this is not looked at when hot ones are sought.
SELDOM = 8
MOST_SHARES = 50_000
STRIPES = "part int, lang string, words binary, stripes binary"


class Numbers(dict):
    """Numbers words in the order they come; the end of a piece is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[str, bytes]]:
    """``lang`` and folded texts of about a chunk, each piece followed by ``END``."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text.translate(_FOLD)
            at = 0
            while len(text) - at > chunk_bytes and (cut := text.find(END, at + chunk_bytes)) >= 0:
                yield lang, text[at : cut + 1]
                at = cut + 1
            held.setdefault(lang, []).append(text[at:] if at else text)
            sizes[lang] = sizes.get(lang, 0) + len(text) - at
            if sum(sizes.values()) > chunk_bytes:
                for name, found in held.items():
                    yield name, END.join([*found, b""])
                held, sizes = {}, {}
    for name, found in held.items():
        yield name, END.join([*found, b""])


class Occurrences:
    """Every word of a chunk with the three after it in its piece; 0 where the piece has ended."""

    def __init__(self, data: bytes):
        numbers = Numbers()
        words = data.replace(END, b" \xff ").split()
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.words = list(numbers)
        padded = np.concatenate((ids, np.zeros(3, np.int64)))
        at = np.flatnonzero(ids)
        self.of_word = np.bincount(ids[at], minlength=len(self.words))
        at = at[padded[at + 1] > 0]
        self.a, self.b = padded[at], padded[at + 1]
        self.c = padded[at + 2]
        self.d = np.where(self.c > 0, padded[at + 3], 0)

    def stripes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct prefixes ``a, b``, what follows them ``c, d``, and how often (a stripe is a run of equal prefixes)."""
        return merged(self.a << 32 | self.b, self.c << 32 | self.d, np.ones(len(self.a), np.int64))


def merged(prefix: np.ndarray, after: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((after, prefix))
    prefix, after, count = prefix[order], after[order], count[order]
    first = runs(prefix, after)
    return prefix[first], after[first], np.add.reduceat(count, first) if len(first) else count


def runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(sorted_by[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def spread(*values: np.ndarray) -> np.ndarray:
    """One 64-bit hash of hashes in this order."""
    out = np.zeros(len(values[0]), np.uint64)
    for x in values:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def hash_of(words: list[bytes]) -> np.ndarray:
    return np.asarray([0, *(xxhash.xxh3_64_intdigest(w) for w in words[1:])], np.uint64)


def pack(prefix: np.ndarray, after: np.ndarray, count: np.ndarray, words: list[bytes]) -> tuple[bytes, bytes]:
    """The word list of some stripes, and the stripes as numbers into it: each prefix once, with the length of its run."""
    first = runs(prefix)
    columns = [prefix[first] >> 32, prefix[first] & 0xFFFFFFFF, after >> 32, after & 0xFFFFFFFF]
    used, index = np.unique(np.concatenate([*columns, [0]]), return_inverse=True)
    of_id = "<u2" if len(used) <= 1 << 16 else "<u4"
    lengths = np.diff(np.concatenate((first, [len(prefix)])))
    of_count = "<u1" if max(count.max(), lengths.max()) < 256 else "<u4"
    head = np.asarray([len(first), len(after), int(of_id[2]), int(of_count[2])], "<u4")
    return END.join(words[k] for k in used[1:].tolist()), b"".join(
        [head.tobytes(), index[:-1].astype(of_id).tobytes(), lengths.astype(of_count).tobytes(), count.astype(of_count).tobytes()])


def unpack(stripes: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``prefix, after, count`` in the numbers ``ids`` of the row's words."""
    prefixes, n, wide, long = np.frombuffer(stripes, "<u4", 4).tolist()
    index = ids[np.frombuffer(stripes, f"<u{wide}", 2 * (prefixes + n), 16)]
    counts = np.frombuffer(stripes, f"<u{long}", prefixes + n, 16 + wide * 2 * (prefixes + n)).astype(np.int64)
    prefix = np.repeat(index[:prefixes] << 32 | index[prefixes : 2 * prefixes], counts[:prefixes])
    return prefix, index[2 * prefixes : 2 * prefixes + n] << 32 | index[2 * prefixes + n :], counts[prefixes:]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.encode(text_of(docs), "UTF-8").alias("text"))


def words_and_hot(docs: DataFrame, chunk_bytes: int, shares: int) -> DataFrame:
    """``lang, k, phrase, f``: all words (k = 1) and the prefixes of two and three words that may be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in chunks(batches, chunk_bytes):
            found = Occurrences(data)
            phrases, sizes, counts = [w.decode() for w in found.words[1:]], [1] * (len(found.words) - 1), found.of_word[1:].tolist()
            floor = max(SELDOM, len(found.a) // (2 * shares))
            prefix, after, count = found.stripes()
            for k in (2, 3):
                key = after >> 32 if k == 3 else np.zeros(len(after), np.int64)
                first = runs(prefix, key) if len(prefix) else np.zeros(0, np.int64)
                sums = np.add.reduceat(count, first) if len(first) else count
                often = np.flatnonzero((sums >= floor) & ((key[first] > 0) | (k == 2)))
                for p, c, n in zip(prefix[first][often].tolist(), key[first][often].tolist(), sums[often].tolist(), strict=True):
                    phrases.append(b" ".join(found.words[x] for x in (p >> 32, p & 0xFFFFFFFF, c)[:k]).decode())
                    sizes.append(k)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(phrases), pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())],
                ["lang", "k", "phrase", "f"])

    found = _rows(docs).mapInArrow(run, "lang string, k int, phrase string, f long")
    return settle(found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")))


def phrase_counts(docs: DataFrame, least: int, part_bytes: int, chunk_bytes: int, shares: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang, k, phrase, f`` of all phrases of 1 to 4 words with ``f >= least``, and ``lang, n``, the number of words."""
    total = docs.agg(F.sum(F.octet_length(text_of(docs)).cast("long"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    shares = shares or min(parts, MOST_SHARES)
    words = words_and_hot(docs, chunk_bytes, shares)
    numbers = words.filter("k = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    # at most two of each length for each share
    every = words.filter("k = 1").agg(F.sum("f")).first()[0] or 0
    hot: dict[tuple[str, int], np.ndarray] = {}
    for row in words.filter((F.col("k") > 1) & (F.col("f") * 2 * shares >= every)).select("lang", "phrase").collect():
        own = hash_of([END, *row.phrase.encode().split(b" ")])[1:]
        hot[row.lang, len(own)] = np.append(hot.get((row.lang, len(own)), np.zeros(0, np.uint64)), spread(*own[:, None]))

    def is_hot(lang: str, *hashes: np.ndarray) -> np.ndarray:
        """Of each phrase, given by the hashes of its words; the same wherever it is asked."""
        among = hot.get((lang, len(hashes)))
        return np.zeros(len(hashes[0]), bool) if among is None else np.isin(spread(*hashes), among)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in chunks(batches, chunk_bytes):
            found = Occurrences(data)
            prefix, after, count = found.stripes()
            if not len(prefix):
                continue
            a, b, c, d = prefix >> 32, prefix & 0xFFFFFFFF, after >> 32, after & 0xFFFFFFFF
            h = hash_of(found.words)
            key = spread(h[a], h[b])
            two = is_hot(lang, h[a], h[b])
            three = two & is_hot(lang, h[a], h[b], h[c])
            key = np.where(two, spread(key, h[c]), key)
            key = np.where(three, spread(key, h[d]), key)
            part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            prefix, after, count, part = prefix[order], after[order], count[order], part[order]
            first = runs(part)
            packed = [(int(part[i]), *pack(prefix[i:j], after[i:j], count[i:j], found.words)) for i, j in zip(first, [*first[1:], len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in packed], pa.int32()), pa.array([lang] * len(packed), pa.string()), pa.array([x[1] for x in packed], pa.binary()), pa.array([x[2] for x in packed], pa.binary())],
                ["part", "lang", "words", "stripes"])

    def merge(table: pa.Table) -> pa.Table:
        lang, numbers, sent = table.column("lang")[0].as_py(), Numbers(), []
        for words, stripes in zip(table.column("words"), table.column("stripes"), strict=True):
            ids = np.fromiter(map(numbers.__getitem__, [END, *words.as_py().split(END)]), np.int64)
            sent.append(unpack(stripes.as_py(), ids))
        prefix, after, count = merged(*(np.concatenate(x) for x in zip(*sent, strict=True)))
        known = list(numbers)
        h = hash_of(known)
        a, b, c, d = prefix >> 32, prefix & 0xFFFFFFFF, after >> 32, after & 0xFFFFFFFF
        out: list[tuple[int, bytes, int]] = []
        for k, ids in ((2, (a, b)), (3, (a, b, c)), (4, (a, b, c, d))):
            first = runs(*ids)
            sums = np.add.reduceat(count, first)
            ids = [x[first] for x in ids]
            # what is dealt out by the next word as well is summed up later
            partial = is_hot(lang, h[ids[0]], h[ids[1]]) if k < 4 else np.zeros(len(first), bool)
            if k == 3:
                partial &= is_hot(lang, *(h[x] for x in ids))
            wanted = np.flatnonzero((ids[-1] > 0) & (partial | (sums >= least)))
            out += [(k, b" ".join(known[x[i]] for x in ids), int(sums[i])) for i in wanted.tolist()]
        return pa.table({
            "lang": pa.array([lang] * len(out), pa.string()), "k": pa.array([x[0] for x in out], pa.int32()),
            "phrase": pa.array([x[1].decode() for x in out], pa.string()), "f": pa.array([x[2] for x in out], pa.int64())})

    phrases = _rows(docs).mapInArrow(deal, STRIPES).groupBy("part", "lang").applyInArrow(merge, "lang string, k int, phrase string, f long")
    phrases = phrases.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return settle(phrases.unionByName(words.filter((F.col("k") == 1) & (F.col("f") >= least)))), numbers


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, top: int = 2000, part_bytes: int = 8_000_000, chunk_bytes: int = 8_000_000, shares: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    ``least``: occurrences of a candidate; ``inside``: percent of them within a longer candidate that drop it.
    """
    counts, numbers = phrase_counts(docs, least, part_bytes, chunk_bytes, shares)
    found = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # what a stripe's greatest extension, to either side, says about the phrase
    around = F.array(F.slice("w", 1, F.col("k") - 1), F.slice("w", 2, F.col("k") - 1))
    longer = found.filter("k > 2").select("lang", F.explode(F.transform(around, lambda w: F.array_join(w, " "))).alias("phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = "decimal(38,0)"
    found = found.join(longer, ["lang", "phrase"], "left").filter(
        F.coalesce(F.col("longer").cast(wide) * 100 < F.col("a").cast(wide) * inside, F.lit(True)))

    cut = found.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    of = counts.select("lang", "phrase", "f")
    cut = cut.join(of.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(of.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # whole numbers throughout
    cut = cut.withColumn("score", F.expr("CAST(CAST(a AS DECIMAL(20,0)) * 2000000 AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)) AS DECIMAL(38,0))"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(numbers, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
