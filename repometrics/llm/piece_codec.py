"""Operator 10: exact encoding and decoding for a sentencepiece model of merge type.

Encoding does not merge step by step.  It walks through the text with the
longest piece at each place (one Aho-Corasick pass finds them) and keeps a piece if it is
compatible with the one before: merging the two strings anew must give just
these two pieces.  If it isn't, the next shorter piece is tried; if none is
left, the walk goes back one piece and marks the position as failed in a
bit field, so no position fails twice.

The model's normalisation must be the identity with a leading space mark, as
``PieceCodec`` verifies.  No piece of such a model holds a space mark after
another character or a line break (verified as well), so a text is encoded in
chunks between those places, and each task remembers chunks up to a bound.

Missing text is empty text: no ids, empty decoded text.  A very long text is encoded in chunks as others are, and a long
chunk is not remembered.  Repeated rows are encoded each for itself; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from itertools import repeat
from operator import add

from pyspark.sql import DataFrame

from .common import map_documents

MARK = "▁"
#: Below every score.
NO_PIECE = float("-inf")
#: Distinct chunks that a worker remembers in each of two generations, the longest remembered one, and pairs.
MOST_CHUNKS, LONGEST, MOST_PAIRS = 500_000, 400, 400_000


class PieceCodec:
    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        self._library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        if any(lib.normalize(x) != y for x, y in (("", ""), (" a  b ", f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"), ("Ａ\t́", f"{MARK}Ａ\t́"))):
            raise ValueError("only models with identity normalisation and a leading mark are supported")
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(lib.get_piece_size())]
        self._ids = {lib.id_to_piece(i): i for i, x in enumerate(special) if not x}
        self._score = {p: lib.get_score(i) for p, i in self._ids.items()}
        self._byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self._ids):
            raise ValueError("a piece reaches over a word boundary")
        # two characters that follow each other in no piece are never merged
        joined = {p[i : i + 2] for p in self._ids for i in range(len(p) - 1)}
        self._joined = joined
        self._matcher = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for piece in self._ids:
            self._matcher.add_word(piece)
        self._matcher.make_automaton()
        self._letter = self._ids["a"]
        #: chunks that don't decode to themselves, with what they do
        self._odd: dict[str, str] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._now: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merges one at a time: the best-scored pair first, the leftmost of equal ones."""
        parts, score = list(text), self._score.get
        while len(parts) > 1:
            pairs = list(map(add, parts, parts[1:]))
            scores = list(map(score, pairs, repeat(NO_PIECE)))
            best = max(scores)
            if best == NO_PIECE:
                return parts
            i = scores.index(best)
            parts[i : i + 2] = [pairs[i]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Would merging leave this pair as it is? With nothing on the left: this piece."""
        if len(self._pairs) >= MOST_PAIRS:
            self._pairs.clear()
        found = self._pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def pieces(self, chunk: str) -> list[str]:
        """The pieces of a chunk; a character that no piece holds is a piece by itself."""
        longest = [1] * len(chunk)
        # of the matches from one place the longest comes last
        for last, size in self._matcher.iter(chunk):
            longest[last + 1 - size] = size
        ids, known = self._ids, self._pairs.get
        # a bit for each position from which the rest can't be encoded
        failed, done, left, at = 0, [], "", 0
        size = longest[0]
        n = len(chunk)
        while True:
            while size:
                end = at + size
                piece = chunk[at:end]
                if (size == 1 or piece in ids) and not failed >> end & 1:
                    fits = known((left, piece))
                    if self._fits(left, piece) if fits is None else fits:
                        break
                size -= 1
            if size:
                done.append(piece)
                left, at = piece, end
                if at == n:
                    return done
                size = longest[at]
            else:
                failed |= 1 << at
                size = len(done.pop())
                left = done[-1] if done else ""
                at -= size
                size -= 1

    def _chunks(self, text: str) -> list[str]:
        return re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", (MARK + text).replace(" ", MARK)) if text else []

    def _part(self, text: str) -> bytes:
        """Ids of what lies between two places where nothing can be merged."""
        found = self._now.get(text) or self._before.get(text)
        if found is None:
            ids: list[int] = []
            for piece in self.pieces(text):
                known = self._ids.get(piece)
                ids += [known] if known is not None else [self._byte[b] for b in piece.encode()]
            found = b"%d," * len(ids) % (*ids,)
        self._now[text] = found
        return found

    def _learn(self, chunks: list[str]) -> bytes:
        if len(self._odd) > MOST_CHUNKS:
            # a chunk that is remembered must be known as an odd one, so all go together
            self._now, self._before, self._odd = {}, {}, {}
        if len(self._now) > MOST_CHUNKS:
            self._now, self._before = {}, self._now
        now, before, joined = self._now, self._before, self._joined
        for chunk in {*chunks}.difference(now):
            if (found := before.get(chunk)) is None:
                cuts = [0, *[i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in joined], len(chunk)]
                found = b"".join([self._part(chunk[a:b]) for a, b in zip(cuts, cuts[1:])]) if len(cuts) > 2 else self._part(chunk)
                self._check(chunk, found)
            now[chunk] = found
        said = b"".join(map(now.__getitem__, chunks))
        for chunk in [c for c in chunks if len(c) > LONGEST]:
            now.pop(chunk, None)
        return said

    def _check(self, chunk: str, said: bytes) -> None:
        """Decode a chunk's ids, after a letter, which keeps its mark; note what it becomes if that isn't the chunk."""
        decoded = self._library.decode([self._letter, *map(int, said[:-1].split(b","))])[1:]
        if decoded != chunk.replace(MARK, " "):
            self._odd[chunk] = decoded

    def spell(self, text: str) -> tuple[bytes, str]:
        """Decimal ids of a whole text, each followed by a comma, and what the ids decode to.

        Chunks are decoded by themselves, when they are first met: a chunk holds whole characters, so what its bytes become
        doesn't depend on its neighbours.
        """
        chunks = self._chunks(text)
        try:
            said = b"".join(map(self._now.__getitem__, chunks))
        except KeyError:
            said = self._learn(chunks)
        if not self._odd or self._odd.keys().isdisjoint(chunks):
            return said, text.replace(MARK, " ") if MARK in text else text
        return said, "".join([self._odd.get(c) or c.replace(MARK, " ") for c in chunks])[1:]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        said = self.spell(text)[0]
        return list(map(int, said[:-1].split(b","))) if said else []

    def decode(self, ids: list[int]) -> str:
        return self._library.decode(ids)


@functools.lru_cache(maxsize=2)
def piece_codec(model: str) -> PieceCodec:
    """The worker process's codec for a model; tasks that follow each other share it."""
    return PieceCodec(model)


def encode_decode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of whole texts; with ``ids`` and ``decoded`` if asked for."""

    def worker():
        codec = piece_codec(model)

        def each(text: bytes) -> dict:
            said, decoded = codec.spell(text.decode())
            row = {"n_tokens": said.count(b","), "ids_sha256": hashlib.sha256(said[:-1]).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
            return row | ({"ids": list(map(int, said[:-1].split(b","))) if said else [], "decoded": decoded} if with_ids else {})

        return each

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_documents(docs, worker, schema + ", ids array<int>, decoded string" * with_ids)
