"""Operator 6: token counts by a linear longest-match automaton.

Greedy word pieces: the longest vocabulary piece from the start of a word,
then the longest continuation piece, and so on.  The automaton is a trie
of the vocabulary with a failure link in each node.  The link of a node leads to
where matching goes on once the pieces that are certain there are taken off; how many
those are is computed with the link.  So each character moves forward once,
a count is added at each link taken, and no piece is ever built.

Words are ``[^\\x20\\x09-\\x0D]+``.  A word is matched with the word mark before it,
against all pieces; the bare mark is a piece as others are.  Where the model has the
256 byte pieces, a character that no piece holds counts as many tokens as it has
bytes in UTF-8.  A word that the vocabulary cannot spell, which needs a model without
byte pieces, counts as one token (unknown).  Missing or empty text: no words, no tokens.
A very long text is counted whole, and very long words aren't remembered.  Repeated rows are counted each for itself; an
empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .common import map_documents

MARK = "▁"
#: Distinct words that a worker remembers in each of two generations, and the longest remembered one.
MOST_WORDS, LONGEST = 600_000, 400


class LongestMatch:
    """Counts pieces of words. ``first``: pieces that may begin a word; ``later``: pieces that may continue one.

    ``by_bytes``: where no piece fits, a character is spelt by its bytes.
    """

    START, INNER = 0, 1

    def __init__(self, first: Iterable[str], later: Iterable[str], by_bytes: bool = False):
        self._by_bytes = by_bytes
        self._next: list[dict[str, int]] = [{}, {}]
        # nodes where a piece ends, with the number of tokens it counts
        ends = {self._add(root, piece): 1 for root, pieces in ((self.START, first), (self.INNER, later)) for piece in pieces if piece}
        if by_bytes:
            # what begins a longer piece only, or occurs inside one: matching may stop before it or after it
            for char in {c for node in self._next for c in node}:
                for root in (self.START, self.INNER):
                    ends.setdefault(self._add(root, char), len(char.encode()))
        self._fail: list[int] = [-1] * len(self._next)
        self._pops = [0] * len(self._next)
        queue = deque((self.START, self.INNER))
        while queue:
            node = queue.popleft()
            for char, child in self._next[node].items():
                queue.append(child)
                if child in ends:
                    # all up to here is one piece
                    self._fail[child], self._pops[child] = self.INNER, ends[child]
                    continue
                link, pops = self._fail[node], self._pops[node]
                while link >= 0 and char not in self._next[link]:
                    link, pops = self._fail[link], pops + self._pops[link]
                if link >= 0:
                    self._fail[child], self._pops[child] = self._next[link][char], pops

    def _add(self, node: int, piece: str) -> int:
        for char in piece:
            node = self._next[node].setdefault(char, len(self._next))
            if node == len(self._next):
                self._next.append({})
        return node

    def count(self, word: str) -> int:
        """Number of pieces of a word, 0 if it can't be spelt."""
        step, fail, pops = self._next, self._fail, self._pops
        node = total = 0
        for char in word:
            while (following := step[node].get(char)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    if not self._by_bytes:
                        return 0
                    # no piece holds it
                    total, following = total + len(char.encode()), self.INNER
                    break
            node = following
        while node != self.INNER:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return total


def model_pieces(model: str) -> tuple[list[str], bool]:
    """Pieces of a sentencepiece model, and whether it has a piece for each byte."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
    return pieces, sum(map(lib.is_byte, range(lib.get_piece_size()))) == 256


def marked_automaton(model: str, mark: str = MARK) -> LongestMatch:
    """Matches words that have the mark before them, by all pieces of a model."""
    pieces, by_bytes = model_pieces(model)
    return LongestMatch([p for p in pieces if p.startswith(mark)], pieces, by_bytes)


class WordCounter:
    """Counts of words, each with ``mark`` before it; remembers them by word."""

    def __init__(self, automaton: LongestMatch, mark: str = MARK):
        self._automaton, self._mark, self._now, self._before = automaton, mark, {}, {}

    def counts(self, words: list[bytes]) -> list[int]:
        try:
            return list(map(self._now.__getitem__, words))
        except KeyError:
            pass
        if len(self._now) > MOST_WORDS:
            self._now, self._before = {}, self._now
        now, found = self._now, []
        for word in words:
            n = now.get(word)
            if n is None:
                n = self._before.get(word)
                if n is None:
                    n = self._automaton.count(self._mark + word.decode())
                if len(word) <= LONGEST:
                    now[word] = n
            found.append(n)
        return found


@functools.lru_cache(maxsize=2)
def word_counter(model: str) -> WordCounter:
    """The worker process's counter for a model; tasks that follow each other share it."""
    return WordCounter(marked_automaton(model))


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of whole texts."""

    def worker():
        counter = word_counter(model)

        def each(text: bytes) -> dict:
            counts = counter.counts(text.split())
            unknown = counts.count(0)
            return {"n_words": len(counts), "n_tokens": sum(counts) + unknown, "n_unknown": unknown}

        return each

    return map_documents(docs, worker, "n_words long, n_tokens long, n_unknown long")
