"""Token ids of whole texts from a file of the tokenizers library."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Distinct chunks that a worker remembers in each of two generations, and the longest remembered one.
MOST_CHUNKS, LONGEST = 400_000, 400
#: Punctuation that may follow a word; none of it begins a contraction.
_AFTER = ".,!?*$%&#|:;)-"
_LATIN_END = "ɐ"


class WordEncoder:
    """Encodes chunk by chunk and remembers each chunk's ids.

    The file's own rules drop white space, lower the case and never join what
    white space separates, so the ids of a text are those of its chunks in
    turn.  A chunk of Latin letters, perhaps with punctuation after it, is
    one word for those rules and goes to the library's merge model at once;
    every other chunk goes through the whole library.
    What is remembered changes no result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._now: dict[bytes, bytes] = {}
        self._before: dict[bytes, bytes] = {}
        # how the library writes bytes as characters: printable ones as they are, others from 256 on
        printable = {b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)}
        others = iter(range(256, 512))
        self._letters = [chr(b) if b in printable else chr(next(others)) for b in range(256)]

    def encode(self, text: bytes) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self._special):
            lowered = text.lower()  # ASCII only
            text = text if any(s in lowered for s in self._special) else lowered
        chunks = text.split()
        try:
            ids = b"".join(map(self._now.__getitem__, chunks))
        except KeyError:
            ids = self._learn(chunks)
        return np.frombuffer(ids, "<u4")

    def _learn(self, chunks: list[bytes]) -> bytes:
        if len(self._now) > MOST_CHUNKS:
            self._now, self._before = {}, self._now
        now, before = self._now, self._before
        for chunk in {*chunks}.difference(now):
            if (ids := before.get(chunk)) is None:
                ids = self._ids(chunk)
            now[chunk] = ids
        ids = b"".join(map(now.__getitem__, chunks))
        for chunk in [c for c in chunks if len(c) > LONGEST]:
            now.pop(chunk, None)
        return ids

    def _ids(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        word = text.rstrip(_AFTER)
        if word.isalpha() and len(chunk) <= LONGEST and max(word) < _LATIN_END and "İ" not in word and unicodedata.is_normalized("NFC", word):
            if len(word) < len(text):
                return self._part(word) + self._part(text[len(word) :])
            word = word.lower()
            spelt = word if word.isascii() else "".join([self._letters[b] for b in word.encode()])
            return np.asarray([t.id for t in self._tokenizer.model.tokenize(spelt)], "<u4").tobytes()
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        chunk = text.encode()
        ids = self._now.get(chunk)
        if ids is None:
            ids = self._now[chunk] = self._before.get(chunk) or self._ids(chunk)
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker process's encoder for a file; tasks that follow each other share it."""
    return WordEncoder(path)
