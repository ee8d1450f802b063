"""Operator 4: repeated byte strings, grouped by linear suffix sorting.

A byte is removed if a string of ``size`` bytes covers it that also starts earlier:
in a smaller ``doc_id``, or earlier in the same document.

Every string of ``size`` bytes has an anchor, the least hash among its inner strings of
``size // 2`` bytes, so equal strings have equal anchors at equal places.
Neighbouring strings with one anchor share a context, a little longer
than ``size``.  Steps, each over all blocks of documents:

1. a count-min sketch of the anchors: those that occur once are done;
2. equal contexts: every one but the first is a repeat as a whole, and only contexts
   that share an anchor but differ go on;
3. of those, the strings that may match are cut out, and a suffix array of the
   distinct pieces, made by grouping, brings equal strings together.

An anchor that more than ``hot`` blocks hold is not gathered: its strings go one by one,
each at most once from a block, to ranges chosen by their own hash.

Hashes (of 128 bits in step 2, 96 for hot anchors) decide equality there; step 3 compares bytes.
Matches never cross documents and are judged on the input.  Rows with equal ``doc_id``
count as one document; a missing ``doc_id`` is smaller than any.  Missing text
is empty.  An empty table has no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import ANSWER, FACTORS, FRAGMENT, Docs, RangeHash, answers, cells_of, fragments, in_blocks, merge_sketches, mixed, read_docs, sketch_rows, to_table
from .suffix_array import suffix_array

_PLACE = 28  # bits of a place in a block
CONTEXT, STRING, PIECE = 1, 2, 3
#: Pieces of whole anchors are sorted together up to about so many bytes.
BATCH = 200_000


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        keys = np.minimum(keys[:-step], keys[step:])
        done += step
    return keys


class Contexts:
    """Strings, anchors and contexts of a block."""

    def __init__(self, docs: Docs, size: int, parts: int):
        self.data = data = np.frombuffer(b"\0".join([*docs.texts, b""]), np.uint8)
        lengths = np.asarray([len(t) for t in docs.texts], np.int64)
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        self.lengths = lengths
        hashes, inner = RangeHash(data), size // 2
        inside = np.zeros(max(0, len(data) - size + 1) + 1, np.int8)
        long = lengths >= size
        inside[self.begin[long]] += 1
        np.add.at(inside, self.begin[long] + lengths[long] - size + 1, -1)
        #: where a string starts
        self.at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        grams = hashes.fixed(inner)
        low = np.uint64((1 << _PLACE) - 1)
        least = _least((grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low), size - inner + 1)
        anchor = (least[self.at] & low).astype(np.int64) if len(self.at) else np.zeros(0, np.int64)
        anchor = self.at + ((anchor - self.at) & int(low))
        del least
        cut = np.flatnonzero(np.concatenate(([True], np.diff(anchor) != 0)))[: len(self.at)]
        #: of each context: first string's index, number of strings, first byte, one after the last byte
        self.first = cut
        self.strings = np.diff(np.append(cut, len(self.at)))
        self.start = self.at[cut]
        self.end = self.start + self.strings + size - 1
        self.offset = anchor[cut] - self.start
        self.anchor = grams[anchor[cut]]
        self.context = mixed(hashes.of(self.start, self.end) ^ (self.offset.astype(np.uint64) * FACTORS[0, 62]))
        self.hashes, self.size = hashes, size
        # anchors are least hashes, so their own high bits would all choose the first ranges
        self.cells = cells_of(mixed(self.anchor ^ FACTORS[0, 60]), parts)
        self.parts = (self.cells.cells[self.cells.of_key] >> np.uint64(32)).astype(np.int64) if len(cut) else np.zeros(0, np.int64)
        doc = np.searchsorted(self.begin, self.start, "right") - 1
        self.doc, self.place = docs.ids[doc], (self.start - self.begin[doc]).astype(np.int64)

    def split(self, counts: np.ndarray, hot: int) -> None:
        """Contexts to compare (the first of each in the block), and strings of hot anchors."""
        blocks = counts[self.cells.of_key]
        many = (blocks > 1) | (self.cells.counts[self.cells.of_key] > 1)
        self.plain = np.flatnonzero(many & (blocks <= hot))
        _, first, self.same = np.unique(self.context[self.plain], return_index=True, return_inverse=True)
        rank = np.argsort(self.parts[self.plain[first]], kind="stable")
        self.same = np.argsort(rank)[self.same]
        self.chosen = self.plain[first[rank]]
        self.whole = np.flatnonzero(blocks > hot)
        n = self.strings[self.whole]
        self.of = np.repeat(self.whole, n)
        self.nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.start[self.of] + self.nth
        string = self.hashes.of(start, start + self.size)
        check = mixed(self.anchor[self.of] ^ ((self.offset[self.of] - self.nth).astype(np.uint64) * FACTORS[0, 61]))
        string, first, self.same_string = np.unique(string, return_index=True, return_inverse=True)
        self.string, self.check, self.chosen_string = string, (check[first] & np.uint64(0xFFFFFFFF)).astype("<u4"), first

    def entries(self, block: int, parts: int) -> Iterator[tuple]:
        c = self.chosen
        yield from fragments(block, CONTEXT, self.parts[c], [self.anchor[c], self.context[c], self.doc[c], self.place[c]])
        k, f = self.of[self.chosen_string], self.chosen_string
        part = (self.string >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # strings are sorted by hash
        yield from fragments(block, STRING, part.astype(np.int64), [self.string, self.check, self.doc[k], self.place[k] + self.nth[f]])

    def pieces(self, block: int, codes: np.ndarray) -> Iterator[tuple]:
        """Contexts with code 2: header and bytes."""
        c = self.chosen[codes == 2]
        parts = self.parts[c]
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(c)] if len(c) else []
        for a, b in zip(cuts, cuts[1:]):
            own = c[a:b]
            body = b"".join(self.data[s:e].tobytes() for s, e in zip(self.start[own].tolist(), self.end[own].tolist()))
            head = [np.asarray([b - a], "<i8"), self.anchor[own], self.doc[own], self.place[own], self.strings[own].astype("<i8")]
            yield block, int(parts[a]), PIECE, b"".join(x.tobytes() for x in head) + body

    def repeated(self, codes: np.ndarray, string_codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """For each string of the block: does it also start earlier?"""
        out = np.zeros(len(self.at), bool)
        n = self.strings
        code = codes[self.same].copy()
        first = self.chosen[self.same]
        code[(self.doc[self.plain] != self.doc[first]) | (self.place[self.plain] != self.place[first])] = 1
        all_of = self.plain[code == 1]
        out[np.repeat(self.first[all_of] - np.cumsum(n[all_of]) + n[all_of], n[all_of]) + np.arange(n[all_of].sum())] = True
        some = self.chosen[codes == 2]
        out[np.repeat(self.first[some] - np.cumsum(n[some]) + n[some], n[some]) + np.arange(n[some].sum())] = flags
        # the same place of a repeated row
        for k in np.flatnonzero((code == 2) & (self.plain != first)).tolist():
            here, there = self.first[self.plain[k]], self.first[first[k]]
            out[here : here + n[first[k]]] = out[there : there + n[first[k]]]
        place = self.place[self.of] + self.nth
        kept = self.chosen_string[self.same_string]
        again = (string_codes[self.same_string] > 0) | (self.doc[self.of] != self.doc[self.of[kept]]) | (place != place[kept])
        out[self.first[self.of] + self.nth] |= again
        return out


def _compare(table: pa.Table) -> pa.Table:
    """Codes. 0: differs from all others; 1: also starts earlier; 2: the first of its kind, others share its anchor."""
    part, rows = table.column("part")[0].as_py(), []
    blocks, kinds, data = (table.column(c).to_pylist() for c in ("block", "kind", "data"))
    for kind in (CONTEXT, STRING):
        own = [(b, d) for b, k, d in zip(blocks, kinds, data, strict=True) if k == kind]
        if not own:
            continue
        types = ("<u8", "<u8" if kind == CONTEXT else "<u4", "<i8", "<i8")
        wide = sum(np.dtype(t).itemsize for t in types)
        columns, sizes = [[], [], [], []], []
        for _, d in own:
            n, at = len(d) // wide, 0
            sizes.append(n)
            for c, t in zip(columns, types, strict=True):
                c.append(np.frombuffer(d, t, n, at))
                at += n * np.dtype(t).itemsize
        a, b, doc, place = (np.concatenate(c) for c in columns)
        order = np.lexsort((place, doc, b, a))
        a, b, doc, place = a[order], b[order], doc[order], place[order]
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new = new_a | np.concatenate(([True], b[1:] != b[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        later = (doc != doc[first]) | (place != place[first])
        kinds_of_a = np.bincount(np.cumsum(new_a) - 1, new)[np.cumsum(new_a) - 1]
        code = np.where(later, 1, np.where(kinds_of_a > 1, 2, 0)).astype(np.uint8)
        back = np.empty_like(code)
        back[order] = code
        at = 0
        for (block, _), n in zip(own, sizes, strict=True):
            rows.append((block, part, kind, back[at : at + n].tobytes()))
            at += n
    return to_table(rows)


def _classes(pieces: list[bytes], size: int) -> list[np.ndarray]:
    """For each piece, numbers of its strings of ``size`` bytes, equal for equal strings; by a suffix array."""
    data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    symbols = data.astype(np.int64) + 1
    lengths = np.asarray([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    symbols[ends] = 0
    valid = np.zeros(len(data), bool)
    for e, n in zip(ends.tolist(), lengths.tolist()):
        valid[e - n : e - size + 1] = True
    order = np.asarray(suffix_array(symbols.tolist()), np.int64)
    order = order[valid[order]]
    views = np.lib.stride_tricks.sliding_window_view(data, size)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 20_000):
        part = order[at - 1 : at + 20_000]
        new[at : at + len(part) - 1] = (views[part[1:]] != views[part[:-1]]).any(axis=1)
    number = np.zeros(len(data), np.int64)
    number[order] = np.cumsum(new)
    return [number[e - n : e - size + 1] for e, n in zip(ends.tolist(), lengths.tolist())]


def _sort_pieces(size: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        blocks, counts, heads, bodies = table.column("block").to_pylist(), [], [], []
        for d in table.column("data").to_pylist():
            n = int(np.frombuffer(d, "<i8", 1)[0])
            counts.append(n)
            heads.append(np.frombuffer(d, "<i8", 4 * n, 8).reshape(4, n))
            bodies.append(d[8 + 32 * n :])
        anchor, doc, place, strings = np.concatenate(heads, axis=1)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        length = strings + size - 1
        begin = np.cumsum(length) - length
        of = np.repeat(np.arange(len(anchor)), strings)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
        start = begin[of] + nth
        # strings with no other of the same hash need no sorting
        _, same, several = np.unique(RangeHash(data).of(start, start + size), return_inverse=True, return_counts=True)
        maybe = np.flatnonzero(several[same] > 1)
        flags = np.zeros(len(of), np.uint8)
        if len(maybe):
            cut = np.flatnonzero(np.concatenate(([True], (np.diff(maybe) != 1) | (np.diff(of[maybe]) != 0))))
            runs = np.stack([maybe[cut], np.append(maybe[cut[1:] - 1], maybe[-1])], axis=1)
            runs = runs[np.argsort(anchor[of[runs[:, 0]]], kind="stable")]
            at = 0
            while at < len(runs):
                stop, taken, pieces, which = at, 0, {}, []
                while stop < len(runs) and (taken < BATCH or anchor[of[runs[stop, 0]]] == anchor[of[runs[stop - 1, 0]]]):
                    a, b = runs[stop].tolist()
                    text = data[start[a] : start[b] + size].tobytes()
                    if text not in pieces:
                        pieces[text] = len(pieces)
                        taken += len(text)
                    which.append(pieces[text])
                    stop += 1
                numbers = _classes(list(pieces), size)
                own = np.concatenate([np.arange(a, b + 1) for a, b in runs[at:stop].tolist()])
                number = np.concatenate([numbers[w] for w in which])
                spot = place[of[own]] + nth[own]
                order = np.lexsort((spot, doc[of[own]], number))
                o_number, o_doc, o_spot = number[order], doc[of[own]][order], spot[order]
                new = np.concatenate(([True], o_number[1:] != o_number[:-1]))
                first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                flags[own[order]] = (o_doc != o_doc[first]) | (o_spot != o_spot[first])
                at = stop
        rows, at = [], 0
        for block, head in zip(blocks, heads, strict=True):
            n = int(head[3].sum())
            rows.append((block, part, PIECE, flags[at : at + n].tobytes()))
            at += n
        return to_table(rows)

    return run


def remove_repeats(docs: DataFrame, size: int = 100, block_bytes: int = 4_000_000, hot: int = 64, with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the ``kept`` bytes."""
    if hot > 250:
        raise ValueError("hot: at most 250")
    rows, blocks = in_blocks(docs, block_bytes)
    parts = -(-blocks // 4)

    def read(left: pa.Table, right: pa.Table) -> tuple[Docs, Contexts]:
        found = read_docs(left) if left.num_rows else Docs(np.zeros(0, np.int64), [])
        contexts = Contexts(found, size, parts)
        contexts.split(np.frombuffer(answers(right, 0), np.uint8), hot)
        return found, contexts

    def codes(right: pa.Table, kind: int) -> np.ndarray:
        return np.frombuffer(answers(right, kind), np.uint8)

    def sketch(table: pa.Table) -> pa.Table:
        return to_table(sketch_rows(table.column("block")[0].as_py(), Contexts(read_docs(table), size, parts).cells))

    def entries(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return to_table(read(left, right)[1].entries(key[0].as_py(), parts))

    def pieces(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return to_table(read(left, right)[1].pieces(key[0].as_py(), codes(right, CONTEXT)))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found, contexts = read(left, right)
        starts = contexts.at[contexts.repeated(codes(right, CONTEXT), codes(right, STRING), codes(right, PIECE) > 0)]
        cover = np.zeros(len(contexts.data) + 1, np.int32)
        cover[starts] += 1
        cover[starts + size] -= 1
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        out = []
        for a, n, text in zip(contexts.begin.tolist(), contexts.lengths.tolist(), found.texts, strict=True):
            own = gone[a : a + n]
            removed = int(own.sum())
            kept = contexts.data[a : a + n][~own].tobytes() if removed else text
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0
            out.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        n, removed, spans, sha, kept = zip(*out, strict=True) if out else ((),) * 5
        long = pa.int64()
        columns = {"doc_id": found.id_column(), "n_bytes": pa.array(n, long), "n_removed": pa.array(removed, long), "n_spans": pa.array(spans, long), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_bytes else {}))

    def ask(side: DataFrame, function, schema: str) -> DataFrame:
        return rows.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(function, schema)

    known = merge_sketches(rows.groupBy("block").applyInArrow(sketch, FRAGMENT))
    known = known.unionByName(ask(known, entries, FRAGMENT).groupBy("part").applyInArrow(_compare, ANSWER))
    known = known.unionByName(ask(known, pieces, FRAGMENT).groupBy("part").applyInArrow(_sort_pieces(size), ANSWER))
    return ask(known, finish, schema)
