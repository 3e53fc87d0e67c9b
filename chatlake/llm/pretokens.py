"""Texts as rows of token ids, where each distinct pre-token is encoded once per worker.

The pre-tokens of a slice of texts are found together, as runs of code points of one class; the rules below
are those of the byte-level pattern (letters, numbers or signs, each with one leading space; contractions;
white space up to the last one). Pre-tokens are found by a 64-bit hash and then compared code point by code
point, so two with one hash never share ids; ids of known ones are kept in flat arrays of bounded size, new ones
are encoded together. Very long ones are encoded where they stand and not remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import regex

from chatlake.llm.common import gather_spans, prefix_sums, span_hashes

#: Bytes of texts whose pre-tokens are found at a time; the arrays for that take about fifty times as much.
TEXT_BYTES = 1 << 18
#: Pre-tokens remembered per worker; beyond it the memory starts afresh. It only saves work.
MEMORY = 400_000
#: Code points remembered per worker, and those of the longest pre-token that is.
MEMORY_POINTS, LONGEST = 1 << 23, 1 << 12

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASSES:
        table = np.full(0x110000, _OTHER, np.uint8)
        every = np.arange(0x110000, dtype=np.uint32)
        # decoded as one: a string for each would take 80 MB in every worker
        points = every[(every < 0xD800) | (every >= 0xE000)].astype("<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            found = "".join(regex.findall(pattern + "+", points))
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; they tile the texts, which start at ``offsets`` (the last is the length)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _classes()[points]
    mark = np.empty(n, bool)
    mark[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=mark[1:])
    inner = offsets[offsets < n]
    mark[inner] = True
    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], n)
    kind = kinds[starts]
    last = np.zeros(n + 1, bool)
    last[offsets] = True  # the end of a text is the start of the next
    closing = last[ends]

    # white space before something else: all but its last code point is one pre-token ...
    spaces = (kind == _SPACE) & ~closing
    mark[ends[spaces & (ends - starts > 1)] - 1] = True
    # ... and the last, if a plain space, goes with what follows
    joined = spaces & (points[ends - 1] == 32)
    mark[ends[joined]] = False

    # contractions: an apostrophe that begins a match, then letters
    lead = np.zeros(len(starts), bool)
    lead[1:] = joined[:-1]
    marks = np.flatnonzero((points[starts] == 39) & (ends - starts == 1) & ~lead & ~closing)
    marks = marks[kind[marks + 1] == _LETTER] if len(marks) else marks
    if len(marks):
        at, end = ends[marks], ends[marks + 1]
        first = points[at]
        second = np.where(end - at > 1, points[np.minimum(at + 1, n - 1)], 0)
        taken = np.isin(first, [ord(c) for c in "stmd"]).astype(np.int64)
        pair = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e"))
        taken[pair | ((first == ord("l")) & (second == ord("l")))] = 2
        some = taken > 0
        mark[at[some]] = False
        rest = (at + taken)[some & (at + taken < end)]
        mark[rest] = True
    return np.flatnonzero(mark)


class HashTable:
    """Places of 64-bit hashes, found for many hashes at once (open addressing)."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.places = np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it is not held."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = hashes & mask
        held = self.keys[slot]
        found = np.where(held == hashes, self.places[slot], np.int32(-1))
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & mask
            held = self.keys[slot[open_]]
            hit = held == hashes[open_]
            found[open_[hit]] = self.places[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return found

    def add(self, hashes: np.ndarray) -> None:
        """New, distinct, non-zero hashes; they get the next places."""
        if 2 * (self.size + len(hashes)) > 1 << self.bits:
            old, places = self.keys, self.places
            self.bits = int(4 * (self.size + len(hashes)) - 1).bit_length()
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.places = np.zeros(1 << self.bits, np.int32)
            self._put(old[old != 0], places[old != 0])
        self._put(hashes, np.arange(self.size, self.size + len(hashes), dtype=np.int32))
        self.size += len(hashes)

    def _put(self, hashes: np.ndarray, places: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        slot = hashes & mask
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            done = self.keys[slot] == hashes
            self.places[slot[done]] = places[done]
            hashes, places = hashes[~done], places[~done]
            slot = (slot[~done] + np.uint64(1)) & mask


class Encoder:
    """Ids of whole texts. ``encode`` gives the ids of distinct pre-tokens: of each, or all in one array with their numbers."""

    def __init__(self, encode: Callable[[list[str]], Sequence]) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.table = HashTable()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.points = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths, self.places, self.sizes = (np.zeros(1 << 14, np.int64) for _ in range(4))
        self.used = self.used_points = 0

    def _flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(words)
        if isinstance(found, tuple):
            return found
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        if len(found) and isinstance(found[0], np.ndarray):
            return np.concatenate(found).astype(np.uint32), lengths
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        flat, lengths = self._flat(words)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first, last = self.table.size, self.table.size + len(words)
        ends = {"ids": self.used + len(flat), "points": self.used_points + len(points)}
        for name, size in (ends | dict.fromkeys(("starts", "lengths", "places", "sizes"), last)).items():
            old = getattr(self, name)
            if len(old) < size:
                setattr(self, name, np.concatenate([old, np.zeros(max(len(old), size), old.dtype)]))
        self.ids[self.used : ends["ids"]] = flat
        self.points[self.used_points : ends["points"]] = points
        self.starts[first:last] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:last] = lengths
        self.places[first:last] = self.used_points + np.cumsum(sizes) - sizes
        self.sizes[first:last] = sizes
        self.used, self.used_points = ends["ids"], ends["points"]
        self.table.add(hashes)

    def _same(self, known: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each remembered pre-token holds the very code points."""
        same = self.sizes[known] == sizes
        rows = np.flatnonzero(same)
        if len(rows) == len(starts) and int(sizes.sum()) == len(points):
            here, sizes_, from_ = points, sizes, self.places[known]  # they tile the texts
        else:
            sizes_, from_ = sizes[rows], self.places[known[rows]]
            here = points[gather_spans(starts[rows], sizes_)]
        # places of the remembered code points, one after the other; they fit 32 bits
        ends = np.cumsum(sizes_)
        there = np.repeat((from_ - (ends - sizes_)).astype(np.int32), sizes_)
        there += np.arange(len(there), dtype=np.int32)
        equal = here == self.points.take(there)
        if not equal.all():
            same[rows[np.searchsorted(ends, np.flatnonzero(~equal), side="right")]] = False
        return same

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids start (n + 1 offsets)."""
        if self.table.size > MEMORY or self.used_points > MEMORY_POINTS:
            self.clear()
        texts = [text or "" for text in texts]
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(text) for text in texts])]).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = pretoken_starts(points, offsets)
        sizes = np.diff(starts, append=len(points))
        spell = lambda rows: [whole[a : a + b] for a, b in zip(starts[rows].tolist(), sizes[rows].tolist(), strict=True)]
        hashes = np.maximum(span_hashes(prefix_sums(points), starts, starts + sizes), np.uint64(1))
        places = self.table.find(hashes)
        open_ = np.flatnonzero((places < 0) & (sizes <= LONGEST))
        if len(open_):
            new, first = np.unique(hashes[open_], return_index=True)
            self._learn(new, spell(open_[first]))
            places[open_] = self.table.find(hashes[open_])
        known = np.flatnonzero(places >= 0)
        fits = self._same(places[known], points, starts[known], sizes[known])
        at, lengths = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[known], lengths[known] = self.starts[places[known]], self.lengths[places[known]]
        held = self.ids
        # another pre-token's hash, or too long to remember
        apart = np.ones(len(starts), bool)
        apart[known[fits]] = False
        rows = np.flatnonzero(apart)
        if len(rows):
            flat, lengths[rows] = self._flat(spell(rows))
            at[rows] = self.used + np.cumsum(lengths[rows]) - lengths[rows]
            held = np.concatenate([self.ids[: self.used], flat])
        ids = held[gather_spans(at, lengths)]
        until = np.concatenate([[0], np.cumsum(lengths)])
        return ids, until[np.searchsorted(starts, offsets)]
