"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Distinct pre-tokens are put into padded matrices by length, one row each, starting from single bytes. In
each round every row merges its leftmost pair of lowest rank: ranks of pairs come from a hash table, the
row is compacted, and only the two pairs beside the merge are looked up again. Rows without a known pair
are done. That is the merge order of the public libraries, for any text. A matrix row costs the square of its
length, so a pre-token beyond ``WIDEST`` bytes is merged in a linked list with a heap of its pairs instead, in the
same order (lowest rank, then leftmost) and in n log n steps.

Null text is empty and has no ids. Texts and pre-tokens may be of any length. Repeated rows are encoded each; an empty table gives no rows. Only doc_id and text
of the input are looked at.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from chatlake.llm.common import gather_spans, map_texts, mix
from chatlake.llm.pretokens import TEXT_BYTES, Encoder, HashTable

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Cells of one matrix.
CELLS = 1 << 20
#: Bytes of the longest pre-token that is a row of a matrix.
WIDEST = 512
_NONE = np.int32(0x7FFFFFFF)


class Vocabulary:
    """Ranks of tokens and of the pairs that merge into them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            rows = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        lefts, rights, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    lefts.append(left)
                    rights.append(right)
                    merged.append(rank)
        self.table = HashTable()
        self.table.add(self._keys(np.array(lefts, np.int64), np.array(rights, np.int64)))
        self.merged = np.array(merged, np.int32)
        self.pairs = dict(zip(zip(lefts, rights, strict=True), merged, strict=True))
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(token) for token in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # mixing is one to one, so different pairs have different keys
        return mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a negative id is padding."""
        found = np.full(left.shape, _NONE, np.int32)
        real = (left >= 0) & (right >= 0)
        places = self.table.find(self._keys(left[real], right[real]))
        found[real] = np.where(places >= 0, self.merged[places], _NONE)
        return found

    def _merge(self, rows: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a matrix of single-byte ids, padded with -1."""
        result: list[np.ndarray] = [rows[:0]] * len(rows)
        active = np.arange(len(rows))
        ranks = self.rank(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else rows[:, :0]
        while len(active):
            width = rows.shape[1]
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(active), np.int64)
            lowest = ranks[np.arange(len(active)), best] if width > 1 else np.full(len(active), _NONE)
            done = lowest == _NONE
            if done.any():
                for at in np.flatnonzero(done):
                    row = rows[at]
                    result[active[at]] = row[row >= 0]
                keep = ~done
                rows, ranks, active, best, lowest = rows[keep], ranks[keep], active[keep], best[keep], lowest[keep]
                if not len(active):
                    break
            each = np.arange(len(active))
            columns = np.arange(width - 1)
            rows = np.take_along_axis(rows, columns + (columns > best[:, None]), 1)
            rows[each, best] = lowest
            if width == 2:
                ranks = rows[:, :0]
                continue
            columns = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), 1)
            left = best > 0
            ranks[each[left], best[left] - 1] = self.rank(rows[each[left], best[left] - 1], rows[each[left], best[left]])
            right = best < width - 2
            ranks[each[right], best[right]] = self.rank(rows[each[right], best[right]], rows[each[right], best[right] + 1])
        return result

    def _merge_long(self, row: np.ndarray) -> np.ndarray:
        """Ids of one row of single-byte ids: a list of neighbours, and a heap of pairs by rank and place."""
        ids = row.tolist()
        ranks = self.rank(row[:-1], row[1:])
        some = np.flatnonzero(ranks != _NONE)
        heap = list(zip(ranks[some].tolist(), some.tolist(), strict=True))
        heapq.heapify(heap)
        ranks, gone = [*ranks.tolist(), -1], -1
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        while heap:
            rank, at = heapq.heappop(heap)
            if ranks[at] != rank:  # one of the two has merged since
                continue
            second = after[at]
            ids[at], ids[second], ranks[second] = rank, gone, -1
            after[at] = after[second]
            if after[at] < len(ids):
                before[after[at]] = at
            for place in (before[at], at):
                if place < 0:
                    continue
                follows = after[place]
                found = self.pairs.get((ids[place], ids[follows]), -1) if follows < len(ids) else -1
                ranks[place] = found
                if found >= 0:
                    heapq.heappush(heap, (found, place))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokens, by matrices of rows of similar length."""
        data = [word.encode() for word in words]
        lengths = np.array([len(item) for item in data])
        flat = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        result: list[np.ndarray] = [flat[:0]] * len(words)
        order = np.argsort(lengths, kind="stable")
        short = int(np.searchsorted(lengths[order], WIDEST, side="right"))
        for place in order[short:].tolist():
            result[place] = self._merge_long(flat[starts[place] : starts[place] + lengths[place]])
        order = order[:short]
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            bucket = max(4, 1 << (width - 1).bit_length()) if width > 1 else 1
            until = int(np.searchsorted(lengths[order], bucket, side="right"))
            until = min(until, at + max(1, CELLS // bucket))
            chosen = order[at:until]
            width = int(lengths[chosen[-1]])
            rows = np.full((len(chosen), width), -1, np.int32)
            size = lengths[chosen]
            rows[np.arange(width) < size[:, None]] = flat[gather_spans(starts[chosen], size)]
            for place, ids in zip(chosen.tolist(), self._merge(rows), strict=True):
                result[place] = ids
            at = until
        return result

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        return self.bytes[gather_spans(self.starts[ids], self.lengths[ids])]


_READY: dict[str, tuple[Vocabulary, Encoder]] = {}


def vocabulary(path: str) -> tuple[Vocabulary, Encoder]:
    """One per Python worker."""
    if path not in _READY:
        known = Vocabulary(path)
        _READY[path] = known, Encoder(known.encode)
    return _READY[path]


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of an array as binary values; numbers are little-endian."""
    places = pa.py_buffer((offsets * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, places, pa.py_buffer(values)])


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids: unsigned 32-bit little-endian numbers."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = vocabulary(path)[1](batch.column("text").to_pylist())
        columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), binary_rows(ids.astype("<u4"), offsets)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {key}, n_tokens long, ids binary", TEXT_BYTES)


def decode(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """The rows of ``encode`` with the decoded bytes; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)[0]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [row or b"" for row in batch.column("ids").to_pylist()]
                ids = np.frombuffer(b"".join(rows), "<u4")
                until = np.concatenate([[0], np.cumsum(known.lengths[ids])])
                ends = np.concatenate([[0], np.cumsum([len(row) // 4 for row in rows])]).astype(np.int64)
                data = binary_rows(known.decode(ids), until[ends])
                yield pa.RecordBatch.from_arrays([*batch.columns, data], [*batch.schema.names, "data"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{fields}, data binary")
