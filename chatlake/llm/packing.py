"""Concatenate and cut: all documents in one stream of ids, cut into windows of fixed length.

First pass: every task tokenises its documents, writes the ids once and the running total of ids before
each document in that task's partition. Prefix sums over the partition totals (one row per partition, not
per document) give each partition's place in the stream. Second pass: each document knows its global
offset, and its ids are cut at the window borders; the pieces are the boundary records of the windows. No
row is shuffled; all windows but the last are full.

Null and empty texts are the single end id. Any text may be longer than a window. Repeated rows are packed
as often as they occur; an empty table gives no pieces. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.bpe import binary_rows
from chatlake.llm.common import slices
from chatlake.llm.pretokens import TEXT_BYTES, Encoder
from chatlake.session import cut_lineage

WINDOW = 1024
END_ID = 0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Pre-tokens given to the tokenizer at a time; its results take much more room than the ids.
WORDS = 4096
#: Pre-tokens that are one string for the tokenizer, and what stands between them.
JOINED, BETWEEN = 128, "\x00"

_READY: dict[str, Encoder] = {}


def tokenizer_ids(path: str) -> Encoder:
    """One tokenizer per Python worker; strings of special tokens are ordinary text."""
    if path not in _READY:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        split = tokenizer.pre_tokenizer
        # elsewhere a string of many pre-tokens may not be split into just these, or ids may not cover all bytes
        plain = isinstance(split, ByteLevel) and not split.add_prefix_space and tokenizer.normalizer is None
        plain = plain and all(tokenizer.token_to_id(char) is not None for char in ByteLevel.alphabet())
        _READY[path] = Encoder(joined_encode(tokenizer) if plain else lambda words: _rows(tokenizer, words))
    return _READY[path]


def _rows(tokenizer, words: list[str], size: int = WORDS) -> list[list[int]]:
    """The ids of each string; so many are encoded at a time."""
    ids: list[list[int]] = []
    for at in range(0, len(words), size):
        rows = tokenizer.encode_batch_fast(words[at : at + size], add_special_tokens=False)
        ids += [row.ids for row in rows]
    return ids


def joined_encode(tokenizer) -> Callable[[list[str]], Sequence]:
    """Ids of pre-tokens of a byte-level tokenizer, which is given many of them as one string.

    They are not searched for pre-tokens again, and the work that a string costs is shared by many. Tokens are as
    many bytes long as characters in the vocabulary, so the lengths tell which ids are whose.
    """
    from tokenizers import pre_tokenizers

    single = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    both = pre_tokenizers.Sequence([pre_tokenizers.Split(BETWEEN, "removed"), single])
    tokenizer.pre_tokenizer = both
    vocabulary = tokenizer.get_vocab()
    bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        bytes_of[i] = len(token)

    def encode(words: list[str]) -> Sequence:
        whole = np.frombuffer(BETWEEN.join(words).encode(), np.uint8)
        marks = np.flatnonzero(whole == ord(BETWEEN))
        if len(marks) != len(words) - 1:  # one holds the mark itself
            tokenizer.pre_tokenizer = single
            try:
                return _rows(tokenizer, words)
            finally:
                tokenizer.pre_tokenizer = both
        strings = [BETWEEN.join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        flat = np.fromiter(chain.from_iterable(_rows(tokenizer, strings, WORDS // JOINED)), np.uint32)
        ends = np.append(marks, len(whole)) - np.arange(len(words))
        until = np.searchsorted(np.cumsum(bytes_of[flat]), ends) + 1
        return flat, np.diff(until, prepend=0)

    return encode


def token_table(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, ids (without the end id), part and before: ids earlier in the partition. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        encode = tokenizer_ids(path)
        for batch in slices(batches, TEXT_BYTES):
            ids, offsets = encode(batch.column("text").to_pylist())
            rows = np.arange(batch.num_rows)
            starts = before + offsets[:-1] + rows
            before += len(ids) + batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    binary_rows(ids.astype("<u4"), offsets),
                    pa.array(np.full(batch.num_rows, part, np.int64)),
                    pa.array(starts),
                    pa.array(np.diff(offsets) + 1),
                ],
                ["doc_id", "ids", "part", "before", "doc_tokens"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, ids binary, part long, before long, doc_tokens long"
    return cut_lineage(docs.select("doc_id", "text").mapInArrow(run, schema))


def pack(docs: DataFrame, window: int = WINDOW, path: str = TOKENIZER) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, unsigned 32 bit), doc_tokens, sequence_id, offset."""
    tokens = token_table(docs, path)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    # one row of two numbers per partition of the first pass, so ids need not move to meet it
    placed = tokens.join(F.broadcast(bases), "part").select(
        "doc_id", "ids", "doc_tokens", (F.col("base") + F.col("before")).alias("place")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                place = batch.column("place").to_numpy()
                size = batch.column("doc_tokens").to_numpy()
                ends = np.cumsum(size)
                end = np.array([END_ID], "<u4").tobytes()
                joined = b"".join(x + end for x in batch.column("ids").to_pylist())
                stream = np.frombuffer(joined, "<u4")
                pieces = (place + size - 1) // window - place // window + 1
                row = np.repeat(np.arange(batch.num_rows), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = place[row] // window + nth
                first = np.maximum(place[row], sequence * window)
                last = np.minimum(place[row] + size[row], (sequence + 1) * window)
                start = first - place[row]
                bounds = np.concatenate([ends[row] - size[row] + start, ends[-1:]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)),
                        pa.array(start),
                        pa.array(last - first),
                        binary_rows(stream, bounds),
                        pa.array(size[row]),
                        pa.array(sequence),
                        pa.array(first - sequence * window),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(
        cut,
        f"doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
