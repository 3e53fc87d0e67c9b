"""What several operators of this subpackage share: folds, bounded samples, bytes and words as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))


def sample_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest key hash: the same ones in every run."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents.

    Only the bounded sample of ids is broadcast. A document labelled twice counts by its
    largest label, of rows with one id one counts, and rows without id or label do not count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    bounded = F.broadcast(sample_rows(known, "doc_id", rows))
    return docs.select("doc_id", "text").join(bounded, "doc_id").dropDuplicates(["doc_id"])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts (n + 1 offsets); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts hold about ``size`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column("text"))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def map_texts(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = SLICE_BYTES
) -> DataFrame:
    """Apply ``work`` to slices of bounded size; the frame needs a column named text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size):
            yield work(part)

    return df.mapInArrow(run, schema)


# -- hashes of byte spans: a polynomial over 2**64, from prefix sums ---------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES[0]) < length:
        size = 1 << int(length - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _TABLES[i] = np.cumprod(table, dtype=np.uint64)
    return _TABLES[0], _TABLES[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    powers, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xC2B2AE3D27D4EB4F)
    values ^= values >> np.uint64(32)
    return values


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal bytes give equal hashes, wherever they stand."""
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that stay inside one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.empty(len(mask), bool)
    begins[0] = True
    np.logical_not(mask[:-1], out=begins[1:])
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    begins[inner] = True
    begins &= mask
    starts = np.flatnonzero(begins)
    closes = np.empty(len(mask), bool)
    closes[-1] = True
    np.logical_not(mask[1:], out=closes[:-1])
    closes[inner - 1] = True
    closes &= mask
    return starts, np.flatnonzero(closes) + 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits, and every byte of a longer code point.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[32, 9, 10, 11, 12, 13]] = True


def gather_spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums_per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i, along the first axis; empty ranges give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
