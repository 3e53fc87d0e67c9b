"""Spelling variants: each word and the commoner word that it is one edit away from.

The vocabulary is counted once over all texts. Its words go into blocked Bloom filters, one per word length,
which every task holds. Each word then looks for its neighbours by trying out its edits: all deletions of one
code point, and all replacements by a later code point of the alphabet (an insertion is a deletion seen from the
longer word, a replacement by an earlier code point one seen from the other word). Hashes of edits are sums over
code points, so an edited word costs a few operations and is spelt out only if the filter of its length has it.
Only these positives move, to an exact join with the vocabulary that removes the false ones; no word meets the
other words.

A filter holds ``FILTER_BITS`` bits a word, and all filters of one pass ``FILTER_BYTES`` bytes at most: a larger
vocabulary is probed in several passes, each with the filters of one part of it, so what is broadcast stays
bounded and the rate of false positives stays what it is.

A word's form is at least twice as common as the word, so forms followed from word to word never return, and
after k rounds of joins 2**k steps are done.

Null texts have no words, a null doc_id counts as empty text; texts may be of any length. Repeated rows count as
often as they occur. An empty table gives no rows. Among equally common neighbours the first in code-point order
is the form. Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import mix
from chatlake.session import cut_lineage

RUN = "[A-Za-zÀ-ÿ]+"
#: Code points that a lower-cased run may hold.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run whose hash this number divides loses one code point.
NOISE = 97
MIN_CHARS, MIN_COUNT = 5, 3
#: How many times as common as a word its form has to be.
TIMES = 2

FILTER_BITS = 24
FILTER_BYTES = 64 << 20
#: Bits that a word sets, all in one block of 64.
_SET = 5
#: Blocks that are made by one task at a time.
_SEGMENT = 8192
#: Edits that are tried at once.
_EDITS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
#: Words that one task probes.
_TASK_WORDS = 20_000


def runs(docs: DataFrame) -> DataFrame:
    """word: every lower-cased run of letters; now and then, as its hash says, without one code point."""
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"),
    ).select("key", F.translate("run", UPPER, LOWER).alias("run"))
    # a row is one run from here on, so the hash is computed once for it
    hashed = found.select("run", F.crc32(F.concat_ws(":", "key", "run")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the distinct words with their counts."""
    counted = runs(docs).where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _powers(length: int) -> np.ndarray:
    table = np.full(length + 1, _BASE, np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


def _matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of the words of each length, a row a word, and the places of these words."""
    lengths = np.array([len(word) for word in words], np.int64)
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        joined = "".join([words[i] for i in places])
        yield np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(-1, length), places


def _sums(points: np.ndarray) -> np.ndarray:
    """What a word's hash is mixed from: the sum of its code points, each times a power that its place gives."""
    return (points.astype(np.uint64) * _powers(points.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _hash(sums: np.ndarray) -> np.ndarray:
    """Never zero, which marks edits that are not tried."""
    return np.maximum(mix(sums), np.uint64(1))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The bits a word sets in its block."""
    found = np.zeros(hashes.shape, np.uint64)
    for i in range(_SET):
        found |= np.uint64(1) << ((hashes >> np.uint64(6 * i)) & np.uint64(63))
    return found


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _in_part(hashes: np.ndarray, part: int, parts: int) -> np.ndarray:
    return mix(hashes) % np.uint64(parts) == np.uint64(part)


def _filters(words: DataFrame, blocks: dict[int, int], part: int, parts: int) -> dict[int, np.ndarray]:
    """The filter of each length over the words of one part; segments of blocks are made in tasks."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points, _ in _matrices(batch.column("word").to_pylist()):
                hashes = _hash(_sums(points))
                hashes = hashes[_in_part(hashes, part, parts)]
                length = points.shape[1]
                at = _block(hashes, blocks[length]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), length, np.int32)),
                        pa.array(at // _SEGMENT),
                        pa.array(at % _SEGMENT),
                        pa.array(_bits(hashes).view(np.int64)),
                    ],
                    ["length", "segment", "at", "bits"],
                )

    placed = words.select("word").mapInArrow(keys, "length int, segment long, at long, bits long")
    # words of one block are put together before they move; a segment then has one row a block at most
    blocked = placed.groupBy("length", "segment", "at").agg(F.bit_or("bits").alias("bits"))
    rows = blocked.groupBy("length", "segment").agg(F.collect_list(F.struct("at", "bits")).alias("held"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held = row.column("held").flatten()
                at = held.field("at").to_numpy()
                segment = np.zeros(at.max() + 1, np.int64)
                segment[at] = held.field("bits").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [row.column("length"), row.column("segment"), pa.array([segment.tobytes()], pa.binary())],
                    ["length", "segment", "data"],
                )

    found = {length: np.zeros(count, np.uint64) for length, count in blocks.items()}
    for row in rows.mapInArrow(pack, "length int, segment long, data binary").toLocalIterator():
        first, segment = row["segment"] * _SEGMENT, np.frombuffer(row["data"], np.uint64)
        found[row["length"]][first : first + len(segment)] = segment
    return found


def edits(
    points: np.ndarray, shorter: bool = True, same: bool = True
) -> Iterator[tuple[int, np.ndarray, Callable[[np.ndarray], np.ndarray]]]:
    """Of words of one length: a length, hashes of edited words (one row a word), and how to spell chosen ones.

    ``shorter`` asks for deletions, ``same`` for replacements. Every edited word comes once: of equal neighbours
    only the first is deleted, and a code point is replaced by later ones only.
    """
    n, length = points.shape
    powers = _powers(length)
    terms = points.astype(np.uint64) * powers[:-1]
    total = terms.sum(axis=1, dtype=np.uint64)

    if shorter and length > 1:
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        deleted = (before - terms) + (total[:, None] - before) * _INVERSE
        first = np.ones(points.shape, bool)
        first[:, 1:] = points[:, 1:] != points[:, :-1]

        def without(chosen: np.ndarray) -> np.ndarray:
            rows, at = chosen // length, chosen % length
            columns = np.arange(length - 1)
            return points[rows[:, None], columns + (columns >= at[:, None])]

        yield length - 1, np.where(first, _hash(deleted), np.uint64(0)), without

    for i in range(length if same else 0):

        def replaced(chosen: np.ndarray, i: int = i) -> np.ndarray:
            rows = points[chosen // len(ALPHABET)].copy()
            rows[:, i] = ALPHABET[chosen % len(ALPHABET)]
            return rows

        change = (ALPHABET[None, :].astype(np.uint64) - points[:, i, None].astype(np.uint64)) * powers[i]
        hashes = _hash(total[:, None] + change)
        yield length, np.where(ALPHABET[None, :] > points[:, i, None], hashes, np.uint64(0)), replaced


def _probe(
    words: list[str], filters: dict[int, np.ndarray], sizes: dict[int, int], part: int, parts: int
) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places of words, and for each an edited word that a filter has."""
    for all_points, places in _matrices(words):
        own = all_points.shape[1]
        # the only word of its length has no neighbour of that length
        tried = {"shorter": own - 1 in sizes, "same": sizes[own] > 1}
        step = max(1, _EDITS // max(len(ALPHABET), own))
        for start in range(0, len(places), step):
            points = all_points[start : start + step]
            for length, hashes, spell in edits(points, **tried):
                flat = hashes.ravel()
                some = np.flatnonzero(flat)
                flat = flat[some]
                bits = _bits(flat)
                hit = filters[length][_block(flat, len(filters[length]))] & bits == bits
                if parts > 1:
                    hit &= _in_part(flat, part, parts)
                chosen = some[hit]
                if not len(chosen):
                    continue
                spelt = np.ascontiguousarray(spell(chosen).astype("<u4")).tobytes().decode("utf-32-le")
                found = [spelt[k : k + length] for k in range(0, len(spelt), length)]
                yield places[start + chosen // hashes.shape[1]], found


def near_words(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, near, near_n: both directions of every pair of words that are one edit apart."""
    spark = words.sparkSession
    counted = words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("words"))
    sizes = {row["length"]: row["words"] for row in counted.collect()}
    total = sum(sizes.values())
    parts = max(1, -(-total * FILTER_BITS // (8 * filter_bytes)))
    blocks = {length: max(1, -(-size * FILTER_BITS // (64 * parts))) for length, size in sizes.items()}
    if not sizes:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))

    dealt = words.repartition(-(-total // _TASK_WORDS), "word")

    def positives(part: int) -> DataFrame:
        held = spark.sparkContext.broadcast(_filters(words, blocks, part, parts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for places, near in _probe(texts, held.value, sizes, part, parts):
                    columns = [pa.array([texts[i] for i in places]), pa.array(counts[places]), pa.array(near)]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "n", "near"])

        found = dealt.mapInArrow(run, "word string, n long, near string")
        # each pass is done before the filters of the next one are made
        return found if parts == 1 else cut_lineage(found)

    found = positives(0)
    for part in range(1, parts):
        found = found.unionAll(positives(part))
    pairs = found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    there = F.struct(F.col("word").alias("word"), F.col("near").alias("near"), F.col("near_n").alias("near_n"))
    back = F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.explode(F.array(there, back)).alias("p")).select("p.*")


def roots(links: DataFrame) -> DataFrame:
    """word, root: where the forms of a word lead; ``links`` has the words that have a form."""
    ways = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ways = cut_lineage(
            ways.select("word", "root")
            .join(further, "root", "left")
            .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        )
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: float = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = cut_lineage(vocabulary(docs, min_chars, min_count))
    first: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("first"))
    common = -F.col("first.less") >= times * F.col("n")
    formed = cut_lineage(
        words.join(best, "word", "left").select(
            "word",
            F.when(common, F.col("first.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, -F.col("first.less")).alias("form_n"),
        )
    )
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
