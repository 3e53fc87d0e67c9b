"""Phrases whose words keep together, mined from counts of the longest windows alone.

Every word occurrence gives one row: the word and the words that follow it in its piece, as lead columns of the
word list, padded with null at the end of the piece. Equal windows are counted once, and a ROLLUP over language
and lead columns sums these counts over ever shorter prefixes: a prefix of k words sums all windows that begin
with it, which is the number of its occurrences. No shorter n-gram is ever exploded from the text.

A phrase's score compares its count with those of its two parts, at the cut where they explain it best. Parts of
a frequent phrase are at least as frequent, so counts below the threshold leave before any join. Phrases that
mostly stand inside one longer phrase are left out.

Null text is empty and has no words; a null language is ``und``. Texts of any length are split where they stand;
repeated rows count as often as they occur; an empty table gives no rows. Ties of score and count go to the
phrase that is first in byte order. Other columns of the input are not looked at. All arithmetic is on integers
and decimals without rounding, for up to 10**13 occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import LOWER as LOWER_BYTES
from chatlake.llm.common import runs, sample_rows, slices, text_bytes
from chatlake.session import cut_lineage

#: A-Z are lower-cased by the same table; in SQL the two texts say so.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "und"
#: Bytes that end a piece, and bytes between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
_WORD, _SPACE, _BREAK = range(3)
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = _SPACE
_KIND[list(BREAKS)] = _BREAK

MAX_WORDS = 3
MIN_COUNT = 10
#: A phrase goes if this share (in per cent) of its occurrences lies inside one longer phrase.
INSIDE = 50
TOP = 2000
#: Bytes of text whose windows are combined at once.
SLICE = 4 << 20
#: Documents that are looked at for prefixes with a great share of all windows; which share is great (one in so
#: many), and over how many groups the windows of such a prefix are spread.
HOT_ROWS, HOT_SHARE, SALTS = 1000, 500, 256
_SCALE = 1_000_000


def _places(words: int) -> list[str]:
    return [f"w{i}" for i in range(1, words + 1)]


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about ``size`` bytes of text; a longer text stands alone."""
    held, held_bytes = [], 0
    for part in slices(batches, size):
        part_bytes = part.column("text").nbytes
        if held and held_bytes + part_bytes > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, held_bytes = [], 0
        held.append(part)
        held_bytes += part_bytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _columns(texts: pa.Array, langs: pa.Array, words: int) -> pa.RecordBatch:
    """prefix, last, c: the distinct windows of some texts in order, each with how often it occurs."""
    data, offsets = text_bytes(texts)
    kinds = _KIND[data]
    starts, ends = runs(kinds == _WORD, offsets)
    # breaks and text borders before a word number its piece
    broken = np.cumsum(kinds == _BREAK, dtype=np.int32)
    row = np.searchsorted(offsets, starts, side="right") - 1
    piece = row + (broken[starts] if len(starts) else starts)
    held = pa.py_buffer(LOWER_BYTES[data[kinds == _WORD]])
    bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32))
    spelt = pa.Array.from_buffers(pa.string(), len(starts), [None, bounds, held]).dictionary_encode()
    tongue = langs.fill_null(UNKNOWN).dictionary_encode()

    # numbers in the order of the words, zero for what lies beyond the end of the piece
    number, ordered = _ordered(spelt)
    lang_number, lang_ordered = _ordered(tongue)
    lead = np.zeros((len(starts), words), np.int64)
    for k in range(words):
        same = piece[k:] == piece[: len(piece) - k]
        lead[: len(same), k] = np.where(same, number[k:] + 1, 0)
    # one number for each window, as wide as these words need; wider ones are ranked on the way
    key = lang_number[row]
    for k in range(words):
        if int(key.max(initial=0) + 1) * (len(ordered) + 1) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * (len(ordered) + 1) + lead[:, k]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    spelt = []
    for k in range(words):
        places = lead[first, k]
        spelt.append(ordered.take(pa.array(places - 1, mask=places == 0)))
    tongues = lang_ordered.take(pa.array(lang_number[row[first]]))
    prefix = pc.binary_join_element_wise(*spelt[:-1], tongues, "\n", null_handling="replace", null_replacement="")
    return pa.RecordBatch.from_arrays([prefix, spelt[-1], pa.array(count)], ["prefix", "last", "c"])


def _ordered(coded: pa.DictionaryArray) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones in byte order, and these."""
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def longest_windows(docs: DataFrame, words: int = MAX_WORDS) -> DataFrame:
    """prefix, last, c: every word with its lead columns, and how often this window occurs in a slice of texts.

    All columns but the last are held in one text, a line each and the language after them, which is half as
    long as a row of columns; beyond the end of the piece a line is empty, and the last column null. Windows of a
    slice come in order, so neighbours are alike and what moves is small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, SLICE):
            yield _columns(part.column("text"), part.column("lang"), words)

    chosen = docs.select("text", F.col("lang").cast("string").alias("lang"))
    return chosen.mapInArrow(run, "prefix string, last string, c long")


def hot_prefixes(docs: DataFrame, words: int = MAX_WORDS, rows: int = HOT_ROWS, share: int = HOT_SHARE) -> list[str]:
    """Prefixes that hold more than one in ``share`` windows of a sample of ``rows`` documents: ``share`` at most.

    Only where rows go depends on them, no count does.
    """
    ids = F.broadcast(sample_rows(docs.select("doc_id"), "doc_id", rows).dropDuplicates())
    windows = longest_windows(docs.join(ids, "doc_id"), words)
    sizes = cut_lineage(windows.groupBy("prefix").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return [row["prefix"] for row in sizes.where(F.col("size") * share > total).collect()]


def phrase_counts(docs: DataFrame, words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, w1 .. wk, size, f: occurrences of every phrase of 1 to k words, and of all words at size 0.

    Phrases rarer than ``min_count`` are not held.
    """
    names = _places(words)
    hot = hot_prefixes(docs, words)
    # windows of one prefix meet in one task, those of a hot one in many
    windows, key, salted = longest_windows(docs, words), ["prefix"], F.lit(False)
    if hot:
        spread = F.pmod(F.xxhash64("last"), F.lit(SALTS)).cast("int")
        windows = windows.withColumn("salt", F.when(F.col("prefix").isin(hot), spread).otherwise(-1))
        key, salted = ["prefix", "salt"], F.col("salt") >= 0
    windows = windows.repartition(*key).groupBy(*key, "last").agg(F.sum("c").alias("c"))
    # a rare window counts for its prefixes only, and a rare prefix for shorter ones, so that few keys are left to sum
    together = F.sum("c").over(Window.partitionBy(*key))
    lines = lambda k: F.substring_index("prefix", "\n", k)
    lang = F.substring("prefix", F.char_length(lines(words - 1)) + 2, F.char_length("prefix"))
    shorter = F.concat_ws("\n", *([lines(words - 2)] if words > 2 else []), F.lit(""), lang)
    folded = windows.withColumn("held", together).select(
        F.when(salted | (F.col("held") >= min_count), F.col("prefix")).otherwise(shorter).alias("prefix"),
        F.when(F.col("c") >= min_count, F.col("last")).alias("last"),
        "c",
    )
    split = F.split("prefix", "\n", words)
    columns = folded.groupBy("prefix", "last").agg(F.sum("c").alias("c")).select(
        split[words - 1].alias("lang"),
        *[F.nullif(split[i], F.lit("")).alias(name) for i, name in enumerate(names[:-1])],
        F.col("last").alias(names[-1]),
        "c",
    )
    level = F.lit(words + 1) - F.bit_count(F.grouping_id())
    summed = columns.rollup("lang", *names).agg(F.sum("c").alias("f"), level.cast("int").alias("level"))
    size = F.col("level") - 1
    # a row whose last place is padded is no phrase: the shorter prefix counts it
    real = reduce(lambda a, i: a & ((size < i) | F.col(names[i - 1]).isNotNull()), range(1, words + 1), F.lit(True))
    kept = (F.col("level") > 0) & real & ((F.col("f") >= min_count) | (size == 0))
    return summed.where(kept).select("lang", *names, size.alias("size"), "f")


def mine(
    docs: DataFrame, words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside: int = INSIDE, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to ``words`` words of each language."""
    names = _places(words)
    counts = cut_lineage(phrase_counts(docs, words, min_count))
    # a phrase is known by its words joined; words hold no spaces, so size and text decide it
    known = counts.where("size > 0").select("lang", F.concat_ws(" ", *names).alias("phrase"), "size", "f")
    lists = counts.where("size > 1").select(
        "lang", F.slice(F.array(*names), F.lit(1), F.col("size")).alias("ws"), F.concat_ws(" ", *names).alias("phrase"),
        "size", F.col("f").alias("a"),
    )
    part = lambda start, length: F.concat_ws(" ", F.slice("ws", start, length))
    cuts = lists.select("lang", "phrase", "ws", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"),
        part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    heads = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = "cast({} as decimal(13,0))"
    a, left, right = (exact.format(c) for c in ("a", "l", "r"))
    score = F.expr(f"({a} * {a} * cast({_SCALE} as decimal(7,0))) div ({left} * {right})")
    scored = (
        cuts.join(heads, ["lang", "first"])
        .join(tails, ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    )
    return best_of(scored, lists, counts, words, inside, top)


def best_of(scored: DataFrame, lists: DataFrame, counts: DataFrame, words: int, inside: int, top: int) -> DataFrame:
    """The scored phrases that do not mostly stand inside a longer one, ranked per language."""
    size, length = F.col("size"), F.col("m")
    shorter = lists.where("size > 2").select(
        "lang", "ws", "size", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), size - 1)).alias("m")
    )
    shorter = shorter.select("lang", "ws", "longer", "m", F.explode(F.sequence(F.lit(1), size - length + 1)).alias("at"))
    covering = (
        shorter.select("lang", F.concat_ws(" ", F.slice("ws", F.col("at"), length)).alias("phrase"), "longer")
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    free = scored.join(covering, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))
    )
    # each task keeps its best of a language before rows meet, so a language may be of any size
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = free.select("lang", "phrase", "a", "best.*").withColumn("rank", F.row_number().over(order))
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return (
        ranked.where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
    )
