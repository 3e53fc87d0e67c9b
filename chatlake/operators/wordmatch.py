"""Pairs of words that match: a similarity join in place of testing every word against every other.

Two words match if one holds the other, or if their matching blocks make up 0.7 of both. Both are found by keys:

* A word inside another begins with letters that stand somewhere in it. The key is the whole word up to
  ``GRAM`` letters, or its first ``GRAM`` letters; the other side has a key for each of its stretches.
* Matching blocks cannot hold more letters than both words have in common. Words of lengths m and n need
  t = ceil(0.35 (m + n)) common letters, so of their letters in one fixed order, the first m - t + k and
  n - t + k share at least k. The key is the two lengths and k such letters (a letter's second occurrence counts
  as another letter).

What shares a key is only a candidate and is verified. Matching is not symmetric in rare cases, as the search for
blocks starts from the second word, so both directions are tested.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import ceil, floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions.topics import MATCH_RATIO, words_match
from chatlake.session import cut_lineage

GRAM = 4
#: Letters of a key, by the longer of both words: long words have many letters to choose from.
SHARED = ((20, 4), (30, 3), (60, 2))

_RATIO = Fraction(str(MATCH_RATIO))


def held_keys(word: str) -> set[str]:
    """Keys of what the word may hold."""
    found = {word[i : i + n] for n in range(1, GRAM + 1) for i in range(len(word) - n + 1)}
    return found


def _letters(word: str) -> list[str]:
    """The letters in a fixed order that puts rarer ones first in most scripts; a repeated letter is numbered."""
    seen: Counter[str] = Counter()
    found = []
    for letter in sorted(word, reverse=True):
        seen[letter] += 1
        found.append(f"{letter}{seen[letter]}")
    return found


def block_keys(word: str) -> Iterator[str]:
    """Keys under which the word meets all words whose blocks may match enough of both."""
    spelt, own = _letters(word), len(word)
    for other in range(ceil(own * _RATIO / (2 - _RATIO)), floor(own * (2 - _RATIO) / _RATIO) + 1):
        common = ceil(_RATIO * (own + other) / 2)
        if common > min(own, other):
            continue
        low, high = sorted((own, other))
        shared = min(common, next((letters for longest, letters in SHARED if high <= longest), 1))
        for chosen in combinations(spelt[: own - common + shared], shared):
            yield f"{low} {high} {' '.join(chosen)}"


def matching_words(words: DataFrame, group: list[str]) -> DataFrame:
    """group, first, second: all pairs of words of a group that match, every word with itself included.

    ``words`` has the group's columns and ``word``; repeated rows count once, empty words match nothing here.
    """
    distinct = cut_lineage(words.select(*group, "word").where(F.length("word") > 0).distinct())
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.select(*group).schema)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.assign(key=[list(block_keys(word)) for word in batch["word"]])
            yield rows.explode("key").dropna(subset=["key"])[[*group, "word", "key"]]

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.assign(key=[sorted(held_keys(word)) for word in batch["word"]])
            yield rows.explode("key").dropna(subset=["key"])[[*group, "word", "key"]]

    schema = f"{types}, word string, key string"
    keyed = distinct.mapInPandas(keys, schema)
    alike = (
        keyed.withColumnRenamed("word", "first")
        .join(keyed.withColumnRenamed("word", "second"), [*group, "key"])
        .where(F.col("first") < F.col("second"))
        .select(*group, "first", "second")
        .distinct()
    )
    inner = distinct.select(*group, F.col("word").alias("first"), F.substring("word", 1, GRAM).alias("key"))
    outer = distinct.mapInPandas(stretches, schema).withColumnRenamed("word", "second")
    holding = (
        inner.join(outer, [*group, "key"])
        .where(F.col("second").contains(F.col("first")) & (F.col("first") != F.col("second")))
        .select(*group, "first", "second")
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = list(zip(batch["first"], batch["second"], strict=True))
            yield batch[[words_match(a, b) for a, b in pairs]]
            turned = batch.rename(columns={"first": "second", "second": "first"})[batch.columns]
            yield turned[[words_match(b, a) for a, b in pairs]]

    itself = distinct.select(*group, F.col("word").alias("first"), F.col("word").alias("second"))
    both_ways = F.explode(
        F.array(
            F.struct(F.col("first").alias("first"), F.col("second").alias("second")),
            F.struct(F.col("second").alias("first"), F.col("first").alias("second")),
        )
    )
    held = holding.select(*group, both_ways.alias("p")).select(*group, "p.*")
    verified = alike.mapInPandas(verify, f"{types}, first string, second string")
    return held.unionByName(verified).distinct().unionByName(itself)
