"""Keyword pairs and the merge in rounds, against loops."""

from __future__ import annotations

import random

import pytest

from chatlake.functions.topics import words_match
from chatlake.operators import merging
from chatlake.operators import topics as top
from chatlake.operators import wordmatch

SYLLABLES = ["sto", "ck", "fun", "ding", "wea", "ther", "ra", "in", "ga", "me", "r", "s", "票", "股", "基金", "tion", "al", "a1"]
SCHEMA = "chatroom string, topic_no long, keywords array<string>, message_count int"


def _words(rng: random.Random, n: int, longest: int = 5) -> list[str]:
    return list({"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, longest))) for _ in range(n)})


def test_pairs_equal_all_pairs(spark) -> None:
    rng = random.Random(3)
    words = [*_words(rng, 260), *_words(rng, 12, 30), "a" * 70, "a" * 45 + "b" * 20, "ab" * 60]
    rows = [(room, word, 1) for room in "xy" for word in (words if room == "x" else words[:60])]
    table = spark.createDataFrame([*rows, rows[0], ("x", "", 1), ("z", None, 1)], "room string, word string, key int")
    found = [tuple(r) for r in wordmatch.matching_words(table.repartition(3), ["room"]).collect()]
    wanted = {("x", a, b) for a in words for b in words if words_match(a, b)}
    wanted |= {("y", a, b) for a in words[:60] for b in words[:60] if words_match(a, b)}
    assert len(found) == len(set(found)) and set(found) == wanted
    assert wordmatch.matching_words(table.limit(0), ["room"]).count() == 0


def test_keys_spare_most_pairs() -> None:
    """Of 1 500 words at most a tenth of all pairs share a key, and no matching pair is missed."""
    words = _words(random.Random(5), 1600)[:1500]
    groups: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        for key in set(wordmatch.block_keys(word)):
            groups.setdefault(key, []).append(i)
    candidates = {(a, b) for group in groups.values() for k, b in enumerate(group) for a in group[:k]}
    assert len(candidates) <= len(words) * (len(words) - 1) / 20
    for b in range(0, len(words), 15):
        for a in range(b):
            held = words[a] in words[b] or words[b] in words[a]
            assert held or not words_match(words[a], words[b]) or (a, b) in candidates


def _rows(seed: int, n: int, vocabulary: list[str]) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for number in range(n):
        words = rng.sample(vocabulary, rng.randint(0, 4)) + rng.choice([[], [], ["", "!!"], ["Stock"], ["stock", "STOCK"]])
        rows.append((rng.choice("aab"), number, words, rng.choice([None, 1, 1, 2, 5, 9])))
    return [*rows, ("c", 0, None, 3), ("c", 1, ["x"], 2), ("d", 0, [], None)]


@pytest.mark.parametrize("seed,wave", [(0, 1000), (1, 20)])
def test_rounds_equal_the_walk(spark, seed, wave, monkeypatch) -> None:
    rng = random.Random(seed)
    vocabulary = ["stock", "stocks", "fund", "fundings", "weather", "Rain", "rainy", "game", "gamer", "票", "股票", "zz", *_words(rng, 30)]
    df = spark.createDataFrame(_rows(seed, 90, vocabulary), SCHEMA).repartition(3)
    walked = sorted(map(tuple, top.assign_merges(df).collect()), key=lambda r: r[:2])
    found = sorted(map(tuple, merging.assign_in_rounds(_narrow(df), 0.4, wave).collect()), key=lambda r: r[:2])
    assert found == walked
    assert len({r[2] for r in found}) < len(found)


def _narrow(df):
    from pyspark.sql import functions as F

    empty = F.array().cast("array<string>")
    return df.withColumns({"keywords": F.coalesce("keywords", empty), "message_count": F.col("message_count").cast("long")})


def test_large_rooms_take_rounds(spark) -> None:
    """Rooms above the bound and rooms below it in one call."""
    df = spark.createDataFrame(_rows(4, 60, ["stock", "fund", "weather", "rain", "game"]), SCHEMA)
    walked = sorted(map(tuple, top.assign_merges(df).collect()), key=lambda r: r[:2])
    mixed = sorted(map(tuple, top.assign_merges(df, walked=30).collect()), key=lambda r: r[:2])
    assert mixed == walked
