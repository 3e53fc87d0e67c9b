from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

#: Columns that share names with those the operators use inside.
EXTRA = "score string, label string, ids string, rid string, h string, part string, place string, found string, row string, _text string, held_out string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, repeated rows, shared passages, many bytes per letter."""
    base, passage = words(1, 120), words(2, 60)
    texts: list[tuple] = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", "en", None),
        (4, words(3, 12_000), "en", "a"),
        (5, base, "en", "a"),
        (6, base, None, "a"),
        (7, base.replace("a", "e", 1), "en", "b"),
        (8, words(4, 40) + "\n" + passage + "\n" + words(5, 40), "en", "b"),
        (9, words(6, 30) + "\n" + passage, "de", "b"),
        (10, "ab " * 300, "en", "b"),
        (11, "日本語 🙂 " * 60 + "é" * 130, "fr", None),
        (12, "日本語 🙂 " * 60 + "è" * 130, "fr", None),
        (13, "one two", "en", "c"),
        (14, "12 34 !! ??", "en", "c"),
        (15, "x" * 5000, "en", "c"),
        (None, words(7, 80), "en", "c"),
        (None, None, None, None),
    ]
    rows = [(*t, len(t[1]) if t[1] else None, *["clash"] * 11) for t in texts]
    return rows + [rows[4], rows[4], rows[3]]


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
