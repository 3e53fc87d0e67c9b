"""The near-duplicate stage against brute-force similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatlake.llm import similar
from tests.llm import brute
from tests.llm.conftest import words


def _grams(text: str | None) -> frozenset:
    found = brute.WORD.findall((text or "").translate(brute._LOWER))
    return frozenset(" ".join(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else frozenset()


def _roots(sets: list[frozenset]) -> list[int]:
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if root[i] != root[j] and 5 * common >= 4 * (len(a) + len(sets[j]) - common):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def _texts() -> list[str]:
    """Templates with one to several changed words, so that similarities lie on both sides of 0.8; a common line."""
    r = random.Random(5)
    line = words(99, 12)
    texts = [words(i, 60) + "\n" + line for i in range(40)]
    for i, n in enumerate((40, 120, 90, 25)):
        base = words(200 + i, n).split()
        for _ in range(50):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(n)] = words(r.randrange(10**6), 1)
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("small,chunk", [(32, 512), (1, 16)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, small, chunk) -> None:
    monkeypatch.setattr(similar, "CHUNK", chunk)
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs, small).collect()}
    assert [found[i] for i in range(len(texts))] == _roots([_grams(t) for t in texts])


def test_cell_links() -> None:
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, (4, 30), dtype=np.uint64)
    sets = [np.unique(np.append(base[k % 4][r.random(30) > 0.08], r.integers(0, 9, 2, dtype=np.uint64))) for k in range(60)]
    sets.append(np.zeros(0, np.uint64))
    found = similar.cell_links(np.arange(len(sets)), sets)
    roots = _roots([frozenset(x.tolist()) for x in sets])
    joined = list(range(len(sets)))
    for a, b in found:
        low, high = sorted((joined[a], joined[b]))
        joined = [low if x == high else x for x in joined]
    assert joined == roots and len(found) == len(sets) - len(set(roots))


def test_stage_takes_changed_copies(spark) -> None:
    """Copies with a few words changed, mostly more than four bits apart."""
    base = words(1, 120).split()
    texts = [" ".join(base)] + [" ".join(w if k != at else "changed" for k, w in enumerate(base)) for at in range(5, 115, 10)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_stage_follows_fingerprints(spark, monkeypatch) -> None:
    """Copies that few bits tie are candidates without any band key; what is less similar stays apart."""
    signed = similar._signatures
    monkeypatch.setattr(similar, "_signatures", lambda docs: signed(docs).withColumn("keys", F.array().cast("array<long>")))
    base = [words(i, 400).split() for i in range(3)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "changed"]) for b in base] + [" ".join(b[:200]) for b in base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    assert [found[i] for i in range(9)] == [0, 1, 2, 0, 1, 2, 6, 7, 8]


def test_near_duplicates_of_odd_rows(odd, none) -> None:
    rows = [r for r in odd.select("doc_id", "text").collect() if r["doc_id"] is not None]
    roots = _roots([_grams(r["text"]) for r in rows])
    lowest = {root: min(r["doc_id"] for r, x in zip(rows, roots, strict=True) if x == root) for root in roots}
    wanted = sorted((r["doc_id"], lowest[x]) for r, x in zip(rows, roots, strict=True))
    assert sorted(map(tuple, similar.near_duplicates(odd).collect())) == wanted
    assert similar.near_duplicates(none).count() == 0
