"""Chunks and clusters on literal cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.operators import vectors


def test_chunks_overlap_and_end(spark) -> None:
    texts = [(1, " ".join(map(str, range(10)))), (2, "a b"), (3, "  "), (4, None), (5, " ".join(map(str, range(7))))]
    rows = vectors.token_chunks(spark.createDataFrame(texts, "id long, text string"), "id", "text", 4, 1).collect()
    found = {r.chunk_id: r.chunk for r in rows}
    assert found == {
        "1_chunk_0": "0 1 2 3", "1_chunk_1": "3 4 5 6", "1_chunk_2": "6 7 8 9", "2_chunk_0": "a b",
        "5_chunk_0": "0 1 2 3", "5_chunk_1": "3 4 5 6",
    }
    with pytest.raises(ValueError):
        vectors.token_chunks(spark.createDataFrame(texts, "id long, text string"), "id", "text", 4, 4)


def test_clusters_and_search(spark) -> None:
    rows = [(i, [1.0 + i / 100, 0.0]) for i in range(5)] + [(10 + i, [0.0, 5.0 + i / 100]) for i in range(5)] + [(99, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "msg_id long, embedding array<double>")
    found = {r.representative: r.members for r in vectors.representatives(vectors.clusters(table.filter("msg_id < 99"), 2)).collect()}
    assert found == {2: 5, 12: 5}
    assert [r.msg_id for r in vectors.nearest(table, [0.0, 1.0], 3).collect()] == [10, 11, 12]


@pytest.mark.parametrize("k,within", [(3, []), (40, ["room"]), (500, [])])
def test_search_of_many_queries(spark, monkeypatch, k, within) -> None:
    """Clustered vectors with copies, small blocks, and vectors that take no part."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 5)
    monkeypatch.setattr(vectors, "PIVOTS", 6)
    r = np.random.default_rng(k)
    centers = r.normal(size=(5, 8))
    points = (centers[r.integers(0, 5, 160)] + r.normal(size=(160, 8)) / 9).round(2)
    points[20:50] = points[7]
    rows = [(i, [float(x) for x in p], r.choice(["a", "b"]).item() if i % 9 else None, "x") for i, p in enumerate(points)]
    odd = [(200, None, "a", "x"), (220, [0.0] * 8, "a", "x"), (240, [math.nan] * 8, "a", "x"), (260, [math.inf] * 8, "a", "x"), (280, [], "a", "x"), (None, [1.0] * 8, "a", "x"), (300, [1.0, None] * 4, "a", "x")]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, room string, place string").repartition(3)
    found = vectors.nearest_to_all(table, F.col("vec_id") % 20 == 0, k, key="vec_id", within=within).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = (unit @ unit.T).round(9)
    for query in range(0, 160, 20):
        others = [i for i in range(160) if i != query and (not within or rows[i][2] == rows[query][2])]
        wanted = sorted(others, key=lambda i: (-near[query, i], i))[:k]
        got = sorted((x["rank"], x["vec_id"], x["similarity"]) for x in found if x["query"] == query)
        assert [v for _, v, _ in got] == wanted and [n for n, _, _ in got] == list(range(1, len(wanted) + 1))
        assert np.allclose([s for *_, s in got], near[query, wanted])
    assert {x["query"] for x in found} == set(range(0, 160, 20))
    assert vectors.nearest_to_all(table.limit(0), F.col("vec_id") % 20 == 0, k, key="vec_id").count() == 0


def test_blocks_move_once_per_tile(spark, monkeypatch, capsys) -> None:
    """A grid of many tiles and a large group of copies; pairs of blocks are multiplied where they meet."""
    for name, size in (("BLOCK_ROWS", 8), ("QUERY_ROWS", 4), ("PIVOTS", 3), ("TILES", 4), ("TILE_ROWS", 64)):
        monkeypatch.setattr(vectors, name, size)
    points = np.random.default_rng(5).normal(size=(200, 4)).round(1)
    points[60:160] = points[3]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.nearest_to_all(table, F.lit(True), 5, key="vec_id")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = (unit @ unit.T).round(9)
    got: dict[int, list] = {}
    for row in found.orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append(row["vec_id"])
    assert got == {q: sorted((i for i in range(200) if i != q), key=lambda i: (-near[q, i], i))[:5] for q in range(200)}
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "hashpartitioning(q_keys" not in plan
