"""Density clusters against a plain form that works from the top of the tree downwards."""

from __future__ import annotations

import math

import numpy as np
import pytest

from chatlake.catalog import vectors as catalog
from chatlake.operators import density, vectors
from chatlake.sources.adapters import Tables
from tests.conftest import DATA


def _edges(points: dict[int, np.ndarray], neighbors: int, degree: int) -> tuple[list[tuple], dict[int, float]]:
    unit = {k: v / np.linalg.norm(v) for k, v in points.items()}
    near = {}
    for a, u in unit.items():
        cosine = sorted((-round(float(u @ v), 9), b, float(u @ v)) for b, v in unit.items() if b != a)
        near[a] = [(b, round(math.sqrt(max(0.0, 2 - 2 * c)), 6)) for _, b, c in cosine]
    core = {a: max(d for _, d in found[:neighbors]) for a, found in near.items()}
    gaps = {(min(a, b), max(a, b)): d for a, found in near.items() for b, d in found[:degree]}
    return sorted((max(d, core[a], core[b]), a, b) for (a, b), d in gaps.items()), core


def _brute(points: dict[int, np.ndarray], least: int, neighbors: int, degree: int) -> dict[int, int | None]:
    edges, _ = _edges(points, neighbors, degree)
    part = {k: {k} for k in points}
    tree = []
    for w, a, b in edges:
        if part[a] is not part[b]:
            tree.append((w, a, b))
            both = part[a] | part[b]
            for k in both:
                part[k] = both

    def sides(rows: set[int], kept: list[tuple]) -> list[set[int]]:
        """Connected sets of rows."""
        left, found = set(rows), []
        while left:
            some, new = set(), {min(left)}
            while new:
                some |= new
                new = {y for _, a, b in kept for x, y in ((a, b), (b, a)) if x in new} - some
            found.append(some)
            left -= some
        return found

    def best(rows: set[int], since: int, free: bool) -> tuple[int, list[set[int]]]:
        """What a cluster that starts with these rows, or the best choice inside it, lasts; and that choice."""
        lasts, now, inside = 0, set(rows), [e for e in tree if e[1] in rows and e[2] in rows]
        while True:
            w = inside[-1][0]
            inside = inside[:-1]
            density_ = 10**12 // max(round(w * 10**6), 1)
            parts = sides(now, inside)
            big = [p for p in parts if len(p) >= least]
            gone = now if len(big) != 1 else now - big[0]
            lasts += len(gone) * (density_ - since)
            if len(big) != 1:
                below = [best(p, density_, True) for p in big]
                total = sum(x for x, _ in below)
                if free and lasts >= total:
                    return lasts, [rows]
                return total, [c for _, found in below for c in found]
            now = big[0]
            inside = [e for e in inside if e[1] in now and e[2] in now]

    tops = [p for p in sides(set(points), tree) if len(p) >= least]
    chosen = [c for top in tops for c in best(top, 500_000, len(tops) > 1)[1]]
    return {k: next((min(c) for c in chosen if k in c), None) for k in points}


def _points(seed: int, n: int) -> dict[int, np.ndarray]:
    r = np.random.default_rng(seed)
    centers = r.normal(size=(4, 5))
    points = centers[r.integers(0, 4, n)] + r.normal(size=(n, 5)) * r.choice([0.02, 0.15, 0.9], n)[:, None]
    points[:6] = points[7]  # copies
    points[-20:] = centers[0] + 0.4 * centers[1] + r.normal(size=(20, 5)) * 0.05  # a part beside a part
    return dict(enumerate(points))


@pytest.mark.parametrize("seed,least,neighbors,degree,size", [(1, 4, 3, 200, 10_000), (2, 5, 4, 6, 25), (3, 3, 2, 2, 45)])
def test_clusters_by_density(spark, monkeypatch, seed, least, neighbors, degree, size) -> None:
    """All pairs as edges, few edges, a graph in parts; slices of all and of few edges."""
    monkeypatch.setattr(density, "SLICE", size)
    points = _points(seed, 90)
    odd = [(900, None), (901, [0.0] * 5), (902, [math.nan] * 5), (903, [math.inf] * 5), (None, [1.0] * 5), (904, [])]
    rows = [*((k, [float(x) for x in v]) for k, v in points.items()), *odd]
    table = spark.createDataFrame(rows, "msg_id long, embedding array<double>").repartition(3)
    found = density.density_clusters(table, least, neighbors, degree).collect()
    wanted = _brute(points, least, neighbors, degree)
    assert {r["msg_id"]: r["cluster"] for r in found} == wanted
    assert len({c for c in wanted.values() if c is not None}) > 1 and None in wanted.values()
    core = _edges(points, neighbors, degree)[1]
    assert all(r["distance"] == pytest.approx(core[r["msg_id"]], abs=2e-6) for r in found)


def test_clusters_of_nothing(spark) -> None:
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "msg_id long, embedding array<double>")
    assert density.density_clusters(table).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "msg_id long, embedding array<double>")
    assert [(r["msg_id"], r["cluster"]) for r in density.density_clusters(two).orderBy("msg_id").collect()] == [(1, None), (2, None)]
    with pytest.raises(ValueError):
        density.density_clusters(two, least=1)


def test_density_query(spark) -> None:
    """The registered query over its whole table."""
    rows = Tables(spark, DATA).table("embeddings").select("vec_id", "embedding").collect()
    wanted = _brute({r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}, 5, 5, 15)
    found = {r["vec_id"]: r["cluster"] for r in catalog.density_clusters(Tables(spark, DATA)).collect()}
    assert found == wanted


def test_representatives_by_density(spark) -> None:
    rows = [(1, 1, 0.5), (2, 1, 0.2), (3, None, 0.1), (4, 4, 0.3)]
    found = spark.createDataFrame(rows, "msg_id long, cluster long, distance double").where("cluster is not null")
    assert {(r["cluster"], r["members"], r["representative"]) for r in vectors.representatives(found).collect()} == {(1, 2, 2), (4, 1, 4)}
