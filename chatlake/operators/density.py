"""Clusters of any shape by density: a spanning tree of mutual reachability, its hierarchy, and the lasting parts of it.

The distance of two rows is that of their vectors cut to length one, to six digits. A row's core distance is the one to
its ``neighbors``-th nearest row, and an edge weighs as much as its distance and both core distances at least.

* Edges join each row to its ``degree`` nearest others; with a degree of n - 1 or more that is every pair. Parts of the
  graph without an edge between them count as 2 apart, which no distance exceeds.
* The least spanning tree is found in rounds of joins: every part takes its least edge outwards, parts that are then
  linked become one, and of parallel edges the least goes on. Parts at least halve in number per round.
* The tree's edges are merged from the least upwards, in slices of bounded size. A task reads one slice and one row of
  state per part that it touches: size, sum of densities at which rows left, and what the best choice below it lasts. So
  memory depends on the slice alone, while labels of rows are joins. Slices follow each other, as merges do.
* A part of ``least`` rows or more is a cluster until it meets another such part. How long it lasts is the sum over its
  rows of (density at which the row leaves) - (density at which the cluster began), a density being 1 / weight. A
  cluster is chosen if it lasts as long as the best choice below it and lies in no other chosen one. Distances are whole numbers of
  millionths and densities whole numbers too, so these sums are exact and do not depend on the order of work.

Edges are compared by weight and then by both keys, so ties have one result. The cluster of all rows is no choice. Rows
whose vector is null, empty, zero or not finite, or whose key is null, take no part; keys are taken to be distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.skew import number_rows
from chatlake.operators.vectors import nearest_to_all
from chatlake.session import cut_lineage

#: Greatest distance, and edges that one task merges.
APART, SLICE = 2.0, 500_000

_STATE = "size long, total decimal(38,0), below decimal(38,0), cluster long"


def density_of(weight: float) -> int:
    """One by the weight, in millionths; weights below a millionth count as one."""
    return 10**12 // max(round(weight * 10**6), 1)


def reach_graph(vectors: DataFrame, neighbors: int, degree: int, vector: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their core distance, and edges (a, b, w) of mutual reachability with a < b."""
    near = nearest_to_all(vectors, F.lit(True), max(degree, neighbors), vector, key)
    gap = F.round(F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("similarity"))), 6)
    near = cut_lineage(near.select("query", "rank", F.col(key).alias("other"), gap.alias("gap")))
    core = cut_lineage(near.where(F.col("rank") <= neighbors).groupBy("query").agg(F.max("gap").alias("core")))
    pairs = near.where(F.col("rank") <= degree).groupBy(
        F.least("query", "other").alias("a"), F.greatest("query", "other").alias("b")
    ).agg(F.max("gap").alias("gap"))
    first, second = (core.select(F.col("query").alias(x), F.col("core").alias(f"core_{x}")) for x in "ab")
    weight = F.greatest("gap", "core_a", "core_b").alias("w")
    return core.withColumnRenamed("query", key), pairs.join(first, "a").join(second, "b").select("a", "b", weight)


def spanning_tree(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of the least spanning forest."""
    open_edges = cut_lineage(edges.select("a", "b", "w", F.col("a").alias("pa"), F.col("b").alias("pb")))
    tree = []
    while open_edges.limit(1).count():
        ends = [
            open_edges.select(F.col(own).alias("part"), F.struct("w", "a", "b", F.col(far).alias("to")).alias("edge"))
            for own, far in (("pa", "pb"), ("pb", "pa"))
        ]
        picked = cut_lineage(ends[0].union(ends[1]).groupBy("part").agg(F.min("edge").alias("edge")))
        tree.append(picked.select("edge.a", "edge.b", "edge.w").distinct())
        # following least edges ends at two parts that picked the same one; the smaller is the root
        back = picked.select(F.col("part").alias("to"), F.col("edge.to").alias("again"))
        mutual = F.col("again") == F.col("part")
        steps = picked.select("part", "edge.to").join(back, "to").select(
            "part", F.when(mutual, F.least("part", "to")).otherwise(F.col("to")).alias("root")
        )
        roots = _followed(steps, "part", "root")
        for own in ("pa", "pb"):
            named = roots.select(F.col("part").alias(own), F.col("root").alias(f"r{own}"))
            open_edges = open_edges.join(named, own)
        edge = F.min(F.struct("w", "a", "b")).alias("edge")
        between = [F.least("rpa", "rpb").alias("x"), F.greatest("rpa", "rpb").alias("y")]
        least = open_edges.where("rpa != rpb").groupBy(*between).agg(edge)
        open_edges = cut_lineage(least.select("edge.a", "edge.b", "edge.w", F.col("x").alias("pa"), F.col("y").alias("pb")))
    if not tree:
        return edges.select("a", "b", "w").limit(0)
    found = tree[0]
    for more in tree[1:]:
        found = found.union(more)
    return found


def _followed(steps: DataFrame, key: str, to: str) -> DataFrame:
    """Pointers followed to their ends, twice as far in every round."""
    steps = cut_lineage(steps)
    while True:
        ahead = steps.select(F.col(key).alias(to), F.col(to).alias("_next"))
        moved = cut_lineage(steps.join(ahead, to).select(key, F.col("_next").alias(to), (F.col("_next") != F.col(to)).alias("_moved")))
        steps = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            return steps


class _Part:
    """A part of the tree while a slice is merged."""

    __slots__ = ("name", "size", "total", "below", "cluster", "small")

    def __init__(self, name, size: int, total: int, below: int, cluster: int | None) -> None:
        self.name, self.size, self.total, self.below, self.cluster = name, size, total, below, cluster
        self.small = [name] if cluster is None else []  # parts of the slice's start that are in no cluster yet


def _merge_slice(rows: pd.DataFrame, least: int) -> Iterator[tuple]:
    """What the edges of one slice, in order, do to the parts that they touch.

    Rows: kind, part, into, then size, total, below, cluster, up, lasts. "moved" gives each part its new name and, if it
    was in no cluster, the one that it joined; "state" holds for the new parts; "ended" are clusters with the one above.
    """
    parts: dict = {}
    above: dict = {}

    def part_of(name) -> _Part:
        end = name
        while end in above:
            end = above[end]
        while name != end:
            above[name], name = end, above[name]
        return parts[end]

    fields = [f"{side}_{name}" for side in "ab" for name in ("part", "size", "total", "below", "cluster")]
    joined: dict = {}
    starts: list = []
    for place, w, *both in rows[["place", "w", *fields]].itertuples(index=False, name=None):
        for name, size, total, below, cluster in (both[:5], both[5:]):
            if name not in parts:
                starts.append(name)
                parts[name] = _Part(name, int(size), int(total), int(below), None if pd.isna(cluster) else int(cluster))
        one, two = part_of(both[0]), part_of(both[5])
        if one.size < two.size:
            one, two = two, one
        density = density_of(w)
        if two.cluster is not None:  # both are clusters, so both end here
            for part in (one, two):
                lasts = part.total - part.size * density
                yield ("ended", None, None, None, None, Decimal(part.below), part.cluster, place, Decimal(lasts))
                part.below = max(part.below, lasts)
            one.below += two.below
            one.size, one.cluster = one.size + two.size, place
            one.total = one.size * density
        else:
            gained = two.size if one.cluster is not None else one.size + two.size
            one.size += two.size
            one.small += two.small
            if one.cluster is None and one.size >= least:
                one.cluster = place
            if one.cluster is not None:
                one.total += gained * density
                joined.update(dict.fromkeys(one.small, one.cluster))
                one.small = []
        above[two.name] = one.name
    for name in starts:
        yield ("moved", name, part_of(name).name, None, None, None, joined.get(name), None, None)
        if name not in above:
            part = parts[name]
            yield ("state", name, None, part.size, Decimal(part.total), Decimal(part.below), part.cluster, None, None)


def density_clusters(
    vectors: DataFrame, least: int = 5, neighbors: int = 5, degree: int = 15, vector: str = "embedding", key: str = "msg_id"
) -> DataFrame:
    """key, cluster (smallest key of the cluster; null for a row in none) and distance (its core distance)."""
    if least < 2 or neighbors < 1 or degree < 1:
        raise ValueError("clusters have at least two rows, and rows at least one neighbour")
    core, edges = reach_graph(vectors, neighbors, degree, vector, key)
    tree = cut_lineage(number_rows(spanning_tree(edges), [], ["w", "a", "b"], "place"))
    kind = vectors.schema[key].dataType.simpleString()
    start = F.lit(None).cast("long")
    labels = cut_lineage(core.select(F.col(key).alias("row"), F.col(key).alias("part"), start.alias("cluster")))
    zero = F.lit(0).cast("decimal(38,0)")
    one = [F.lit(1).cast("long").alias("size"), zero.alias("total"), zero.alias("below"), start.alias("cluster")]
    state = cut_lineage(labels.select("part", *one))
    ended = []
    out = f"kind string, part {kind}, into {kind}, {_STATE}, up long, lasts decimal(38,0)"
    names = ["kind", "part", "into", *state.columns[1:], "up", "lasts"]

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            rows = pd.concat(held).sort_values("place")
            yield pd.DataFrame(list(_merge_slice(rows, least)), columns=names).astype(
                {"size": "Int64", "cluster": "Int64", "up": "Int64"}
            )

    for first in range(0, tree.count(), SLICE):
        part = tree.where((F.col("place") > first) & (F.col("place") <= first + SLICE))
        for side in "ab":
            at = labels.select(F.col("row").alias(side), F.col("part").alias(f"{side}_part"))
            facts = state.select(*[F.col(name).alias(f"{side}_{name}") for name in state.columns])
            part = part.join(at, side).join(facts, f"{side}_part")
        did = cut_lineage(part.drop("a", "b").coalesce(1).mapInPandas(merged, out))
        ended.append(did.where("kind = 'ended'").select("cluster", "up", "below", "lasts"))
        moved = did.where("kind = 'moved'").select("part", "into", F.col("cluster").alias("joined"))
        labels = cut_lineage(labels.join(moved, "part", "left").select(
            "row", F.coalesce("into", "part").alias("part"), F.coalesce("cluster", "joined").alias("cluster")
        ))
        fresh = did.where("kind = 'state'").select(state.columns)
        state = cut_lineage(state.join(moved, "part", "left_anti").unionByName(fresh))

    tops = state.where("cluster is not null")
    several = tops.limit(2).count() > 1
    lasts = (F.col("total") - F.col("size") * density_of(APART)).cast("decimal(38,0)") if several else zero
    found = tops.select("cluster", start.alias("up"), "below", lasts.alias("lasts"), F.lit(several).alias("free"))
    for rows in ended:
        found = found.union(rows.withColumn("free", F.lit(True)))
    chosen = _topmost(found.select("cluster", "up", (F.col("free") & (F.col("lasts") >= F.col("below"))).alias("kept")))
    placed = labels.join(chosen, "cluster", "left").select("row", "best")
    named = placed.where("best is not null").groupBy("best").agg(F.min("row").alias("name"))
    final = placed.join(named, "best", "left").select(F.col("row").alias(key), F.col("name").alias("cluster"))
    return final.join(core.withColumnRenamed("core", "distance"), key)


def _topmost(clusters: DataFrame) -> DataFrame:
    """cluster, best: the highest kept one among a cluster and those above it."""
    best = F.when(F.col("kept"), F.col("cluster")).alias("best")
    steps = cut_lineage(clusters.select("cluster", "up", best))
    while steps.where("up is not null").limit(1).count():
        ahead = steps.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("best").alias("_best"))
        steps = cut_lineage(steps.join(ahead, "up", "left").select(
            "cluster", F.col("_up").alias("up"), F.coalesce("_best", "best").alias("best")
        ))
    return steps.select("cluster", "best")
