"""Nearest neighbours by inner product, with an inverted multi-index.

Both halves of the vectors are quantised separately, so a pair of centroids names a cell. A query sorts the
centroids of each half by distance (here: how far their inner product stays below the best one) and walks the
pairs in the order of the summed distance with a heap, until the visited cells hold the asked share of all
entries. The entries of these cells are reranked by the exact inner product of the original vectors.

The codebooks are fitted on a bounded sample; every vector is indexed. Entries live in blocks of bounded
size: a crowded cell is dealt over several blocks by id, and of equal vectors that meet in a task only the
smallest ids that can ever be among the results go on. Queries travel once per block, with their cells there.

Left out as entries and as queries: null vectors or ids, empty or zero vectors, vectors with null or
non-finite components, and vectors of another length than the most common one. Of rows with one id the
smallest vector counts. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import gather_spans, sample_rows
from chatlake.session import cut_lineage

CENTROIDS = 64
#: Vectors the codebooks are fitted on, at most.
SAMPLE = 20_000
ROUNDS = 15
#: Share of all entries that a query visits. Recall at 20 is over 0.9 on vectors spread like these.
SHARE = 0.55
#: Entries of one block, about.
BLOCK = 50_000
LEAST_BLOCKS = 12


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (doubles) of the rows that take part, one per id."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    plain = rows.select(F.col(key).cast("long").alias("id"), parts.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = plain.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    plain = plain.where(finite & F.exists("v", lambda x: x != 0))
    return plain.groupBy("id").agg(F.min("v").alias("v"))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _means(rows: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spread rows; a centroid without rows stays where it is."""
    start = np.unique(rows, axis=0)
    centers = start[np.linspace(0, len(start) - 1, min(k, len(start))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = ((centers**2).sum(axis=1) - 2 * rows @ centers.T).argmin(axis=1)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, rows)
        centers[count > 0] = total[count > 0] / count[count > 0, None]
    return centers


@dataclass
class Index:
    """Codebooks of both halves, and how many entries each cell holds."""

    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Cell of each vector: its nearest centroid in both halves."""
        places = []
        for book, part in ((self.left, vectors[:, : self.half]), (self.right, vectors[:, self.half :])):
            places.append(((book**2).sum(axis=1) - 2 * part @ book.T).argmin(axis=1))
        return places[0] * len(self.right) + places[1]

    def walk(self, query: np.ndarray, wanted: float) -> list[int]:
        """Cells by summed distance until they hold ``wanted`` entries."""
        a = -(self.left @ query[: self.half])
        b = -(self.right @ query[self.half :])
        first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = (a[first] - a.min()).tolist(), (b[second] - b.min()).tolist()
        first, second = first.tolist(), second.tolist()
        sizes, width, rows, columns = self.sizes, len(self.right), len(a), len(b)
        # pairs come out in order: (i, j) opens (i + 1, j) only in the first column, else only (i, j + 1)
        heap = [(0.0, 0, 0)]
        found, held = [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = first[i] * width + second[j]
            if sizes[cell]:
                found.append(cell)
                held += sizes[cell]
            if j + 1 < columns:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < rows:
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return found


def build(rows: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> tuple[Index | None, DataFrame]:
    """The index, and id, cell and v (binary) of every entry."""
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return None, rows.select("id", F.lit(0).cast("long").alias("cell"), F.lit(b"").alias("v"))
    rows = rows.where(F.size("v") == dims["d"])
    ids = F.broadcast(sample_rows(rows.select("id"), "id", sample))
    taught = rows.join(ids, "id").toPandas().sort_values("id")
    matrix = np.array(taught["v"].to_list(), np.float64)
    half = max(1, dims["d"] // 2)
    index = Index(_means(matrix[:, :half], centroids), _means(matrix[:, half:], centroids), np.zeros(0, np.int64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.ascontiguousarray(_vectors(batch.column("v")), "<f8")
            columns = [batch.column("id"), pa.array(index.cells(vectors)), pa.array([x.tobytes() for x in vectors], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cell", "v"])

    entries = cut_lineage(rows.mapInArrow(assign, "id long, cell long, v binary"))
    index.sizes = np.zeros(len(index.left) * len(index.right), np.int64)
    for cell in entries.groupBy("cell").count().collect():  # at most one row per pair of centroids
        index.sizes[cell["cell"]] = cell["count"]
    return index, entries


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up component by component: equal vectors score equal."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * vectors[:, d]
    return total


def _best(ids: np.ndarray, vectors: np.ndarray, spans: list[tuple[int, int]], query: int, v: np.ndarray, k: int):
    """The k best entries of one query among spans of entries; a rough product first, then the exact one."""
    starts = np.array([a for a, _ in spans])
    at = gather_spans(starts, np.array([b - a for a, b in spans]))
    at = at[ids[at] != query]
    if not len(at):
        return at, np.zeros(0)
    rough = vectors[at] @ v
    if len(at) > k:
        # products differ by rounding only, so nothing within this margin is lost
        floor = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = at[rough >= floor - 1e-9 * max(1.0, abs(floor))]
    scores = exact_scores(np.broadcast_to(v, (len(at), len(v))), vectors[at])
    order = np.lexsort((ids[at], -scores))[:k]
    return at[order], scores[order]


def search(
    rows: DataFrame,
    asked: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    share: float = SHARE,
    centroids: int = CENTROIDS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best entries found for each row that ``asked`` (over id) picks."""
    known = cut_lineage(usable(rows, key, vector))
    index, entries = build(known, centroids)
    schema = "query_id long, vec_id long, score double"
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = int(index.sizes.sum())
    # enough for a full result, the query itself not counted
    wanted = max(share * total, k + 1)
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK))
    # a cell may fill this much of a block; what is beyond goes to other blocks
    room = max(1, total // blocks // 2)
    parts = np.maximum(1, -(-index.sizes // room))

    def block_of(cells: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (cells * 7919 + part) % blocks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
            held = np.array(batch.column("v").to_pylist(), object)
            # of equal vectors, k + 1 ids are enough for any result (one may be the query itself)
            order = np.lexsort((ids, cells))
            seen: dict[bytes, int] = {}
            keep = []
            for i in order.tolist():
                seen[held[i]] = n = seen.get(held[i], 0) + 1
                if n <= k + 1:
                    keep.append(i)
            ids, cells, held = ids[keep], cells[keep], held[keep]
            block = block_of(cells, ids % parts[cells])
            columns = [pa.array(block), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array(cells[:, None].tolist(), pa.list_(pa.int64())), pa.array(held.tolist(), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "id", "cells", "v"])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for query, raw in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                    found = np.array(index.walk(np.frombuffer(raw, "<f8"), wanted), np.int64)
                    n = parts[found]
                    cell = np.repeat(found, n)
                    part = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
                    block = block_of(cell, part)
                    for own in np.unique(block).tolist():
                        for column, value in zip(out, (own, query, np.unique(cell[block == own]), raw), strict=True):
                            column.append(value)
                columns = [pa.array(out[0], pa.int64()), pa.array(np.ones(len(out[0]), np.int32)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "id", "cells", "v"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block: its entries first, kept by cell, then its queries, answered as they come."""
        block, waiting = None, []
        ids = vectors = bounds = None
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out: tuple[list, list, list] = ([], [], [])
                for own, kind, key_, cells, raw in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                    if own != block:
                        block, waiting, bounds = own, [], None
                    if kind == 0:
                        waiting.append((cells[0], key_, raw))
                        continue
                    if bounds is None:
                        waiting.sort()
                        ids = np.array([x[1] for x in waiting], np.int64)
                        vectors = np.frombuffer(b"".join(x[2] for x in waiting), "<f8").reshape(len(ids), -1) if waiting else np.zeros((0, 1))
                        of = np.array([x[0] for x in waiting], np.int64)
                        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
                        ends = np.append(cut[1:], len(of))
                        bounds = {int(of[a]): (int(a), int(b)) for a, b in zip(cut, ends, strict=True)}
                        waiting = []
                    spans = [bounds[c] for c in cells if c in bounds]
                    if not spans:
                        continue
                    at, scores = _best(ids, vectors, spans, key_, np.frombuffer(raw, "<f8"), k)
                    out[0].extend([key_] * len(at))
                    out[1].extend(ids[at].tolist())
                    out[2].extend(scores.tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                    ["query_id", "vec_id", "score"],
                )

    layout = "block long, kind int, id long, cells array<long>, v binary"
    placed = entries.mapInArrow(place, layout)
    queries = entries.where(asked).select("id", "v").repartition(blocks, "id").mapInArrow(plan, layout)
    dealt = placed.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "kind", "id")
    found = dealt.mapInArrow(rerank, schema)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
