"""Token chunks with overlap, vector tables, cosine search and clusters of messages."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.operators.shaping import evaluate_once
from chatlake.operators.skew import number_rows
from chatlake.operators.state import latest
from chatlake.session import cut_lineage

MAX_TOKENS, OVERLAP = 512, 50
#: Directions that rows are sorted by for the search, rows of one block, and queries that meet a block at once.
PIVOTS, BLOCK_ROWS, QUERY_ROWS = 32, 4096, 1024
#: Tiles that a search is dealt into at least, and rows or queries of one tile at most.
TILES, TILE_ROWS = 64, 131_072


def token_chunks(
    texts: DataFrame, key: str, text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of at most ``max_tokens`` words, each sharing ``overlap`` words with the one before.

    The last piece is the first that reaches the end, so none lies wholly inside another. A text
    without words has no piece. Rows: key, chunk_id (``<key>_chunk_<n>``), chunk_no, n_tokens, chunk.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("the overlap must be smaller than a chunk")
    step = max_tokens - overlap
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    split = texts.select(key, words.alias("_words"))
    size = F.size("_words")
    count = F.when(size <= max_tokens, F.lit(1)).otherwise(F.ceil((size - max_tokens) / step).cast("int") + 1)
    numbers = F.sequence(F.lit(0), count - 1)
    cut = F.transform(numbers, lambda i: F.slice("_words", i * step + 1, F.lit(max_tokens)))
    pieces = split.filter(size > 0).select(key, F.posexplode(cut).alias("chunk_no", "_piece"))
    return pieces.select(
        key,
        F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_no")).alias("chunk_id"),
        "chunk_no",
        F.size("_piece").alias("n_tokens"),
        F.array_join("_piece", " ").alias("chunk"),
    )


def current_vectors(log: DataFrame, key: str = "msg_id", order: Sequence[str] = ("log_no",)) -> DataFrame:
    """The vector last written per message: an upsert as an append and a latest-row aggregate."""
    return latest(log, [key], list(order))


def cosine(first: Column, second: Column) -> Column:
    """Cosine of two arrays of doubles; null where one has no length."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(dot(first, first)) * F.sqrt(dot(second, second))
    return F.when(norm > 0, dot(first, second) / norm)


def nearest(
    vectors: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", key: str = "msg_id",
    where: Column | None = None,
) -> DataFrame:
    """The ``k`` rows most like one query vector, after a filter; ties go to the smaller key.

    Every task keeps its own best rows, so only ``k`` rows per task move.
    """
    rows = vectors if where is None else vectors.filter(where)
    asked = F.array(*[F.lit(float(x)) for x in query])
    values = F.transform(vector, lambda x: x.cast("double"))
    scored = rows.withColumn("similarity", cosine(values, asked)).filter(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has a length: not null, not empty, all parts finite and not all zero."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    some = F.exists(parts, lambda x: x != 0)
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.forall(parts, fine) & some)


def _unit(rows: pa.Array) -> np.ndarray:
    """A matrix of unit vectors; very large and very small parts keep their direction."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(rows), -1)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _matrix(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, size)


def _pivoted(rows: DataFrame, key: str, vector: str, within: Sequence[str], pivots: np.ndarray) -> DataFrame:
    """key, within, unit (bytes), pivot (the nearest one), angle (to it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                unit = _unit(batch.column(vector))
                near = unit @ pivots.T
                pivot = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(unit)), pivot], -1.0, 1.0))
                columns = [*(batch.column(name) for name in (key, *within)), pa.array([row.tobytes() for row in unit], pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(pivot.astype(np.int32)), pa.array(angle)], [key, *within, "unit", "pivot", "angle"]
                )

    types = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in (key, *within))
    return rows.select(key, *within, vector).mapInArrow(run, f"{types}, unit binary, pivot int, angle double")


def _packed(rows: DataFrame, key: str, within: Sequence[str], size: int) -> DataFrame:
    """Rows of one pivot in blocks of bounded size, nearest to the pivot first: keys, one matrix, the widest angle."""
    placed = number_rows(rows, [*within, "pivot"], ["angle", key], "place")
    block = ((F.col("place") - 1) / size).cast("long").alias("block")
    held = F.array_sort(F.collect_list(F.struct(key, "unit")))
    packed = placed.groupBy(*within, "pivot", block).agg(
        F.min("angle").alias("least"), F.max("angle").alias("most"), held.alias("held")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held = row.column("held").flatten()
                matrix = b"".join(held.field("unit").to_pylist())
                keys = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held.field(key))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(name) for name in (*within, "pivot", "block", "least", "most")), keys, pa.array([matrix])],
                    [*within, "pivot", "block", "least", "most", "keys", "matrix"],
                )

    types = "".join(f"`{name}` {rows.schema[name].dataType.simpleString()}, " for name in within)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{types}pivot int, block long, least double, most double, keys array<{kind}>, matrix binary"
    return packed.mapInArrow(join, schema)


class _Best:
    """The ``k`` rows most like each query of one block, over the blocks of rows that it meets."""

    def __init__(self, queries: list, matrix: np.ndarray, k: int, reached: float) -> None:
        self.queries, self.matrix, self.k = queries, matrix, k
        self.least = np.full(len(queries), reached)  # what the k-th of a query reaches at least
        self.at, self.near, self.keys = np.empty(0, np.int64), np.empty(0), np.empty(0, object)

    def meet(self, keys: list, matrix: np.ndarray) -> None:
        near = self.matrix @ matrix.T
        places = {value: i for i, value in enumerate(keys)}
        for i, query in enumerate(self.queries):
            if query in places:
                near[i, places[query]] = -2.0
        # rows as near as the k-th are all kept, as ties are settled by key later on
        kept = near >= self.least[:, None] - 1e-8
        if near.shape[1] > self.k and kept.sum() > 4 * self.k * len(near):
            kth = near.shape[1] - self.k
            self.least = np.maximum(self.least, np.partition(near, kth, axis=1)[:, kth])
            kept = near >= self.least[:, None] - 1e-8
        i, j = np.nonzero(kept)
        if not len(i):
            return
        at, values = np.concatenate([self.at, i]), np.concatenate([self.near, near[i, j]])
        names = np.empty(len(keys), object)
        names[:] = keys
        order = np.lexsort((-values, at))
        at, values, held = at[order], values[order], np.concatenate([self.keys, names[j]])[order]
        starts = np.searchsorted(at, np.arange(len(near)))
        full = np.diff(starts, append=len(at)) >= self.k
        self.least[full] = np.maximum(self.least[full], values[starts[full] + self.k - 1])
        kept = values >= self.least[at] - 1e-8
        self.at, self.near, self.keys = at[kept], values[kept], held[kept]

    def rows(self, key: str, kinds: list) -> pa.RecordBatch:
        queries = pa.array([self.queries[x] for x in self.at], kinds[0])
        columns = [queries, pa.array(self.keys.tolist(), kinds[1]), pa.array(self.near, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["query", key, "similarity"])


def nearest_to_all(
    vectors: DataFrame, asked: Column, k: int, vector: str = "embedding", key: str = "msg_id", within: Sequence[str] = ()
) -> DataFrame:
    """query, rank, key, similarity: the ``k`` rows most like each row that ``asked`` holds for, but not itself.

    The search is exact. Rows are sorted by the nearest of a few directions and cut into blocks of bounded size.
    A block of queries first meets the blocks of its own direction, which gives a similarity that the k nearest
    of each query reach at least. Of the others it meets only those blocks that may reach it: the angle to a row is
    at least the angle between both directions less the widest angle in either block. Blocks are dealt into a grid
    of tiles, so that each moves once per row or column of the grid and not once per block that it meets; the grid is
    the same for up to ``TILE_ROWS`` times eight rows and grows beyond, as a tile is bounded. A task multiplies two blocks
    at a time and keeps the best of each query over the blocks of its tile, so its memory does not depend on the number
    of rows. ``within`` restricts a query to rows that agree with it, as in a search inside a room.

    Of rows with equal vectors only the first k + 1 by key are searched; no other can be among the k nearest of any row.
    Rows without a usable vector or key take no part; keys are taken to be distinct. Similarities are compared to
    nine digits, ties go to the smaller key.
    """
    rows = usable(vectors, vector).where(F.col(key).isNotNull())
    sample = rows.select(vector).orderBy(F.xxhash64(key), key).limit(PIVOTS).collect()
    kind = vectors.schema[key].dataType.simpleString()
    if not sample:
        empty = vectors.limit(0)
        return empty.select(F.col(key).alias("query"), F.lit(0).alias("rank"), key, F.lit(0.0).alias("similarity"))
    pivots = _unit(pa.array([[float(x) for x in row[0]] for row in sample]))
    size, between = pivots.shape[1], np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    copies = Window.partitionBy(*within, vector).orderBy(key)
    searched = rows.select(key, *within, vector).withColumn("_nth", F.row_number().over(copies)).where(F.col("_nth") <= k + 1)
    placed = _pivoted(searched, key, vector, within, pivots)
    blocks = cut_lineage(_packed(placed, key, within, BLOCK_ROWS))
    queries = cut_lineage(_packed(_pivoted(rows.where(asked), key, vector, within, pivots), key, within, QUERY_ROWS))
    queries = queries.select(
        *within, *[F.col(name).alias(f"q_{name}") for name in ("pivot", "block", "most", "keys", "matrix")]
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, asking, held = [], None, None
        for batch in batches:
            kinds = [batch.schema.field(name).type.value_type for name in ("q_keys", "keys")]
            for row in batch.to_pylist():
                if held is None or row["q_keys"] != asking:
                    if held is not None:
                        yield held.rows(key, kinds)
                    asking, held = row["q_keys"], _Best(row["q_keys"], _matrix(row["q_matrix"], size), k, row["reached"])
                held.meet(row["keys"], _matrix(row["matrix"], size))
        if held is not None:
            yield held.rows(key, kinds)

    def meet(q: DataFrame, b: DataFrame, down: int, across: int, same: Sequence[str], wanted: Column) -> DataFrame:
        # each block of queries goes to all tiles of its row of the grid, each block of rows to all of its column
        tile, tasks = [*same, "_down", "_across"], max(2 * TILES, down * across)
        q = q.withColumn("_across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).repartition(tasks, *tile).alias("q")
        b = b.withColumn("_down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).repartition(tasks, *tile).alias("b")
        equal = [F.col(f"q.{name}") == F.col(f"b.{name}") for name in tile]
        equal += [F.col(f"q.{name}").eqNullSafe(F.col(f"b.{name}")) for name in within]
        met = q.join(b, [*equal, wanted]).select("q_keys", "q_matrix", "keys", "matrix", "reached")
        return met.mapInArrow(best, f"query {kind}, `{key}` {kind}, similarity double")

    asking, widest = queries.agg(F.sum(F.size("q_keys")), F.max("q_block")).first()
    if asking is None:
        empty = vectors.limit(0)
        return empty.select(F.col(key).alias("query"), F.lit(0).alias("rank"), key, F.lit(0.0).alias("similarity"))
    stored, longest = blocks.agg(F.sum(F.size("keys")), F.max("block")).first()
    # the blocks of one direction are a grid of their own, mostly of one tile
    down, across = TILE_ROWS // 2 // QUERY_ROWS, TILE_ROWS // 2 // BLOCK_ROWS
    own = cut_lineage(meet(
        queries.withColumns({"pivot": F.col("q_pivot"), "_down": F.floor(F.col("q_block") / down).cast("int"), "reached": F.lit(-1.5)}),
        blocks.withColumn("_across", F.floor(F.col("block") / across).cast("int")),
        widest // down + 1, longest // across + 1, ["pivot"], F.lit(True),
    ))
    # what the k-th of a query's own direction reaches; -1.5 where there are fewer
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    kth = own.withColumn("place", F.row_number().over(order)).where(F.col("place") == k)
    each = queries.select(*within, "q_pivot", "q_block", F.explode("q_keys").alias("query"))
    reached = (
        each.join(kth.select("query", "similarity"), "query", "left")
        .groupBy(*within, "q_pivot", "q_block")
        .agg(F.min(F.coalesce("similarity", F.lit(-1.5))).alias("reached"))
    )
    same_block = [F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in (*within, "q_pivot", "q_block")]
    down = max(1, round(math.sqrt(TILES * asking / stored)), -(-asking // TILE_ROWS))
    across = max(-(-TILES // down), -(-stored // TILE_ROWS))
    angles = F.lit([float(x) for x in between.ravel()]).cast("array<double>")
    apart = F.get(angles, F.col("q_pivot") * len(pivots) + F.col("b.pivot"))
    least = F.greatest(F.lit(0.0), apart - F.col("q_most") - F.col("b.most") - 1e-9)
    may_reach = F.cos(least) >= F.col("reached") - 1e-8
    far = meet(
        queries.alias("x").join(reached.alias("y"), same_block).select("x.*", "reached")
        .withColumn("_down", F.pmod(F.xxhash64(*within, "q_pivot", "q_block"), F.lit(down)).cast("int")),
        blocks.withColumn("_across", F.pmod(F.xxhash64(*within, "pivot", "block"), F.lit(across)).cast("int")),
        down, across, [], (F.col("q_pivot") != F.col("b.pivot")) & may_reach,
    )
    found = own.unionByName(far)
    # the narrow candidates are scored on the vectors themselves
    close = found.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.round("similarity", 7).desc())))
    close = close.where(F.col("place") <= k).select("query", key)
    values = rows.select(key, F.col(vector).alias("_v"))
    both = close.join(values, key).join(values.select(F.col(key).alias("query"), F.col("_v").alias("_q")), "query")
    wide = evaluate_once(both, {name: F.transform(name, lambda x: x.cast("double")) for name in ("_q", "_v")})
    scored = wide.select("query", key, cosine(F.col("_q"), F.col("_v")).alias("similarity"))
    order = Window.partitionBy("query").orderBy(F.round("similarity", 9).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", key, "similarity")


def clusters(vectors: DataFrame, k: int, vector: str = "embedding", key: str = "msg_id", seed: int = 7) -> DataFrame:
    """Each row with its cluster and squared distance to the centre (k-means of the ML library)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    centers = [[float(x) for x in center] for center in model.clusterCenters()]
    found = model.transform(rows).withColumnRenamed("prediction", "cluster")
    center = F.element_at(F.array(*[F.array(*[F.lit(x) for x in c]) for c in centers]), F.col("cluster") + 1)
    gaps = F.zip_with(vector_to_array("features"), center, lambda x, y: (x - y) * (x - y))
    return found.select(key, "cluster", F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x).alias("distance"))


def representatives(found: DataFrame, key: str = "msg_id") -> DataFrame:
    """Per cluster its size, and the row nearest to the centre; ties go to the smaller key."""
    return found.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), F.min_by(key, F.struct("distance", key)).alias("representative")
    )
