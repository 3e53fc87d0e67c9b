"""Quality of whole texts: random-indexing word vectors, pooled, and a two-layer network.

Every word and sign has a sparse random index vector, given by its hash. Its word vector is the sum of the
index vectors of its neighbours over the whole corpus; words share ``BUCKETS`` rows by hash, so the table is of
one size for any corpus. A text is the mean of its words' unit vectors, their spread, and the products of
neighbours (high where words repeat), and its length. A network with one hidden layer, fitted on a bounded
sample of labelled rows, turns that into a score; a temperature from a held-back part calibrates it.

Null, empty and blank texts have a vector of zeros and get the score of such a text. Without labels of both
kinds every score is the share of label 1 (one half if there is none). Repeated rows are scored each. Only
doc_id and text of the input are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.calibration import temperature
from chatlake.llm.common import (
    SPACE_BYTE,
    WORD_BYTE,
    labelled_sample,
    map_texts,
    prefix_sums,
    runs,
    slices,
    span_hashes,
    text_bytes,
)

BUCKETS, DIMENSIONS, WINDOW, BLOCKS = 1 << 15, 32, 2, 64
#: Labelled rows used for fitting, at most.
SAMPLE = 20_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 32, 3000, 256, 0.005, 1e-4


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (case counts) and of single signs, and where each text's tokens start."""
    data, offsets = text_bytes(texts)
    word = WORD_BYTE[data]
    starts, ends = runs(word, offsets)
    signs = np.flatnonzero(~word & ~SPACE_BYTE[data])
    starts, ends = np.concatenate([starts, signs]), np.concatenate([ends, signs + 1])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return span_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, offsets)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors by bucket, from all texts. Each task sums its own rows; the sums are then added
    block by block, in tasks that hold a fixed number of blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS, np.float64)
        for batch in slices(batches):
            hashes, bounds = tokens(batch.column("text"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            bucket = _bucket(hashes) * DIMENSIONS
            # two places with a sign each, from bits that the bucket does not use
            index = []
            for shift in (0, 8):
                bits = hashes >> np.uint64(shift)
                place = (bits % np.uint64(DIMENSIONS)).astype(np.int64)
                index.append((place, 1.0 - 2.0 * ((bits >> np.uint64(6)) & np.uint64(1)).astype(np.float64)))
            keys, signs = [], []
            for step in range(1, WINDOW + 1):
                near = doc[step:] == doc[:-step]
                for place, sign in index:
                    keys += [(bucket[:-step] + place[step:])[near], (bucket[step:] + place[:-step])[near]]
                    signs += [sign[step:][near], sign[:-step][near]]
            if len(hashes):
                total += np.bincount(np.concatenate(keys), np.concatenate(signs), len(total))
        parts = total.astype("<i8").reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "sums"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                own = np.frombuffer(sums, "<i8")
                held[block] = held[block] + own if block in held else own
        columns = [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "sums"])

    parts = docs.select("text").mapInArrow(count, "block int, sums binary")
    # few blocks in each task at first, then one row per block
    spread = parts.repartition("block").mapInArrow(add, "block int, sums binary")
    table = np.zeros((BLOCKS, BUCKETS * DIMENSIONS // BLOCKS))
    for row in spread.collect():  # BLOCKS rows of a fixed size
        table[row["block"]] += np.frombuffer(row["sums"], "<i8")
    table = table.reshape(BUCKETS, DIMENSIONS)
    # log scale within a vector, so that the commonest neighbours do not drown the others
    table = np.sign(table) * np.log1p(np.abs(table))
    table -= table.mean(axis=0)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


WIDTH = 3 * DIMENSIONS + 2


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean, spread and neighbour products of word vectors, share of distinct words, length."""
    hashes, bounds = tokens(texts)
    n = len(bounds) - 1
    rows = np.zeros((n, WIDTH), np.float32)
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    if not len(some):
        return rows
    found = vectors[_bucket(hashes)]
    first = bounds[:-1][some]
    count = sizes[some, None].astype(np.float32)
    mean = np.add.reduceat(found, first, axis=0) / count
    spread = np.add.reduceat(found * found, first, axis=0) / count - mean * mean
    products = np.zeros_like(found)
    products[:-1] = found[:-1] * found[1:]
    products[bounds[1:][some] - 1] = 0
    doc = np.repeat(np.arange(n), sizes)
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(order))
    fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    distinct = np.bincount(doc[order], fresh, n)
    rows[some, :DIMENSIONS] = mean
    rows[some, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(spread, 0))
    rows[some, 2 * DIMENSIONS : 3 * DIMENSIONS] = np.add.reduceat(products, first, axis=0) / count
    rows[some, -2] = distinct[some] / sizes[some]
    rows[:, -1] = np.log1p(sizes)
    return rows


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    share: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.share)
        rows = (pooled(texts, self.vectors) - self.mean) / self.scale
        w1, b1, w2, b2 = (x.astype(np.float64) for x in self.layers)
        # added up in one order for every row, so that equal texts score equal in any company
        hidden = np.broadcast_to(b1, (len(rows), len(b1))).copy()
        for d, weights in enumerate(w1):
            hidden += rows[:, d, None] * weights
        raw = np.full(len(rows), b2[0])
        for unit, weight in zip(np.tanh(hidden).T, w2, strict=True):
            raw += unit * weight
        return 1 / (1 + np.exp(-raw / self.temperature))


def _forward(rows: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(rows @ w1 + b1)
    return hidden, hidden @ w2 + b2


def fit(rows: np.ndarray, labels: np.ndarray, check: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on log loss; the weights with the least loss on the checking rows are kept."""
    random = np.random.default_rng(7)
    layers = [
        random.normal(0, 1 / np.sqrt(rows.shape[1]), (rows.shape[1], HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
        np.zeros(1, np.float32),
    ]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    best, kept = np.inf, [x.copy() for x in layers]
    for step in range(1, STEPS + 1):
        at = random.integers(0, len(rows), BATCH)
        x, y = rows[at], labels[at]
        hidden, raw = _forward(x, layers)
        error = (1 / (1 + np.exp(-raw)) - y) / len(at)
        back = error[:, None] * layers[2] * (1 - hidden * hidden)
        grads = [x.T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ error + DECAY * layers[2], error.sum(keepdims=True)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            layers[i] = (layers[i] - RATE * (1 - step / (STEPS + 1)) * move).astype(np.float32)
        if step % 50 == 0:
            raw = _forward(check, layers)[1]
            loss = float((np.logaddexp(0, raw) - wanted * raw).mean()) if len(check) else 0.0
            if loss <= best:
                best, kept = loss, [x.copy() for x in layers]
    return kept


def train(docs: DataFrame, taught: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``sample`` labelled rows of ``taught``."""
    vectors = word_vectors(docs)
    rows = labelled_sample(taught, labels, label, sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pooled(batch.column("text"), vectors)
        columns = [batch.column("order"), batch.column("label"), pa.array([x.tobytes() for x in found], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["order", "label", "row"])

    known = rows.select("text", F.col("_label").alias("label"), F.xxhash64("doc_id").alias("order"))
    frame = map_texts(known, work, "order long, label int, row binary").toPandas().sort_values(["order", "label"])
    wanted = frame["label"].to_numpy(np.float32)
    share = float(wanted.mean()) if len(wanted) else 0.5
    part = np.arange(len(wanted)) % 10
    train_, check, held = part < 8, part == 8, part == 9
    if len(np.unique(wanted[train_])) < 2:
        return Model(vectors, np.zeros(WIDTH), np.ones(WIDTH), [], 1.0, share)
    found = np.stack([np.frombuffer(x, np.float32) for x in frame["row"]])
    mean, scale = found[train_].mean(axis=0), found[train_].std(axis=0) + 1e-3
    found = (found - mean) / scale
    layers = fit(found[train_], wanted[train_], found[check], wanted[check])
    raw = _forward(found[held], layers)[1].astype(np.float64)
    both = np.stack([np.zeros(len(raw)), raw], axis=1)
    return Model(vectors, mean, scale, layers, temperature(both, wanted[held].astype(int)), share)


def score(docs: DataFrame, model: Model, *others: str) -> DataFrame:
    """The columns ``others`` (doc_id by default), score and predicted."""
    others = others or ("doc_id",)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = model.score(batch.column("text"))
        columns = [*(batch.column(c) for c in others), pa.array(values), pa.array((values >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, [*others, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    columns = dict.fromkeys([*others, "text"])
    return map_texts(docs.select(*columns), work, f"{kinds}, score double, predicted int")
