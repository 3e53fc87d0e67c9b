"""Language of whole texts: sparse multinomial logistic regression on hashed character n-grams.

Letters are lower-cased, everything else counts as a space; n-grams of one to three code points are hashed
into ``BUCKETS`` features with TF-IDF weights of unit length. Document frequencies come from all documents to
learn from. The weights are fitted with follow-the-regularised-leader (per-coordinate rates, elastic net: the
first-order penalty keeps most weights at exactly zero) on a bounded sample, and a temperature fitted on a
held-back part of the sample calibrates the probabilities.

Null text or text without a letter is ``und`` with score 0, and so is every text if there is nothing to learn
from. Repeated rows are predicted each. Rows without a language teach nothing. Only doc_id and text are
looked at for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.calibration import softmax, temperature
from chatlake.llm.common import map_texts, mix, sample_rows, slices
from chatlake.llm.pretokens import _LETTER, _classes

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
#: Documents used for fitting, at most.
SAMPLE = 6_000
#: Rows counted into one matrix.
ROWS = 64
UNKNOWN = "und"

ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (one row per text), and which texts hold a letter."""
    plain = [(text or "").lower() for text in texts]
    points = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(text) for text in plain], np.int64)
    letter = _classes()[points] == _LETTER
    points = np.where(letter, points, 32).astype(np.uint64)
    row = np.repeat(np.arange(len(plain)), sizes)
    some = np.bincount(row[letter], minlength=len(plain)) > 0
    keys = np.zeros(0, np.int64)
    found = []
    code = points + np.uint64(1)
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            code = code[:-1] * np.uint64(0x1FFFFF) + points[order - 1 :] + np.uint64(1)
        if order in ORDERS and len(code):
            # inside one text, and not made of spaces only
            inside = row[: len(code)] == row[order - 1 :]
            real = letter[: len(code)].copy()
            for k in range(1, order):
                real |= letter[k : len(code) + k]
            inside &= real
            bucket = (mix(code[inside] + np.uint64(order)) >> np.uint64(40)).astype(np.int64) % BUCKETS
            found.append(row[: len(inside)][inside] * BUCKETS + bucket)
    keys = np.concatenate(found) if found else keys
    return np.bincount(keys, minlength=len(plain) * BUCKETS).reshape(len(plain), BUCKETS), some


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length; the term frequency grows as a logarithm."""
    rows = np.log1p(counts).astype(np.float32) * idf
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all rows; counted where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), ROWS):
                counts, some = gram_counts(texts[at : at + ROWS])
                total += (counts > 0).sum(axis=0)
                n += int(some.sum())
        used = np.flatnonzero(total)
        columns = [np.append(used, -1), np.append(total[used], n)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequencies, rows = np.zeros(BUCKETS, np.int64), 0
    for found in counts.collect():  # at most BUCKETS + 1 rows
        if found["bucket"] < 0:
            rows = found["n"]
        else:
            frequencies[found["bucket"]] = found["n"]
    return frequencies, rows


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return softmax((rows @ self.weights + self.bias) / self.temperature)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for at in range(0, len(texts), ROWS):
            counts, some = gram_counts(texts[at : at + ROWS])
            found = self.probabilities(_weights(counts, self.idf))
            for i in np.flatnonzero(some):
                best = int(found[i].argmax())
                names[at + i], scores[at + i] = self.languages[best], min(1.0, float(found[i, best]))
        return names, scores


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int):
    """Follow the regularised leader over sparse rows (places, values); weights and bias.

    Each weight follows from its accumulated gradients in closed form; within the first-order penalty it is
    zero. The bias is one more feature that is always on, without penalty.
    """
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    bz, bn = np.zeros(k), np.zeros(k)

    def current(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + l2)

    for _ in range(EPOCHS):
        for (at, x), label in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w, b = current(zi, ni, L1, L2), current(bz, bn, 0.0, 0.0)
            p = x @ w + b
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            bz += p - (np.sqrt(bn + p * p) - np.sqrt(bn)) / ALPHA * b
            bn += p * p
    return current(z, n, L1, L2).astype(np.float32), current(bz, bn, 0.0, 0.0).astype(np.float32)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of ``docs``: frequencies from all rows, weights from at most ``sample`` rows."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    frequencies, total = document_frequencies(known)
    idf = np.log((total + 1) / (frequencies + 1)).astype(np.float32) + 1

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        places, values = [], []
        for at in range(0, len(texts), ROWS):
            counts, some = gram_counts(texts[at : at + ROWS])
            for row, real in zip(_weights(counts, idf), some, strict=True):
                used = np.flatnonzero(row) if real else np.zeros(0, np.int64)
                places.append(used.astype("<i4").tobytes())
                values.append(row[used].astype("<f4").tobytes())
        columns = [batch.column("doc_id"), batch.column("lang"), pa.array(places, pa.binary()), pa.array(values, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "places", "values"])

    ids = F.broadcast(sample_rows(known.select("doc_id").where("doc_id is not null").distinct(), "doc_id", sample))
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = map_texts(known.join(ids, "doc_id"), count, f"doc_id {key}, lang string, places binary, values binary")
    frame = rows.dropDuplicates(["doc_id"]).toPandas()
    frame = frame[frame["places"].map(len) > 0].sort_values("doc_id").sample(frac=1.0, random_state=7)
    languages = sorted(set(frame["lang"]))
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    labels = frame["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    sparse = [
        (np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(x, "<f4"))
        for at, x in zip(frame["places"], frame["values"], strict=True)
    ]
    held = np.arange(len(labels)) % 10 == 9
    weights, bias = fit([sparse[i] for i in np.flatnonzero(~held)], labels[~held], len(languages))
    logits = np.array([sparse[i][1] @ weights[sparse[i][0]] + bias for i in np.flatnonzero(held)]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, temperature(logits, labels[held]))


def predict(docs: DataFrame, model: Model, *others: str) -> DataFrame:
    """The columns ``others`` (doc_id by default), lang_pred and score."""
    others = others or ("doc_id",)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = model.predict(batch.column("text").to_pylist())
        columns = [*(batch.column(c) for c in others), pa.array(names, pa.string()), pa.array(scores)]
        return pa.RecordBatch.from_arrays(columns, [*others, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    columns = dict.fromkeys([*others, "text"])
    return map_texts(docs.select(*columns), work, f"{kinds}, lang_pred string, score double")


def kept(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents in a language the model knows, with at least this probability; all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = model.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([a != UNKNOWN and b >= least for a, b in zip(names, scores, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
