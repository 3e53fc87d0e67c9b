"""Near-duplicates by shingle similarity: documents whose sets of five-word shingles agree to 0.8 or more.

Texts with equal shingle sets are one class. Classes that may be similar are found in two ways. SimHash fingerprints
of the same shingles (``simhash.links``) tie classes that differ in few bits; a component of these ties is a key.
Copies with more changes lie further apart, so MinHash finds these: each class has ``BANDS`` more keys, each made of
``ROWS`` least hashes, and two classes of similarity s share none of them with a probability of
(1 - s ** ROWS) ** BANDS, which is below 2e-9 at 0.8. What shares a key is only a candidate: a link needs the exact
similarity of the two whole sets.

First every member of a key's group is held against the smallest one. Groups that these links join to one
component are done. Of the others all pairs across components are held against each other: pair by pair in
small groups, and in cells of two chunks each in large ones, so no task holds a group and no pair is left out.

Words are runs of non-space bytes, ASCII letters in lower case; fewer words than a shingle are one shingle, and
texts without words are one class. Shingles and classes are known by 64-bit hashes. Rows without a doc_id take
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import map_texts, mix
from chatlake.llm.components import components
from chatlake.llm.simhash import SEED, links, majorities, shingle_hashes
from chatlake.session import cut_lineage

SHINGLE = 5
#: Similarity of a link as a fraction, compared in whole numbers.
PART, WHOLE = 4, 5
BANDS, ROWS = 28, 3
#: Groups of more classes are compared in cells.
SMALL = 32
#: Classes of one chunk of a large group; a cell holds two chunks.
CHUNK = 512

_SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64)


def text_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return _distinct(*shingle_hashes(texts, shingle))


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _class_of(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.astype("<u8").tobytes(), SEED)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of band keys per set; empty sets have the same ones."""
    sizes = np.array([len(x) for x in sets], np.int64)
    some = np.flatnonzero(sizes)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    if not len(some):
        return keys
    grams = np.concatenate([sets[i] for i in some])
    begins = np.cumsum(sizes[some]) - sizes[some]
    for band in range(BANDS):
        key = np.full(len(some), band + 1, np.uint64)
        for salt, factor in _SALTS[band * ROWS : (band + 1) * ROWS]:
            values = (grams ^ salt) * (factor | np.uint64(1))
            values ^= values >> np.uint64(32)
            key = mix(key + np.minimum.reduceat(values, begins))
        keys[some, band] = key
    return keys


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes, with so many common members, agree enough."""
    return WHOLE * common >= PART * (a + b - common)


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, cls, fp (the fingerprint as a signed 64-bit number), keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = shingle_hashes(batch.column("text"), SHINGLE)
        sets = _distinct(hashes, bounds)
        classes = np.array([_class_of(x) for x in sets], np.uint64).view(np.int64)
        prints = majorities(hashes, bounds).astype(np.int64)
        keys = pa.array(list(band_keys(sets).view(np.int64)), pa.list_(pa.int64()))
        columns = [batch.column("doc_id"), pa.array(classes), pa.array(prints), keys]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "cls", "fp", "keys"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {key}, cls long, fp long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, grams (the sorted hashes as bytes) of the classes ``wanted`` (low, cls)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = text_sets(batch.column("text"))
        classes = np.array([_class_of(x) for x in sets], np.uint64).view(np.int64)
        # an id may stand over several texts
        own = np.flatnonzero(classes == batch.column("cls").to_numpy())
        grams = pa.array([sets[i].astype("<u8").tobytes() for i in own], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(classes[own]), grams], ["cls", "grams"])

    texts = docs.join(wanted, docs["doc_id"] == wanted["low"]).select("text", "cls")
    return map_texts(texts, work, "cls long, grams binary").dropDuplicates(["cls"])


def _true_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                able = similar(min(len(one), len(two)), len(one), len(two))
                keep.append(bool(able and similar(len(np.intersect1d(one, two, True)), len(one), len(two))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def cell_links(classes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of these sets, each set held against all others outside its component."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(n), sizes)
    order = np.argsort(ids, kind="stable")
    posted, first = rows[order], np.searchsorted(ids[order], np.arange(ids.max(initial=-1) + 2))
    starts = np.cumsum(sizes) - sizes
    root, found = np.arange(n), []
    for i in range(n):
        lists = ids[starts[i] : starts[i] + sizes[i]]
        near = np.concatenate([posted[first[t] : first[t + 1]] for t in lists] or [np.zeros(0, np.int64)])
        common = np.bincount(near, minlength=n)
        for j in np.flatnonzero(similar(common, sizes, sizes[i]) & (root != root[i])):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                found.append((int(classes[i]), int(classes[j])))
    return found


def _cells(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) inside large groups (key, n, cls)."""
    pieces = F.ceil(F.col("n") / CHUNK).cast("long")
    placed = large.withColumn("g", pieces).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("g")))
    spread = placed.select("key", "cls", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("o"))
    cells = spread.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "cls")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        place = None
        for frame in frames:
            for key, i, j, cls, grams in frame.itertuples(index=False):
                if (key, i, j) != place and held:
                    yield links_of(held)
                    held = []
                place = (key, i, j)
                held.append((cls, grams))
        if held:
            yield links_of(held)

    def links_of(held: list[tuple]) -> pd.DataFrame:
        found = cell_links(np.array([x[0] for x in held], np.int64), [np.frombuffer(x[1], "<u8") for x in held])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    dealt = cells.join(sets, "cls").select("key", "i", "j", "cls", "grams").repartition("key", "i", "j")
    return dealt.sortWithinPartitions("key", "i", "j").mapInPandas(run, "a long, b long")


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * WHOLE >= F.greatest(a, b) * PART


def _ties(classes: DataFrame) -> DataFrame:
    """cls, key: the component of its fingerprint (fp), over fingerprints that differ in few bits."""
    tied = components(links(classes.select("fp").distinct()))
    return classes.select("cls", "fp").join(tied, F.col("fp") == tied["node"], "left").select(
        "cls", F.coalesce("root", "fp").alias("key")
    )


def near_duplicates(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links); one row per row with an id."""
    known = docs.where("doc_id is not null").select("doc_id", "text")
    signed = cut_lineage(_signatures(known))
    classes = cut_lineage(signed.groupBy("cls").agg(
        F.min("doc_id").alias("low"), F.min("fp").alias("fp"), F.first("keys").alias("keys")
    ))
    spread = classes.select("cls", F.explode("keys").alias("key")).union(_ties(classes))
    groups = spread.groupBy("key").agg(F.min("cls").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut_lineage(spread.join(groups, "key").select("key", "cls", "first", "n"))
    wanted = classes.join(members.select("cls").distinct(), "cls").select("low", "cls")
    sets = cut_lineage(_sets(known, wanted))
    star = members.where("cls != first").select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct()
    near = cut_lineage(_true_pairs(star, sets))
    roots = components(near)
    rooted = members.join(roots, members["cls"] == roots["node"], "left").select(
        "key", "cls", "n", F.coalesce("root", "cls").alias("root")
    )
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    left_over = cut_lineage(rooted.join(apart.select("key"), "key"))
    sized = left_over.where(F.col("n") <= small).join(sets.select("cls", F.length("grams").alias("size")), "cls")
    other = sized.select("key", F.col("cls").alias("b"), F.col("root").alias("_root"), F.col("size").alias("_size"))
    across = (F.col("cls") < F.col("b")) & (F.col("root") != F.col("_root")) & _sizes_fit(F.col("size"), F.col("_size"))
    pairs = sized.join(other, "key").where(across).select(F.col("cls").alias("a"), "b").distinct()
    rest = _true_pairs(pairs, sets).union(_cells(left_over.where(F.col("n") > small), sets))
    linked = near.union(cut_lineage(rest))
    roots = components(linked)
    named = classes.join(roots, classes["cls"] == roots["node"], "left").select(
        "cls", "low", F.coalesce("root", "cls").alias("root")
    )
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return signed.select("doc_id", "cls").join(named.join(lowest, "root").select("cls", "component_id"), "cls").select(
        "doc_id", "component_id"
    )
