"""SimHash near-duplicates: documents whose fingerprints differ in few bits, by a trie self-join.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's word shingles. Equal fingerprints
are one key from the start, so copies cost nothing further. Two keys within ``BUDGET`` differing bits agree
on at least one of ``BUDGET + 1`` blocks of bits; each key goes to one group per block and value, and each
group holds a binary trie over the bits. The trie is joined with itself from the root: pairs of nodes at
the same depth are followed to pairs of children, differing bits add up, and a pair is dropped as soon as
it has spent the budget. Of the links found in a group only a spanning forest leaves it, one link per key
at most, and a distributed pass joins the forests to components.

Null, empty and blank texts have fingerprint zero, which is linked like any other. Fewer words than a
shingle are one shingle. Repeated rows get their own results. A null doc_id never becomes a component id
unless nothing else is reachable. Only doc_id and text of the input are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import LOWER, SPACE_BYTE, map_texts, runs, text_bytes
from chatlake.llm.components import components
from chatlake.session import cut_lineage

SHINGLE = 4
SEED = 42
BITS = 64
BUDGET = 4
#: Node pairs followed at once.
PAIRS = 1 << 20
#: Rows of whole groups that a task joins in one go.
GROUP_ROWS = 1 << 17

_PLACES = np.arange(BITS, dtype=np.uint64)


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word shingle, and where each text's start (n + 1 bounds)."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends = runs(~SPACE_BYTE[data], offsets)
    # the words of a slice, joined by single spaces: any shingle is one span of these bytes
    lengths = ends - starts
    places = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(places[-1]), 32, np.uint8)
    keep = np.ones(len(joined), bool)
    keep[places[1:] - 1] = False
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.subtract.at(inside, ends, 1)
    joined[keep] = data[np.cumsum(inside[:-1]) > 0]
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    grams = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), grams)
    begin = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    until = np.minimum(begin + shingle, first[1:][doc])
    view = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    spans = zip(places[begin].tolist(), (places[until] - 1).tolist(), strict=True)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(begin))
    return hashes, np.concatenate([[0], np.cumsum(grams)])


def text_fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """One fingerprint per text, as unsigned 64-bit numbers."""
    return majorities(*shingle_hashes(texts, shingle))


def majorities(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its shingle hashes."""
    grams = np.diff(bounds)
    prints = np.zeros(len(grams), np.uint64)
    step = 1 << 16
    ones = np.zeros((len(grams), BITS), np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.clip(bounds[:-1] - at, 0, len(part)), np.clip(bounds[1:] - at, 0, len(part))
        some = np.flatnonzero(hi > lo)
        if len(some):
            ones[some] += np.add.reduceat(bits, lo[some], axis=0, dtype=np.int64)
    set_ = (2 * ones > grams[:, None]).astype(np.uint64)
    prints |= (set_ << _PLACES).sum(axis=1, dtype=np.uint64)
    return prints


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = text_fingerprints(batch.column("text"), shingle).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {key}, fp long")


# -- the trie join of one group ----------------------------------------------------------------


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; every set hangs on its smallest member."""
    while len(a):
        ra, rb = parent[a], parent[b]
        while True:
            na, nb = parent[ra], parent[rb]
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(parent, high, low)


def trie_links(prints: np.ndarray, starts: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each fingerprint, the place of the first one reachable over links inside its group.

    Groups stand one after the other from ``starts`` on, each sorted and distinct: a trie each.

    A trie node is a range of the sorted array; its children are split at the next bit. A stack of node
    pairs, many at once, is followed depth by depth. Pairs whose leaves are already joined need no visit
    only if each side is a single leaf; nothing else is skipped, so no link is lost.
    """
    n = len(prints)
    parent = np.arange(n)
    ends = np.append(starts[1:], n)
    large = ends - starts > 1
    lo, hi = starts[large], ends[large]
    # node pairs: [lo, hi) on both sides, bits spent, and the depth they share
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int64), 0)]
    while stack:
        a0, a1, b0, b1, spent, depth = stack.pop()
        if len(a0) > PAIRS:
            half = len(a0) // 2
            stack.append((a0[half:], a1[half:], b0[half:], b1[half:], spent[half:], depth))
            a0, a1, b0, b1, spent = a0[:half], a1[:half], b0[:half], b1[:half], spent[:half]
        # two single leaves need no more levels: their differing bits are counted at once
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            close = (i != j) & (np.bitwise_count(prints[i] ^ prints[j]) <= budget)
            _union(parent, i[close], j[close])
            a0, a1, b0, b1, spent = (x[~leaf] for x in (a0, a1, b0, b1, spent))
        if not len(a0) or depth == BITS:
            continue
        am, bm = _split(prints, a0, a1, depth), _split(prints, b0, b1, depth)
        same = a0 == b0
        nexts = []
        for left in (0, 1):
            for right in (0, 1):
                p0, p1 = (a0, am) if left == 0 else (am, a1)
                q0, q1 = (b0, bm) if right == 0 else (bm, b1)
                cost = spent + (left != right)
                # of a node with itself, the mirrored pair of children is the same pair
                live = (p1 > p0) & (q1 > q0) & (cost <= budget)
                if left == 1 and right == 0:
                    live &= ~same
                nexts.append(tuple(x[live] for x in (p0, p1, q0, q1, cost)))
        joined = [np.concatenate(column) for column in zip(*nexts, strict=True)]
        if len(joined[0]):
            stack.append((*joined, depth + 1))
    while True:
        root = parent[parent]
        if (root == parent).all():
            return parent
        parent = root


def _split(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where, in sorted ranges that share their first ``depth`` bits, the next bit turns to one."""
    low, high = lo.copy(), hi.copy()
    shift = np.uint64(BITS - 1 - depth)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        one = ((prints[np.minimum(mid, len(prints) - 1)] >> shift) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)


def blocks(budget: int = BUDGET) -> list[tuple[int, int]]:
    """First bit and width of budget + 1 blocks that cover all bits."""
    edges = [round(i * BITS / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def links(keys: DataFrame, budget: int = BUDGET) -> DataFrame:
    """a, b: a spanning forest of the links between distinct fingerprints (column fp)."""
    parts = [
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("value"),
        )
        for i, (at, width) in enumerate(blocks(budget))
    ]

    def join(ids: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((prints, ids))
        ids, prints = ids[order], prints[order]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        root = trie_links(prints, starts, budget)
        linked = np.flatnonzero(root != np.arange(len(prints)))
        signed = prints.astype(np.int64)
        return pd.DataFrame({"a": signed[linked], "b": signed[root[linked]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come ordered by group; many whole groups are joined in one go."""
        ids, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for frame in frames:
            own = frame["block"].to_numpy(np.int64) * (1 << 32) + frame["value"].to_numpy(np.int64)
            ids = np.concatenate([ids, own])
            prints = np.concatenate([prints, frame["fp"].to_numpy(np.int64).astype(np.uint64)])
            if len(ids) > GROUP_ROWS:
                whole = int(np.searchsorted(ids, ids[-1]))
                if whole:
                    yield join(ids[:whole], prints[:whole])
                    ids, prints = ids[whole:], prints[whole:]
        if len(ids):
            yield join(ids, prints)

    spread = keys.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.block", "p.value")
    grouped = spread.repartition("block", "value").sortWithinPartitions("block", "value")
    return grouped.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links), copies (rows with the same fp)."""
    prints = cut_lineage(fingerprints(docs, shingle))
    keys = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")))
    roots = components(links(keys.select("fp"), budget))
    rooted = keys.join(roots, keys["fp"] == roots["node"], "left").select(
        "fp", "low", "copies", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "copies", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "copies")


def keep_one(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """One document of each component, that with the smallest doc_id; of repeated rows with that id, one.

    ``classes`` (doc_id, component_id) are those of the fingerprints unless given. All columns stay as they are.
    Documents without an id stay, since no other row stands for them.
    """
    classes = near_duplicates(docs) if classes is None else classes
    kept = classes.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    chosen = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns)
    others = [c for c in docs.columns if c != "doc_id"]
    once = chosen.groupBy("doc_id").agg(F.first(F.struct(*others)).alias("_row")) if others else chosen.distinct()
    if others:
        once = once.select("doc_id", "_row.*").select(*docs.columns)
    return once.unionByName(docs.where("doc_id is null"))
