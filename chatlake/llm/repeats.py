"""Removal of byte strings that occur more than once, by common-prefix intervals of an enhanced suffix array.

Every ``length``-byte string holds an anchor: the place, among its windows of ``GRAM`` bytes, whose hash is
lowest (the leftmost, if equal). Equal strings have their anchors in the same place, so it is enough to sort
the suffixes that start at anchors, and the suffix array falls apart by anchor hash. Anchors met once are
dropped before any text moves. For the others, occurrences with the same bytes around are one class, and
one of each class fetches its bytes: up to ``length`` to the right, and to the left as far as a string
with this anchor can reach.

Each task then holds whole pieces of the suffix array: classes by anchor, sorted by their bytes to the right,
with the common prefixes of neighbours. A stack scan finds all common-prefix intervals. The members of an
interval share ``r`` bytes to the right; their left bytes, sorted from the anchor outwards, show how far
each extends together with some other member (``l``). Where the left bytes are diverse the interval is a
maximal repeat; members with l + r >= length form groups, and [anchor - l, anchor + r) is a repeat at every
occurrence of their classes. The spans go back to the texts, where their union is cut out.

Texts that occur as a whole more than once count once, with their number; all of such a text is a repeat if
it is long enough. Null text is empty; shorter texts lose nothing. Texts are known by a 64-bit hash.
Repeated rows get their own results. Only doc_id and text of the input are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import mix, prefix_sums, slices, span_hashes, text_bytes
from chatlake.session import cut_lineage

LENGTH = 200
GRAM = 40
#: Bytes of texts whose anchors are found at a time; the arrays for that take about eighty times as much.
TEXT_BYTES = 1 << 18
#: Suffixes a task sorts into one piece at least, before it scans.
PIECE = 4096


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Places of anchors, and the hash of the bytes at every place."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), prefix_sums(data)
    sums = prefix_sums(data)
    places = np.arange(n - gram + 1)
    hashes = span_hashes(sums, places, places + gram)
    # the lowest upper half, then the leftmost place
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    # only strings inside one text
    ends = np.minimum(offsets[1:] - length + 1, len(low))
    some = ends > offsets[:-1]
    edge = np.zeros(len(low) + 1, np.int32)
    edge[offsets[:-1][some]] += 1
    np.subtract.at(edge, ends[some], 1)
    found = (low[np.cumsum(edge[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(found):
        return found, hashes[:0], sums
    found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    return found, hashes[found], sums


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal texts in a partition, the first."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(batch.column("rid").to_pylist()):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, by which a text is known."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("rid"))


def anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """h, c, rid, pos: anchor hash, hash of the bytes around it, text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_once(batches), TEXT_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            at, hashes, sums = anchors_of(data, offsets, length, gram)
            doc = np.searchsorted(offsets, at, side="right") - 1
            left = np.maximum(at - (length - gram), offsets[doc])
            right = np.minimum(at + length, offsets[doc + 1])
            shape = ((at - left) * 1000 + (right - at)).astype(np.uint64)
            around = mix(span_hashes(sums, left, right) + shape)
            columns = [
                pa.array(hashes.astype(np.int64)),
                pa.array(around.astype(np.int64)),
                batch.column("rid").take(pa.array(doc)),
                pa.array((at - offsets[doc]).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "rid", "pos"])

    long = texts.where(F.octet_length("text") >= length).select("rid", "text")
    return long.mapInArrow(run, "h long, c long, rid long, pos long")


def _contexts(texts: DataFrame, chosen: DataFrame, length: int, gram: int) -> DataFrame:
    """h, c, m, lefts (reversed bytes before the anchor), rights (bytes from the anchor on)."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _once(batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = text.encode()
                for item in wanted:
                    pos = item["pos"]
                    before = data[max(0, pos - (length - gram)) : pos][::-1]
                    rows.append((item["h"], item["c"], item["m"], before, data[pos : pos + length]))
            names = ["h", "c", "m", "lefts", "rights"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(column), kind) for column, kind in zip(columns, kinds, strict=True)], names
            )

    wanted = chosen.groupBy("rid").agg(F.collect_list(F.struct("h", "c", "m", "pos")).alias("wanted"))
    bodies = texts.where(F.octet_length("text") >= length).select("rid", "text").mapInArrow(first, "rid long, text string")
    return bodies.join(wanted, "rid").select("text", "wanted").mapInArrow(
        run, "h long, c long, m long, lefts binary, rights binary"
    )


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (differ.bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """All common-prefix intervals (first, last, common length) of a sorted array, by a stack scan.

    ``prefixes[i]`` is the common prefix of rows i - 1 and i; the first counts as 0. Intervals come out
    from the inside to the outside, each with all its rows.
    """
    stack: list[tuple[int, int]] = []
    n = len(prefixes)
    for i in range(1, n + 1):
        now = prefixes[i] if i < n else -1
        start = i - 1
        while stack and stack[-1][1] > now:
            start, common = stack.pop()
            yield start, i - 1, common
        if now >= 0 and (not stack or stack[-1][1] < now):
            stack.append((start, now))


def repeat_groups(lefts: list[bytes], rights: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(row, left, right) for each row of one anchor and each maximal repeat that it belongs to.

    Rows are classes with different surroundings, sorted by their right bytes.
    """
    n = len(rights)
    prefixes = [0, *(_common(rights[i - 1], rights[i]) for i in range(1, n))]
    for first, last, common in intervals(prefixes):
        if common < gram:
            continue
        need = length - common
        rows = sorted(range(first, last + 1), key=lefts.__getitem__)
        shared = [0, *(_common(lefts[a], lefts[b]) for a, b in zip(rows[:-1], rows[1:], strict=True)), 0]
        # how far left a member extends with the member most like it
        for k, row in enumerate(rows):
            reach = max(shared[k], shared[k + 1])
            if reach >= need:
                yield row, reach, common


def _scan(suffixes: DataFrame, length: int, gram: int) -> DataFrame:
    """h, c, reach, common: the repeats of each class."""

    def piece(table: pa.Table) -> pa.RecordBatch:
        h, c = table.column("h").to_numpy(), table.column("c").to_numpy()
        m = table.column("m").to_numpy()
        lefts, rights = table.column("lefts").to_pylist(), table.column("rights").to_pylist()
        out: list[tuple[int, int, int]] = []
        bounds = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = [a]
            for i in range(a + 1, b):  # a class may arrive once per partition of its text
                if c[i] != c[rows[-1]]:
                    rows.append(i)
            whole = set()
            for i in rows:
                if m[i] > 1:  # met more than once with all these bytes around
                    out.append((i, len(lefts[i]), len(rights[i])))
                    whole.add(i)
            if len(rows) > 1 and len(whole) < len(rows):
                found = repeat_groups([lefts[i] for i in rows], [rights[i] for i in rows], length, gram)
                out += [(rows[k], reach, common) for k, reach, common in found if rows[k] not in whole]
        at = np.array([x[0] for x in out], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[at]), pa.array(c[at]), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
            ["h", "c", "reach", "common"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            h = batch.column("h").to_numpy()
            if rows < PIECE or h[0] == h[-1] and len(held) > 1 and held[0].column("h")[0].as_py() == h[-1]:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("h").to_numpy()
            whole = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if whole:
                yield piece(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                rows = table.num_rows - whole
        if rows:
            yield piece(pa.Table.from_batches(held).combine_chunks())

    return suffixes.mapInArrow(run, "h long, c long, reach long, common long")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """rid, first, last, h: every maximal repeat at every place, in bytes; texts that occur twice are one."""
    seen = anchors(texts, length, gram)
    # written, so that both sides of the next join come straight from a shuffle: with nothing above it that
    # needs the rows of an anchor together, a hot anchor can then be split
    more = cut_lineage(seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    places = cut_lineage(seen.join(more, "h", "left_semi"))
    classes = places.distinct().groupBy("h", "c").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("rid", "pos")).alias("one")
    )
    chosen = classes.select("h", "c", "m", "one.rid", "one.pos")
    around = _contexts(texts, chosen, length, gram)
    ordered = around.repartition("h").sortWithinPartitions("h", "rights", "c")
    cover = cut_lineage(_scan(ordered, length, gram))
    return places.join(cover, ["h", "c"]).select(
        "rid", (F.col("pos") - F.col("reach")).alias("first"), (F.col("pos") + F.col("common")).alias("last"), "h"
    )


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], last))
        else:
            merged.append((first, last))
    return merged


def _with_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """row (all columns of docs), text, found: spans of each document, not yet united."""
    texts = with_key(docs)
    whole = (
        texts.select("rid", F.octet_length("text").cast("long").alias("n"))
        .groupBy("rid")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("last"))
        .where((F.col("rows") > 1) & (F.col("last") >= length))
        .select("rid", F.lit(0).cast("long").alias("first"), "last")
    )
    found = repeated_spans(texts, length, gram).select("rid", "first", "last")
    spans = found.union(whole).groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"))
    # the text moves inside its row only
    return rows.join(spans, "rid", "left").select("row", F.coalesce("row.text", F.lit("")).alias("text"), "found")


def _cuts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]], bytes]]:
    """Bytes, removed runs and remaining bytes of each text."""
    for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
        data = text.encode()
        gone = _union([(x["first"], x["last"]) for x in found or []])
        edges = [0, *(x for span in gone for x in span), len(data)]
        yield data, gone, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (array of first and last byte of each removed run), kept (the other bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in slices(batches):
            data, gone, kept = zip(*_cuts(batch), strict=True)
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) for x in data], pa.int64()),
                pa.array([[{"first": a, "last": b} for a, b in spans] for spans in gone], kind),
                pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs.select("doc_id", "text"), length, gram).select("row.doc_id", "text", "found").mapInArrow(
        cut, f"doc_id {key}, n_bytes long, spans array<struct<first: long, last: long>>, kept binary"
    )


def shortened(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All documents with their repeats cut out of text; n_chars, if there is one, follows the new text.

    A code point of which only some bytes are left goes as a whole. Null text stays null; a document of which
    nothing is left stays with empty text.
    """
    counted = "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.column("row")
            old = rows.field("text")
            texts = [kept.decode(errors="ignore") if gone else None for _, gone, kept in _cuts(batch)]
            columns = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
            columns["text"] = pa.array(
                [b if a is None else a for a, b in zip(texts, old.to_pylist(), strict=True)], old.type
            )
            if counted:
                kind = rows.field("n_chars").type
                columns["n_chars"] = pa.array(
                    [b if a is None else len(a) for a, b in zip(texts, rows.field("n_chars").to_pylist(), strict=True)], kind
                )
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return _with_spans(docs, length, gram).mapInArrow(cut, docs.schema)
