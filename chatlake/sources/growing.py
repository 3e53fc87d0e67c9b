"""Lines of files that still grow, as a streaming source whose offset is a byte position per file.

Each batch reads what was added to each file since the last one, up to the last line feed: a line that is only
half written waits until it is whole. Positions lie in the query's checkpoint, so a restarted query goes on where
the last one ended, and a batch that is repeated reads the same bytes. A file that has become shorter was replaced
and is read from its start. Long additions are read in pieces by several tasks.

Files are reached through the file system that the path names (Arrow's: local or a shared mount, HDFS, S3). Blank
lines are given as they are; a trailing carriage return is no part of a line; bytes that are no UTF-8 become the
replacement sign. The offset holds one number per file of the folder: move files away once they are done with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that one task reads, and that are held at once.
PIECE, BUFFER = 32 << 20, 1 << 20
SCHEMA = "value string, source_file string, position long"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)
    return fs.LocalFileSystem(), path


def whole_lines_end(system: fs.FileSystem, path: str, size: int, start: int) -> int:
    """The position behind the last line feed of the bytes from ``start`` to ``size``, or ``start``."""
    with system.open_input_file(path) as source:
        end = size
        while end > start:
            first = max(start, end - BUFFER)
            found = source.read_at(end - first, first).rfind(b"\n")
            if found >= 0:
                return first + found + 1
            end = first
    return start


@dataclass
class Piece(InputPartition):
    """Lines of one file that begin from ``first`` to before ``last``, of a span from ``start`` to ``end``."""

    path: str
    start: int
    first: int
    last: int
    end: int


def read_piece(system: fs.FileSystem, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """Position and bytes of each line that begins inside the piece; the span ends with a line feed."""
    with system.open_input_file(piece.path) as source:
        at, rest, skipping = piece.first, b"", piece.first > piece.start
        if skipping:
            # a line that began before belongs to the piece before, also one that ends just here
            at -= 1
        begins = at
        while at < piece.end and (begins < piece.last or rest or skipping):
            data = source.read_at(min(BUFFER, piece.end - at), at)
            if not data:
                return
            at += len(data)
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if not skipping:
                    if begins >= piece.last:
                        return
                    yield begins, line.removesuffix(b"\r")
                skipping = False
                begins += len(line) + 1


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, root = _system(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            name = info.base_name
            if info.type != fs.FileType.File or name.startswith((".", "_")) or not name.endswith(self.suffix):
                continue
            known = self.known.get(info.path, 0)
            start = known if known <= info.size else 0
            found[info.path] = whole_lines_end(system, info.path, info.size, start)
        self.known = found
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, pieces = json.loads(start["files"]), []
        for path, last in sorted(json.loads(end["files"]).items()):
            first = before.get(path, 0)
            first = first if first <= last else 0
            pieces += [Piece(path, first, at, min(at + PIECE, last), last) for at in range(first, last, PIECE)]
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        rows: list[tuple[int, bytes]] = []
        held = 0
        for row in read_piece(system, piece):
            rows.append(row)
            held += len(row[1])
            if held > BUFFER:
                yield _batch(rows, piece.path)
                rows, held = [], 0
        if rows:
            yield _batch(rows, piece.path)


def _batch(rows: list[tuple[int, bytes]], path: str) -> pa.RecordBatch:
    texts = pa.array([line.decode(errors="replace") for _, line in rows], pa.string())
    places = pa.array([place for place, _ in rows], pa.int64())
    return pa.RecordBatch.from_arrays([texts, pa.array([path] * len(rows)), places], ["value", "source_file", "position"])


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").load(folder)``; the option ``suffix`` chooses files by their end."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def land_lines(lines: DataFrame, path: str, file: str, order: str) -> None:
    """Write the column ``value`` of each ``file`` in order, as one file each, in place of an older version.

    A file is written beside its place and then moved there, so readers never see half of it, and a task
    that is repeated gives the same file. Lines are streamed; a task holds a batch of them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(path)
        system.create_dir(root, recursive=True)
        name, target, written = None, None, []

        def finish() -> None:
            if target is not None:
                target.close()
                system.move(f"{root}/.{name}.{mark}", f"{root}/{name}")
                written.append(name)

        mark = uuid.uuid4().hex
        for batch in batches:
            owners = batch.column(file).to_pylist()
            ends = [i for i in range(1, len(owners)) if owners[i] != owners[i - 1]]
            for first, end in zip([0, *ends], [*ends, len(owners)], strict=True):
                if first == end:
                    continue
                if target is None or owners[first] != name:
                    finish()
                    name, target = owners[first], system.open_output_stream(f"{root}/.{owners[first]}.{mark}")
                values = batch.column("value").slice(first, end - first).to_pylist()
                target.write("\n".join([value or "" for value in values]).encode() + b"\n")
        finish()
        yield pa.RecordBatch.from_pydict({"name": pa.array(written, pa.string())})

    dealt = lines.select("value", F.col(file).cast("string").alias(file), order).repartition(file)
    dealt.sortWithinPartitions(file, order, "value").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def stream_growing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """value, source_file, position of the lines of files below a folder, also of those added later."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("suffix", suffix).load(path)
