"""Partition keys, file listings, checksums, Parquet footers and exports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def partition_key(year: Column, month: Column, day: Column) -> Column:
    """``YYYY-MM-DD``; null when month or day is out of range."""
    padded = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(month.between(1, 12) & day.between(1, 31), padded)


def parse_key(key: Column) -> Column:
    """Struct of year, month and day; null fields where the key does not parse."""
    pattern = r"^(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
    return F.struct(
        *[
            F.regexp_extract(key, pattern, i).try_cast("int").alias(name)
            for i, name in enumerate(("year", "month", "day"), start=1)
        ]
    )


def partition_path(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("year=%04d/month=%02d/day=%02d", year, month, day)


def parse_path(path: Column) -> Column:
    """Struct of year, month and day found in a file or folder path."""
    return F.struct(
        *[
            F.regexp_extract(path, rf"{name}=(\d+)", 1).try_cast("int").alias(name)
            for name in ("year", "month", "day")
        ]
    )


def list_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Path, size and change time of every file below a folder, without reading contents."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return found.select(
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
    )


def partition_files(
    spark: SparkSession, root: str, year: int, month: int | None = None, day: int | None = None
) -> DataFrame:
    """Files of one year, month or day."""
    located = list_files(spark, root).withColumn("_p", parse_path(F.col("file_path")))
    wanted = F.col("_p.year") == year
    if month is not None:
        wanted = wanted & (F.col("_p.month") == month)
    if day is not None:
        wanted = wanted & (F.col("_p.day") == day)
    return located.filter(wanted).select("file_path", "file_size", "modified", "_p.*")


def checksums(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """md5 and CRC32 of every file. A single file must fit an executor's memory."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return found.select(
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size"),
        F.md5("content").alias("md5"),
        F.crc32("content").alias("crc32"),
    )


def write_texts(texts: DataFrame, root: str, path: str = "path", value: str = "value") -> None:
    """One file per row below a folder: the text and a line feed, at the row's path; paths are taken to be distinct.

    Rows are dealt over all tasks, however small they are, as each costs a file. A file is written beside its place
    and then moved there, so a task that is repeated gives the same files. A task keeps the folders it has made in mind.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = file_system_of(root)
        made: set[str] = set()
        mark, written = uuid.uuid4().hex, 0
        for batch in batches:
            for name, text in zip(batch.column(path).to_pylist(), batch.column(value).to_pylist(), strict=True):
                folder, _, base = f"{inside}/{name}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/.{base}.{mark}") as out:
                    out.write((text or "").encode() + b"\n")
                system.move(f"{folder}/.{base}.{mark}", f"{folder}/{base}")
                written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(path, value).repartition(tasks, path)
    dealt.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


FOOTER_SCHEMA = (
    "file_path string, file_size long, readable boolean, error string, row_count long, "
    "column_count int, row_groups int, compressed long, uncompressed long, codec string, "
    "writer string, schema_text string, first_time timestamp, last_time timestamp, "
    "fields array<struct<name:string,type:string,nullable:boolean>>"
)


def file_system_of(path: str):
    """The file system of a path, and the path inside it."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)


def entries_of(path: str, recursive: bool = False) -> list[tuple[str, bool, int]]:
    """Path, folder flag and size of what lies in a folder."""
    from pyarrow import fs

    system, inside = file_system_of(path)
    prefix = path[: path.index(inside)] if inside in path else ""
    found = system.get_file_info(fs.FileSelector(inside, recursive=recursive))
    return [(prefix + e.path, e.type == fs.FileType.Directory, e.size or 0) for e in found]


def walk_files(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """Every file below a folder with its size, empty ones included.

    Spark's own listing leaves out empty files, and these are what a validation looks for.
    The two upper levels (year and month) are listed here, the rest in the tasks.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            for path, is_dir, size in batch.itertuples(index=False):
                found += entries_of(path, recursive=True) if is_dir else [(path, False, size)]
            files = [(p, s) for p, is_dir, s in found if not is_dir and p.endswith(suffix)]
            yield pd.DataFrame(files, columns=["file_path", "file_size"])

    upper = entries_of(root)
    second = [entry for path, is_dir, _ in upper if is_dir for entry in entries_of(path)]
    start = [entry for entry in upper if not entry[1]] + second
    rows = spark.createDataFrame(start, "path string, is_dir boolean, size long")
    return rows.repartition("path").mapInPandas(walk, "file_path string, file_size long")


def _time_bounds(meta, names: list[str], column: str) -> dict:
    """Least and greatest value of a timestamp column, where all row groups know theirs."""
    if column not in names:
        return {"first_time": None, "last_time": None}
    groups = [meta.row_group(group) for group in range(meta.num_row_groups)]
    chunks = [group.column(i) for group in groups for i in range(group.num_columns)]
    stats = [chunk.statistics for chunk in chunks if chunk.path_in_schema == column]
    if not stats or not all(s is not None and s.has_min_max for s in stats):
        return {"first_time": None, "last_time": None}
    return {"first_time": min(s.min for s in stats), "last_time": max(s.max for s in stats)}


def _read_footer(path: str, size: int, time_column: str) -> dict:
    """What the last bytes of a Parquet file say about it."""
    import pyarrow.parquet as pq

    blank = dict.fromkeys(
        ("row_count", "column_count", "row_groups", "compressed", "uncompressed", "codec",
         "writer", "schema_text", "first_time", "last_time", "fields")
    )
    try:
        if size == 0:
            raise ValueError("empty file")
        system, inside = file_system_of(path)
        with system.open_input_file(inside) as handle:
            reader = pq.ParquetFile(handle)
            meta, schema = reader.metadata, reader.schema_arrow
    except Exception as error:  # a file that cannot be read is a finding, not a failure
        return {"file_path": path, "file_size": size, "readable": False, "error": str(error), **blank}
    chunks = [
        meta.row_group(group).column(column)
        for group in range(meta.num_row_groups)
        for column in range(meta.num_columns)
    ]
    fields = [{"name": f.name, "type": str(f.type), "nullable": f.nullable} for f in schema]
    return {
        "file_path": path,
        "file_size": size,
        "readable": True,
        "error": "",
        "row_count": meta.num_rows,
        "column_count": meta.num_columns,
        "row_groups": meta.num_row_groups,
        "compressed": sum(chunk.total_compressed_size for chunk in chunks),
        "uncompressed": sum(chunk.total_uncompressed_size for chunk in chunks),
        "codec": ",".join(sorted({chunk.compression for chunk in chunks})),
        "writer": str(meta.created_by),
        "schema_text": "; ".join(f"{f['name']} {f['type']}" for f in fields),
        **_time_bounds(meta, schema.names, time_column),
        "fields": fields,
    }


def footers(spark: SparkSession, root: str, time_column: str = "create_time") -> DataFrame:
    """Footer facts of every Parquet file, read where the tasks run.

    The listing is split over tasks by path, and only footers are read, so the cost follows
    the number of files and not their size.
    """
    return read_footers(walk_files(spark, root), time_column)


def read_footers(listed: DataFrame, time_column: str = "create_time") -> DataFrame:
    """The same for given files (``file_path``, ``file_size``)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            named = zip(batch["file_path"], batch["file_size"], strict=True)
            frame = pd.DataFrame([_read_footer(path, int(size), time_column) for path, size in named])
            for name in ("first_time", "last_time"):
                frame[name] = pd.to_datetime(frame[name], utc=True)
            yield frame

    return listed.select("file_path", "file_size").repartition("file_path").mapInPandas(read, FOOTER_SCHEMA)
