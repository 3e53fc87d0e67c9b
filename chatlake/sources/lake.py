"""The day-partitioned Parquet message table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.operators.cleaning import complete_messages, conform, valid_lines

DAY_TEXT = {"year": "yyyy", "month": "MM", "day": "dd"}

# Inside a day rows lie by room and time, so a room's rows share few row groups.
ROW_ORDER = ["chatroom", "create_time"]
# Lookups by id can skip row groups through a Bloom filter. The least of the tried sizes that holds the ids
# is written: 1 MB halved eleven times, so a day of a few hundred rows carries less than 1 KB of it.
ID_FILTER = {
    "parquet.bloom.filter.enabled#msg_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.candidates.number#msg_id": "12",
}


def write_days(
    df: DataFrame,
    root: str,
    mode: str = "append",
    compression: str = "snappy",
    time_column: str = "create_time",
    id_filter: bool = True,
    **options: str,
) -> None:
    """Write rows into ``year=/month=/day=`` folders.

    ``rebalance`` gathers a small day into one file and splits a very large one at run time,
    so neither many tiny files nor one giant task comes out. ``id_filter`` writes Bloom filters,
    with which a search by message id skips row groups.
    """
    padded = df.withColumns({n: F.date_format(time_column, p) for n, p in DAY_TEXT.items()})
    order = [*schemas.PARTITION_COLUMNS, *[name for name in ROW_ORDER if name in df.columns]]
    writer = (
        padded.hint("rebalance", *schemas.PARTITION_COLUMNS)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("compression", compression)
        .option("partitionOverwriteMode", "dynamic")
    )
    if id_filter:
        writer = writer.options(**ID_FILTER)
    for name, value in options.items():
        writer = writer.option(name.replace("__", "."), value)
    writer.partitionBy(*schemas.PARTITION_COLUMNS).parquet(root)


def convert_lines(
    lines: DataFrame, root: str, mode: str = "overwrite", compression: str = "snappy"
) -> None:
    """Clean complete JSON lines and land them.

    ``overwrite`` replaces only the days touched, ``append`` adds files to them.
    """
    write_days(complete_messages(valid_lines(lines)), root, mode, compression)


def append_messages(messages: DataFrame, root: str, compression: str = "snappy") -> None:
    """Add rows as new files, stamping the ingestion time where it is missing."""
    rows = conform(messages)
    now = F.date_trunc("second", F.current_timestamp())
    stamped = rows.withColumn("ingestion_time", F.coalesce("ingestion_time", now))
    write_days(stamped, root, "append", compression)


def read_lake(spark: SparkSession, root: str) -> DataFrame:
    """The whole table, with ``year``, ``month`` and ``day`` as integers."""
    return spark.read.parquet(root)


FILES_PER_TASK = 1024
BYTES_PER_TASK = 256 << 20


def in_larger_tasks(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows``, which are read from the files of ``table``, in fewer tasks where these files are small.

    Spark reckons 4 MB for opening a file, so a task gets some dozens of small ones, and a shuffle behind it
    costs more than the reading: each task writes a file per shuffle partition. Here there are two tasks for each
    core, or more where one would get over ``FILES_PER_TASK`` files or ``BYTES_PER_TASK`` bytes on average, and
    never more than Spark would make.
    """
    spark, plan = rows.sparkSession, table._jdf
    size = plan.queryExecution().optimizedPlan().stats().sizeInBytes()
    tasks = max(len(plan.inputFiles()) // FILES_PER_TASK, size // BYTES_PER_TASK) + 1
    return rows.coalesce(max(tasks, 2 * spark.sparkContext.defaultParallelism))


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A written table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_union(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All rows of several tables whose columns may differ."""
    first, *others = [spark.read.option("mergeSchema", "true").parquet(root) for root in roots]
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
