"""Append-only logs and the current row they imply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.skew import keep_last


def latest(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row written per key: the current state of an upserted table."""
    return keep_last(log, list(key), order)


def checkpoint_status(log: DataFrame, sources: DataFrame, order: str = "log_no") -> DataFrame:
    """Ingestion state of each source file; a file without a log row has not started."""
    current = latest(log, ["source_file"], [order])
    joined = sources.select("source_file").distinct().join(current, "source_file", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("status", F.lit("not_started")),
            "last_processed_line": F.coalesce("last_processed_line", F.lit(0)),
            "processed_record_count": F.coalesce("processed_record_count", F.lit(0)),
        }
    )


def completed_files(log: DataFrame, from_username: str, order: str = "log_no") -> DataFrame:
    """Files whose latest checkpoint is a completed one of this sender."""
    current = latest(log, ["parquet_file"], [order])
    done = (F.col("status") == "completed") & (F.col("from_username") == from_username)
    return current.filter(done).select("parquet_file")


def unprocessed(files: DataFrame, log: DataFrame, from_username: str) -> DataFrame:
    """Files this sender has not completed."""
    return files.join(completed_files(log, from_username), "parquet_file", "left_anti")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
