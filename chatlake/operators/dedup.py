"""Duplicate detection and keep-first deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.operators.skew import keep_first, keep_first_by_place
from chatlake.session import scratch_path
from chatlake.sources.lake import read_lake, write_days

FILE_ORDER = ["_file", "_index"]


def with_file_order(df: DataFrame) -> DataFrame:
    """Add the physical place of each Parquet row, the order in which "first" is meant."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_index"),
    )


def duplicates(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    """Ids that occur more than once, with their number of copies."""
    counts = messages.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") > 1)


def duplicate_summary(found: DataFrame) -> DataFrame:
    """How many ids are duplicated, and how many rows are surplus."""
    return found.agg(
        F.count(F.lit(1)).alias("duplicate_ids"),
        F.coalesce(F.sum("count") - F.count(F.lit(1)), F.lit(0)).alias("surplus_rows"),
    )


def deduplicate(df: DataFrame, order: Sequence[str], key: Sequence[str] = ("msg_id",)) -> DataFrame:
    """Keep the first row per key."""
    return keep_first(df, list(key), order)


def deduplicate_per_day(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keep the first row per id within each day; the same id may stay on two days.

    No two rows may share a place in ``order``.
    """
    return keep_first_by_place(df, [*schemas.PARTITION_COLUMNS, "msg_id"], order)


def deduplicate_day(
    spark: SparkSession, root: str, year: int, month: int, day: int, in_place: bool = True
) -> str:
    """Keep the first row per id over all files of one day; returns where the result lies.

    The result is staged. In place it then replaces the day, otherwise it is written to a
    table next to the root with the suffix ``_dedup``.
    """
    source = read_lake(spark, root)
    wanted = (F.col("year") == year) & (F.col("month") == month) & (F.col("day") == day)
    rows = with_file_order(source).filter(wanted)
    kept = keep_first_by_place(rows, ["msg_id"], FILE_ORDER).select(*source.columns)
    if not in_place:
        target = f"{root.rstrip('/')}_dedup"
        write_days(kept.drop(*schemas.PARTITION_COLUMNS), target, "overwrite")
        return target
    staged = scratch_path(spark, "day")
    write_days(kept.drop(*schemas.PARTITION_COLUMNS), staged, "overwrite")
    write_days(read_lake(spark, staged).drop(*schemas.PARTITION_COLUMNS), root, "overwrite")
    return root


def compact_lake(spark: SparkSession, root: str, out: str | None = None) -> DataFrame:
    """Deduplicate every day and rewrite it compactly; returns the row counts.

    The result is staged in full before anything under ``root`` is replaced, so the plan
    never overwrites what it reads and a failed run can be repeated.
    """
    source = read_lake(spark, root)
    ordered = with_file_order(source)
    kept = deduplicate_per_day(ordered, FILE_ORDER).select(*source.columns)
    target = out or scratch_path(spark, "compact")
    write_days(kept.drop(*schemas.PARTITION_COLUMNS), target, "overwrite")
    before, after = source.count(), read_lake(spark, target).count()
    if out is None:
        staged = read_lake(spark, target).drop(*schemas.PARTITION_COLUMNS)
        write_days(staged, root, "overwrite")
    return spark.createDataFrame(
        [(before, after, before - after)], "rows_before long, rows_after long, removed long"
    )
