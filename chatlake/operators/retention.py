"""Archiving of old days and retention of raw files."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.session import cut_lineage
from chatlake.sources import files
from chatlake.sources.files import file_system_of
from chatlake.sources.lake import read_if_there, read_lake, write_days

DAY = schemas.PARTITION_COLUMNS


def archivable_days(partitions: DataFrame, as_of: date, older_than_days: int = 90) -> DataFrame:
    """Days strictly older than the threshold."""
    threshold = as_of - timedelta(days=older_than_days)
    return partitions.filter(F.make_date(*DAY) < F.lit(threshold))


def _fingerprint(rows: DataFrame) -> DataFrame:
    """Row count and an order-free content checksum per day."""
    content = sorted(name for name in rows.columns if name not in DAY)
    mark = F.xxhash64(*content).cast("decimal(38,0)")
    return rows.groupBy(*DAY).agg(F.count(F.lit(1)).alias("rows"), F.sum(mark).alias("mark"))


def _in_span(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the given days; the first and last day prune folders, the join does the rest."""
    day = F.make_date(*DAY)
    span = days.agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
    near = rows.filter(day.between(F.lit(span["first"]), F.lit(span["last"])))
    return near.join(days, DAY, "left_semi")


def archive_days(
    spark: SparkSession, root: str, archive_root: str, as_of: date, older_than_days: int = 90,
    level: int = 19,
) -> DataFrame:
    """Rewrite old days with zstd, compare contents, and list the days safe to delete.

    A day that is archived already keeps its rows: rows of the lake that the archive lacks join them
    (a row equal to an archived one in every column is that row). The union is staged before it replaces
    the day, and only the days of this run are compared afterwards.
    """
    old = archivable_days(read_lake(spark, root), as_of, older_than_days)
    days = cut_lineage(old.groupBy(*DAY).agg(F.count(F.lit(1)).alias("rows")))
    if not days.take(1):
        return days
    touched = days.select(*DAY)
    archive = read_if_there(spark, archive_root)
    whole = old
    if archive is not None:
        kept = _in_span(archive, touched).select(*old.columns)
        whole = kept.unionByName(old.exceptAll(kept))
    staged = cut_lineage(whole)
    write_days(
        staged.drop(*DAY), archive_root, "overwrite", "zstd",
        parquet__compression__codec__zstd__level=str(level),
    )
    written = _fingerprint(_in_span(read_lake(spark, archive_root), touched).select(*old.columns))
    wanted = _fingerprint(staged)
    same = [wanted[name] == written[name] for name in (*DAY, "rows", "mark")]
    verified = wanted.join(written, same, "left_semi").select(*DAY)
    return cut_lineage(days.join(verified, DAY, "left_semi"))


def archive_report(spark: SparkSession, root: str, archive_root: str, days: DataFrame) -> DataFrame:
    """Bytes before and after for archived days that are still in the lake, and their ratio."""
    def sizes(path: str, name: str) -> DataFrame:
        listed = files.list_files(spark, path).withColumn("_p", files.parse_path(F.col("file_path")))
        return listed.groupBy(*[F.col(f"_p.{n}").alias(n) for n in DAY]).agg(F.sum("file_size").alias(name))

    both = days.join(sizes(root, "bytes_before"), DAY, "left").join(sizes(archive_root, "bytes_after"), DAY, "left")
    return both.withColumn("ratio", F.col("bytes_before") / F.col("bytes_after"))


def retention_plan(
    raw_files: DataFrame, landed: DataFrame, as_of: date, retention_days: int = 7
) -> DataFrame:
    """What to do with each raw day file: only old files whose day has landed may go.

    ``raw_files`` has ``stem`` (file name without suffix), ``landed`` has ``day_key``.
    """
    threshold = as_of - timedelta(days=retention_days)
    day = F.when(F.col("stem").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date("stem"))
    dated = raw_files.withColumn("_day", day)
    present = landed.select(F.try_to_date("day_key").alias("_day"), F.lit(True).alias("_landed")).distinct()
    decision = (
        F.when(F.col("_day").isNull(), "invalid_name")
        .when(F.col("_day") >= F.lit(threshold), "keep")
        .when(F.col("_landed"), "delete")
        .otherwise("no_parquet")
    )
    return dated.join(present, "_day", "left").withColumn("decision", decision).drop("_day", "_landed")


def deletable(raw_files: DataFrame, landed: DataFrame, as_of: date, retention_days: int = 7) -> DataFrame:
    """Old raw files whose day exists in the lake."""
    threshold = as_of - timedelta(days=retention_days)
    old = raw_files.filter(F.try_to_date("stem") < F.lit(threshold))
    return old.join(landed.select(F.col("day_key").alias("stem")), "stem", "left_semi")


def raw_day_files(spark: SparkSession, root: str) -> DataFrame:
    """Raw files with the day they belong to as ``stem``: that of the landing folder, else the file name."""
    listed = files.list_files(spark, root, "*.{jsonl,txt}")
    folder = F.regexp_extract("file_path", r"/arrival_date=([^/]+)/[^/]+$", 1)
    name = F.regexp_extract("file_path", r"([^/]+)\.(?:jsonl|txt)$", 1)
    return listed.withColumn("stem", F.when(folder != "", folder).otherwise(name))


def delete_files(plan: DataFrame) -> DataFrame:
    """The explicit second step: remove the planned files and report each one."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for path in batch["file_path"]:
                try:
                    system, inside = file_system_of(path)
                    system.delete_file(inside)
                    done.append(True)
                except OSError:
                    done.append(False)
            yield batch.assign(deleted=done)

    chosen = plan.filter(F.col("decision") == "delete").select("file_path")
    return chosen.mapInPandas(remove, "file_path string, deleted boolean")


def delete_days(spark: SparkSession, root: str, days: DataFrame) -> DataFrame:
    """Remove the files of whole days, such as those an archive run has verified."""
    listed = files.list_files(spark, root).withColumn("_p", files.parse_path(F.col("file_path")))
    placed = listed.select("file_path", "_p.*").join(days.select(*DAY), DAY, "left_semi")
    return delete_files(placed.withColumn("decision", F.lit("delete")))
