"""Facts about day partitions: sizes, ages, scan estimates, usage and compression."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.sources import files

DAY = schemas.PARTITION_COLUMNS

# Age buckets in days, upper bounds inclusive.
AGE_BUCKETS = {
    "0-7_days": 7,
    "8-30_days": 30,
    "31-90_days": 90,
    "91-180_days": 180,
    "181-365_days": 365,
    "over_365_days": None,
}
PARTITION_COST = 100
EFFICIENT_PARTITIONS = 31
MEGABYTE = 1024 * 1024


def day_counts(messages: DataFrame) -> DataFrame:
    """Rows per day partition."""
    return messages.groupBy(*DAY).agg(F.count(F.lit(1)).alias("row_count"))


def scan_partitions(lake: DataFrame, time_column: str = "create_time") -> DataFrame:
    """Files, bytes, rows and time bounds of every day; counted per file first."""
    per_file = (
        lake.select(*DAY, time_column, "_metadata.file_path", "_metadata.file_size")
        .groupBy(*DAY, "file_path")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max("file_size").alias("_bytes"),
            F.min(time_column).alias("_first"),
            F.max(time_column).alias("_last"),
        )
    )
    return per_file.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("_bytes").alias("total_size"),
        F.sum("_rows").alias("row_count"),
        F.min("_first").alias("first_time"),
        F.max("_last").alias("last_time"),
    )


def scan_footers(footers: DataFrame) -> DataFrame:
    """The same facts from file footers alone, for tables too large to be read for this.

    Times are null where a file has no statistics on the time column.
    """
    placed = footers.filter("readable").withColumn("_p", files.parse_path(F.col("file_path")))
    return placed.select("*", "_p.*").groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("file_size").alias("total_size"),
        F.sum("row_count").alias("row_count"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


def with_labels(partitions: DataFrame) -> DataFrame:
    """Key text and size in megabytes of each partition row."""
    return partitions.withColumns(
        {
            "partition_key": files.partition_key(*[F.col(name) for name in DAY]),
            "size_mb": F.round(F.col("total_size") / MEGABYTE, 6),
        }
    )


def partition_totals(partitions: DataFrame) -> DataFrame:
    """Totals with the oldest and newest day; zeros and empty text for an empty table."""
    key = files.partition_key(*[F.col(name) for name in DAY])
    return partitions.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.min(key), F.lit("")).alias("oldest"),
        F.coalesce(F.max(key), F.lit("")).alias("newest"),
    )


def storage_usage(spark: SparkSession, roots: dict[str, tuple[str, str]]) -> DataFrame:
    """Files and bytes per tier from ``{tier: (root, file pattern)}``, plus a total row."""
    listings = [
        files.list_files(spark, root, pattern).select(F.lit(tier).alias("tier"), "file_size")
        for tier, (root, pattern) in roots.items()
    ]
    sizes = reduce(DataFrame.unionByName, listings)
    tier = F.when(F.grouping("tier") == 1, "total").otherwise(F.col("tier"))
    return (
        sizes.rollup("tier")
        .agg(
            tier.alias("_tier"),
            F.count(F.lit(1)).alias("file_count"),
            F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        )
        .select(F.col("_tier").alias("tier"), "file_count", "total_bytes")
    )


def age_distribution(partitions: DataFrame, as_of: date) -> DataFrame:
    """Number of partitions per age bucket on a given day; every bucket is listed."""
    age = F.date_diff(F.lit(as_of), F.make_date(*DAY))
    lower = None
    counts = []
    for name, upper in AGE_BUCKETS.items():
        inside = F.lit(True) if lower is None else age > lower
        if upper is not None:
            inside = inside & (age <= upper)
        counts.append(F.struct(F.lit(name).alias("bucket"), F.count_if(inside).alias("partitions")))
        lower = upper
    totals = partitions.select(*DAY).distinct().agg(F.array(*counts).alias("_buckets"))
    return totals.select(F.inline("_buckets"))


def compression_stats(footers: DataFrame) -> DataFrame:
    """Real compressed against uncompressed bytes."""
    return footers.filter("readable").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("compressed").alias("compressed_bytes"),
        F.sum("uncompressed").alias("uncompressed_bytes"),
        F.round(F.sum("uncompressed") / F.sum("compressed"), 6).alias("compression_ratio"),
    )


def conversion_report(messages: DataFrame, batch_size: int = 10_000) -> DataFrame:
    """Records, days and write batches of a conversion."""
    batches = F.ceil(F.col("row_count") / batch_size)
    return day_counts(messages).agg(
        F.sum("row_count").alias("total_records"),
        F.count(F.lit(1)).alias("partitions"),
        F.sum(batches).alias("batches"),
    )


def conversion_sizes(raw_files: DataFrame, stored_files: DataFrame) -> DataFrame:
    """Bytes of the raw files, bytes of the table, and how many times smaller it is."""
    tagged = raw_files.select("file_size", F.lit(True).alias("raw")).unionByName(
        stored_files.select("file_size", F.lit(False).alias("raw"))
    )
    size = F.coalesce("file_size", F.lit(0))
    both = tagged.agg(
        F.count_if("raw").alias("raw_files"),
        F.coalesce(F.sum(F.when(F.col("raw"), size)), F.lit(0)).alias("bytes_before"),
        F.count_if(~F.col("raw")).alias("stored_files"),
        F.coalesce(F.sum(F.when(~F.col("raw"), size)), F.lit(0)).alias("bytes_after"),
    )
    return both.withColumn("ratio", F.when(F.col("bytes_after") > 0, F.col("bytes_before") / F.col("bytes_after")))


def scan_estimate(
    ranges: DataFrame, first: str, last: str, known: Column | None = None
) -> DataFrame:
    """Estimated cost of reading each date range, at most the known number of partitions."""
    days = F.date_diff(last, first) + 1
    touched = days if known is None else F.least(days, known)
    return ranges.withColumns(
        {
            "days": days,
            "partitions": touched,
            "cost": touched * PARTITION_COST,
            "efficient": touched <= EFFICIENT_PARTITIONS,
        }
    )
