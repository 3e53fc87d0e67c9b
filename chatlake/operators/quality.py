"""Validation of stored files and quality metrics of stored rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.sources import files

DAY = schemas.PARTITION_COLUMNS


def error_counts(errors: DataFrame) -> DataFrame:
    """Number of dead-letter rows per kind."""
    kind = F.coalesce("error_type", F.lit("unknown")).alias("error_type")
    return errors.groupBy(kind).agg(F.count(F.lit(1)).alias("errors"))


def named_counts(df: DataFrame, column: str, names: Mapping[int, str], null_name: str) -> DataFrame:
    """Rows per code with the name of the code; the name table is a fixed short map."""
    table = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    counted = df.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("row_count"))
    name = F.when(F.col("code").isNull(), null_name).otherwise(
        F.coalesce(F.try_element_at(table, F.col("code")), F.lit("unknown"))
    )
    return counted.withColumn("name", name)


def file_metadata(footers: DataFrame) -> DataFrame:
    """Rows, columns, size and codec of each file."""
    return footers.select("file_path", "row_count", "column_count", "file_size", "codec")


def file_validity(footers: DataFrame) -> DataFrame:
    """Whether each file can be read, has bytes and has rows, with the reasons if not."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("file_size") == 0, F.lit("empty file")),
            F.when(~F.col("readable") & (F.col("file_size") > 0), F.lit("unreadable")),
            F.when(F.col("readable") & (F.col("row_count") == 0), F.lit("no rows")),
        )
    )
    return footers.select("file_path", (F.size(reasons) == 0).alias("valid"), reasons.alias("reasons"))


def file_statistics(footers: DataFrame) -> DataFrame:
    """Row groups, bytes, ratio and writer of each file."""
    return footers.filter("readable").select(
        "file_path", "row_groups", "row_count", "compressed", "uncompressed",
        F.round(F.col("uncompressed") / F.col("compressed"), 6).alias("ratio"), "writer",
    )


def validate_partitions(footers: DataFrame) -> DataFrame:
    """Per day: files, rows, bytes, and what is wrong with it."""
    placed = footers.withColumn("_p", files.parse_path(F.col("file_path"))).select("*", "_p.*")
    empty, broken = F.col("file_size") == 0, ~F.col("readable") & (F.col("file_size") > 0)
    totals = placed.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_records"),
        F.sum("file_size").alias("total_size"),
        F.count_if(empty).alias("_empty"),
        F.count_if(broken).alias("_broken"),
        F.count_distinct("schema_text").alias("_layouts"),
    )
    errors = F.array_compact(
        F.array(
            F.when(F.col("_empty") > 0, F.concat(F.col("_empty"), F.lit(" empty files"))),
            F.when(F.col("_broken") > 0, F.concat(F.col("_broken"), F.lit(" unreadable files"))),
            F.when(F.col("_layouts") > 1, F.lit("files differ in schema")),
        )
    )
    return totals.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0).drop(
        "_empty", "_broken", "_layouts"
    )


def quality_metrics(lake: DataFrame, required: list[str], violation: Column) -> DataFrame:
    """Null rate, duplicate rate and rule violations per day, in long form."""
    nulls = sum(F.count_if(F.col(name).isNull()) for name in required)
    copies = lake.groupBy(*DAY, "msg_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        nulls.alias("_nulls"),
        F.count_if(violation).alias("_bad"),
    )
    rows = F.sum("_rows")
    wide = copies.groupBy(*DAY).agg(
        F.round(F.sum("_nulls") / (rows * len(required)), 6).alias("null_rate"),
        F.round((rows - F.count(F.lit(1))) / rows, 6).alias("duplicate_rate"),
        F.sum("_bad").cast("double").alias("schema_violations"),
    )
    return wide.unpivot(
        DAY, ["null_rate", "duplicate_rate", "schema_violations"], "metric_name", "metric_value"
    )
