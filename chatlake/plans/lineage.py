"""A record of what each write read, wrote and how many rows it moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.shaping import counted, rows_seen
from chatlake.sources.lake import write_days


def write_with_lineage(
    df: DataFrame, target: str, log: str, source: str, target_type: str, operation: str,
    source_type: str = "parquet",
) -> int:
    """Write rows by day and append a lineage row; rows are counted while they are written."""
    rows, seen = counted(df)
    write_days(rows, target, "append")
    count = rows_seen(seen)
    spark = df.sparkSession
    entry = spark.createDataFrame(
        [(source_type, source, target_type, target, operation, count)],
        "source_type string, source_path string, target_type string, target_path string, "
        "operation string, record_count long",
    )
    entry.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(log)
    return count
