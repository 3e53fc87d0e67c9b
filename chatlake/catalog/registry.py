"""The registered queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatlake.session import prepare, scratch_path
from chatlake.sources.adapters import Tables, with_adapters
from chatlake.sources.lake import write_days

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the given tables, with the SQL that must agree with it."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return build(Tables(prepare(spark), directory))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_adapters(sql)
        return build

    return register


_LAKES: dict[tuple[str, str, str], str] = {}


def message_lake(tables: Tables, source: str = "fx_messages") -> str:
    """Path of the message table written once per session from an adapter."""
    key = (tables.spark.sparkContext.applicationId, tables.directory, source)
    if key not in _LAKES:
        path = scratch_path(tables.spark, source)
        write_days(tables.view(source).withColumnRenamed("descr", "desc"), path)
        _LAKES[key] = path
    return _LAKES[key]
