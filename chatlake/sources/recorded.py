"""A data source over recorded pages of an outside endpoint.

Pages are files that hold what the endpoint returned; nothing is fetched here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chatlake.sources.files import entries_of, file_system_of


class _RecordedReader(DataSourceReader):
    def __init__(self, folder: str, suffix: str, pages_per_task: int) -> None:
        self.folder, self.suffix, self.pages_per_task = folder, suffix, pages_per_task

    def partitions(self) -> list[InputPartition]:
        listed = entries_of(self.folder, recursive=True)
        pages = sorted(path for path, is_dir, _ in listed if not is_dir and path.endswith(self.suffix))
        starts = range(0, len(pages), self.pages_per_task)
        return [InputPartition(pages[start : start + self.pages_per_task]) for start in starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            system, inside = file_system_of(path)
            name = path.rsplit("/", 1)[-1]
            with system.open_input_stream(inside) as handle:
                records = json.loads(handle.read().decode("utf-8"))
            for number, record in enumerate(records):
                yield (name, number, json.dumps(record, ensure_ascii=False))


class RecordedPages(DataSource):
    """``spark.read.format("recorded_pages").load(folder)``, read where the tasks run.

    A page is a JSON file with a list of records, as an endpoint would return them.
    Options: ``suffix`` of the page files, and ``pages_per_task``.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "page string, record_no int, record string"

    def reader(self, schema) -> DataSourceReader:
        options = self.options
        return _RecordedReader(
            options["path"], options.get("suffix", ".json"), int(options.get("pages_per_task", 100))
        )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedPages)


def read_pages(spark: SparkSession, folder: str, suffix: str = ".json") -> DataFrame:
    """Records of the recorded pages below a folder."""
    register(spark)
    return spark.read.format("recorded_pages").option("suffix", suffix).load(folder)
