"""Files of one text each."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from chatlake.catalog import reading
from chatlake.sources import files
from chatlake.sources.adapters import Tables
from tests.conftest import DATA


def test_texts_are_files(spark, tmp_path) -> None:
    """Each file has its content, and nothing else is left."""
    texts = {f"f={i % 3}/page={i}.txt": "" if i == 7 else f"é {i}" for i in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "path string, value string")
    files.write_texts(rows.withColumn("value", F.when(F.col("value") != "", F.col("value"))), str(tmp_path / "out"))
    found = files.checksums(spark, str(tmp_path / "out"), "*.txt").collect()
    wanted = {path: hashlib.md5(f"{text}\n".encode()).hexdigest() for path, text in texts.items()}
    assert {"/".join(r["file_path"].split("/")[-2:]): r["md5"] for r in found} == wanted
    assert not [p for p in (tmp_path / "out").rglob(".*")]


def test_pages_lie_in_few_folders(spark, monkeypatch) -> None:
    """Folders are listed task by task: many pages share one."""
    found = []
    real = files.checksums
    monkeypatch.setattr(files, "checksums", lambda *args: found.append(real(*args)) or found[0])
    reading.file_checksums(Tables(spark, DATA)).collect()
    folder = F.regexp_extract("file_path", "(.*)/", 1)
    row = found[0].agg(F.count_distinct(folder).alias("folders"), F.count_distinct(F.regexp_extract(folder, r"page=\d+", 0)).alias("own")).first()
    assert row["folders"] <= 25 and row["own"] == 1
