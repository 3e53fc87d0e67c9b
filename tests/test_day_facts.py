"""Facts kept per file against a scan of the whole lake."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlake.operators import day_facts
from chatlake.sources import lake


def _rows(spark, first: int, last: int):
    start = dt.datetime(2024, 1, 5, 1, tzinfo=dt.UTC)
    rows = [
        (f"m{i % 900}" if i % 50 else None, None if i % 7 == 0 else "room", i % 3, "x" * (i % 400) if i % 11 else None,
         start + dt.timedelta(hours=i % 60))
        for i in range(first, last)
    ]
    return spark.createDataFrame(rows, "msg_id string, chatroom string, msg_type int, content string, create_time timestamp")


REQUIRED = ["msg_id", "chatroom"]


def _check(spark, root: str, state: str) -> None:
    found = {(r.year, r.month, r.day): r for r in day_facts.day_facts(spark, root, state).collect()}
    length = F.coalesce(F.length("content"), F.lit(0))
    days = lake.read_lake(spark, root).groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.expr("msg_id is null")) + F.count_if(F.expr("chatroom is null"))).alias("nulls"),
        F.count_if(F.expr("msg_type = 2")).alias("bad"), F.min("create_time").alias("a"), F.max("create_time").alias("b"),
        F.count_distinct(F.coalesce("msg_id", F.lit(""))).alias("ids"), F.sort_array(F.collect_list(length)).alias("lengths"),
    ).collect()
    assert set(found) == {(r.year, r.month, r.day) for r in days}
    for r in days:
        got = found[r.year, r.month, r.day]
        assert (got.row_count, got.nulls, got.violations, got.first_time, got.last_time) == (r.n, r.nulls, r.bad, r.a, r.b)
        assert got.distinct_ids == pytest.approx(r.ids, rel=0.03)
        for q, value in zip((0.5, 0.9), got.length_quantiles, strict=True):
            low, high = (r.lengths[min(len(r.lengths) - 1, max(0, int(len(r.lengths) * (q + s))))] for s in (-0.03, 0.03))
            assert low <= value <= high


def test_facts_follow_the_files(spark, tmp_path) -> None:
    """Two loads, an update without news, a compacted day: only new files are read, and files that went do not count."""
    root, state = str(tmp_path / "lake"), str(tmp_path / "state")
    bad = F.col("msg_type") == 2
    lake.write_days(_rows(spark, 0, 2000), root)
    assert day_facts.day_facts(spark, root, state) is None
    day_facts.update_facts(spark, root, state, REQUIRED, bad)
    _check(spark, root, state)

    before = {r.file_path for r in spark.read.parquet(f"{state}/facts").collect()}
    lake.write_days(_rows(spark, 2000, 2300), root)
    new = {r.file_path for r in day_facts.unread_files(spark, root, state).collect()}
    assert new and not new & before
    day_facts.update_facts(spark, root, state, REQUIRED, bad)
    read = {r.file_path for r in spark.read.parquet(f"{state}/facts").where("batch_id = 1").collect()}
    assert read == new
    _check(spark, root, state)

    day_facts.update_facts(spark, root, state, REQUIRED, bad)
    assert {r.batch_id for r in spark.read.parquet(f"{state}/facts").select("batch_id").distinct().collect()} == {0, 1}
    day = lake.read_lake(spark, root).where("day = 6").drop("year", "month", "day").dropDuplicates()
    held = spark.createDataFrame(day.collect(), day.schema)
    lake.write_days(held, root, "overwrite")
    day_facts.update_facts(spark, root, state, REQUIRED, bad)
    _check(spark, root, state)
    metrics = day_facts.kept_quality(day_facts.day_facts(spark, root, state), 2).collect()
    assert {m.metric_name for m in metrics} == {"null_rate", "duplicate_rate", "schema_violations"} and len(metrics) == 9
