"""Drift of fields that no schema names."""

from __future__ import annotations

import datetime as dt

from chatlake.operators import schema_evolution as evolution


def test_extra_drift_and_registry(spark, tmp_path) -> None:
    """New, changed and known fields over two days; null, empty and broken rows; nested types merge."""
    path = str(tmp_path / "registry")
    rows = [
        (2024, 1, 5, '{"a": 1}'), (2024, 1, 5, '{"a": null, "b": {"x": 1}}'), (2024, 1, 5, None), (2024, 1, 5, "{}"),
        (2024, 1, 6, '{"b": {"y": "s"}, "c": [1]}'), (2024, 1, 6, '{"b": {"x": 2}, "n": null}'), (2024, 1, 6, "no json"),
    ]
    table = spark.createDataFrame(rows, "year int, month int, day int, extra string")
    found = evolution.extra_fields(table)
    assert {(r.day, r.name): (r.type, r.row_count) for r in found.collect()} == {
        (5, "a"): ("BIGINT", 2), (5, "b"): ("OBJECT<x: BIGINT>", 1),
        (6, "b"): ("OBJECT<x: BIGINT, y: STRING>", 2), (6, "c"): ("ARRAY<BIGINT>", 1), (6, "n"): ("VOID", 1),
    }
    first = found.where("day = 5")
    assert evolution.register_extra(spark, path, "extra", first)
    assert not evolution.register_extra(spark, path, "extra", first)
    drift = evolution.extra_drift(found.where("day = 6"), spark.read.parquet(path), "extra").collect()
    assert {r.name: (r.status, r.since, r.row_count) for r in drift} == {
        "b": ("changed", dt.date(2024, 1, 6), 2), "c": ("added", dt.date(2024, 1, 6), 1), "n": ("added", dt.date(2024, 1, 6), 1),
    }
    assert evolution.register_extra(spark, path, "extra", found.where("day = 6"))
    last = evolution.latest_versions(spark.read.parquet(path)).first()
    assert last.version == 2
    assert {f.name: f.type for f in last.fields} == {
        "a": "BIGINT", "b": "OBJECT<x: BIGINT, y: STRING>", "c": "ARRAY<BIGINT>", "n": "VOID",
    }
    assert evolution.extra_fields(table.limit(0)).count() == 0
    assert not evolution.register_extra(spark, path, "extra", found.limit(0))
