"""Line numbers, cleaning, landing, compaction, archive, retention and registry."""

from __future__ import annotations

import os
import time
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake import schemas, session
from chatlake.operators import cleaning, dedup, images, partitions, quality, retention, selection, state
from chatlake.operators import schema_evolution as evolution
from chatlake.sources import files, jsonl, lake
from chatlake.streaming import activity, ingest


def _line(number: int, day: int = 1, **extra) -> str:
    import json

    data = {
        "msg_id": f"m{number}", "from_username": "u", "to_username": "s", "msg_type": 1,
        "create_time": 1704067200 + 86400 * (day - 1) + number, "is_chatroom_msg": 0, "source": 3, "content": f"c{number}", **extra,
    }
    return json.dumps({"guid": "g", "notify_type": 1010, "data": data})


def _write(path, lines: list[str]) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def _shuffle_files(spark) -> set[str]:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_freed(spark) -> None:
    before = _shuffle_files(spark)
    setting = spark.conf.get(session.FREE_SHUFFLES, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids"))
    table = session.cut_lineage(rows.join(rows.select("k"), "k").repartition(3, "k"))
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(session.FREE_SHUFFLES, None) == setting
    assert table.count() == rows.count() == 7
    assert sorted(x for row in table.collect() for x in row["ids"]) == list(range(1000))


def test_line_numbers_over_many_splits(spark, tmp_path) -> None:
    lines = [f"{i}" if i % 7 else "" for i in range(1, 2001)]
    path = _write(tmp_path / "big.jsonl", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = jsonl.number_lines(jsonl.read_lines(spark, path))
        assert rows.select("block").distinct().count() > 5
        found = {r.line_no: r.value for r in rows.collect()}
        kept = jsonl.read_from_line(spark, path, 1990)
        assert sorted(r.line_no for r in kept.collect()) == [i for i in range(1991, 2001) if i % 7]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {i: line for i, line in enumerate(lines, start=1)}


def test_strict_read_fails(spark, tmp_path) -> None:
    path = _write(tmp_path / "bad.jsonl", ['{"a":1}', "{bad"])
    assert jsonl.read_from_line(spark, path).count() == 1
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        jsonl.read_from_line(spark, path, strict=True).collect()


def test_payload_rules(spark) -> None:
    rows = [
        (1, '{"msg_id":"top","data":{"msg_id":"inner"}}'),
        (2, '{"guid":"outer","data":{"msg_id":"i","guid":null,"source":5,"desc":{"a":[1]}}}'),
        (3, '{"data":"text","notify_type":7}'),
        (4, "[1]"),
        (5, '{"data":{"msg_id":"a","msg_id":"b","more":{"x":1}}}'),
    ]
    df = spark.createDataFrame(rows, "n int, value string")
    found = {r.n: r for r in cleaning.keep_unknown(cleaning.extract_payload(cleaning.valid_lines(df))).collect()}
    assert found[1].msg_id == "top"
    assert (found[2].guid, found[2].source, found[2].desc) == (None, "5", '{"a":[1]}')
    assert "guid" in found[2].present
    assert (found[3].msg_id, found[3].notify_type) == (None, "7")
    assert found[4].present == []
    assert (found[5].msg_id, found[5].extra) == ("b", '{"more":{"x":1}}')


def test_request_forms(spark) -> None:
    rows = [
        ("application/x-www-form-urlencoded", b"a=1&a=2&b=&c&d=x+y%21&e=%zz"),
        ("application/json", b"\xff{"), (None, b'  {"k":1}'), ("text/plain", b"[oops"),
    ]
    df = spark.createDataFrame(rows, "content_type string, body binary")
    found = jsonl.parse_requests(df).collect()
    assert found[0].parsed_form == {"a": "1", "d": "x y!", "e": "%zz"}
    assert found[1].parse_error == "JSON decode error" and "�" in found[1].body_text
    assert found[2].parsed_json.strip() == '{"k":1}'
    assert found[3].parsed_json is None and found[3].parse_error is None


def test_complete_rows_only(spark) -> None:
    import json

    flat = json.loads(_line(1))["data"] | {"guid": "g", "notify_type": 1010}
    rows = [
        json.dumps(flat), json.dumps(flat | {"msg_id": "null type", "msg_type": None}),
        json.dumps({k: v for k, v in flat.items() if k != "source"}),
        json.dumps(flat | {"msg_id": "bad time", "create_time": "soon"}),
        json.dumps(flat | {"msg_id": "late", "create_time": 10**13}),
    ]
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    found = cleaning.complete_messages(cleaning.valid_lines(lines)).collect()
    assert {(r.msg_id, r.msg_type, r.source) for r in found} == {("m1", 1, "3"), ("null type", None, "3")}
    defaulted = cleaning.messages_from_lines(lines).collect()
    assert sorted((r.msg_id, r.msg_type, r.source) for r in defaulted) == [
        ("m1", 1, ""), ("m1", 1, "3"), ("null type", 0, "3"),
    ]
    reasons = [r.error_type for r in cleaning.quarantine(lines).collect()]
    assert sorted(reasons) == ["schema_error", "validation_error", "validation_error", "validation_error"]


def test_overwrite_replaces_only_touched_days(spark, tmp_path) -> None:
    root = str(tmp_path / "lake")
    first = spark.createDataFrame([(_line(1, 1),), (_line(2, 2),)], "value string")
    lake.convert_lines(first, root)
    lake.convert_lines(spark.createDataFrame([(_line(9, 2),)], "value string"), root)
    assert {r.msg_id for r in lake.read_lake(spark, root).collect()} == {"m1", "m9"}
    assert os.path.isdir(f"{root}/year=2024/month=01/day=02")


def test_range_query_prunes_folders(spark, tmp_path) -> None:
    root = str(tmp_path / "lake")
    lake.convert_lines(spark.createDataFrame([(_line(i, i),) for i in range(1, 29)], "value string"), root)
    rows = selection.query_messages(lake.read_lake(spark, root), "2024-01-05", "2024-01-06", columns=["msg_id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "make_date" in plan
    assert "PushedFilters: [IsNotNull(create_time)" in plan
    assert {r.msg_id for r in rows.collect()} == {"m5", "m6"}
    assert len(rows.inputFiles()) >= 1
    with pytest.raises(ValueError):
        selection.query_messages(lake.read_lake(spark, root), "2024-13-01", "2024-01-06")


def test_compact_in_place(spark, tmp_path) -> None:
    root = str(tmp_path / "lake")
    rows = spark.createDataFrame([(_line(i % 5, 1 + i % 2),) for i in range(40)], "value string")
    messages = cleaning.messages_from_lines(rows)
    lake.append_messages(messages, root)
    lake.append_messages(messages, root)
    result = dedup.compact_lake(spark, root).first()
    assert (result.rows_before, result.rows_after) == (80, 10)
    per_day = partitions.scan_partitions(lake.read_lake(spark, root)).collect()
    assert [(r.file_count, r.row_count) for r in per_day] == [(1, 5), (1, 5)]


def test_archive_and_retention(spark, tmp_path) -> None:
    root, cold = str(tmp_path / "lake"), str(tmp_path / "cold")
    lake.convert_lines(spark.createDataFrame([(_line(i, i),) for i in range(1, 11)], "value string"), root)
    done = retention.archive_days(spark, root, cold, date(2024, 1, 20), 15)
    assert sorted(r.day for r in done.collect()) == [1, 2, 3, 4]
    codecs = {r.codec for r in files.footers(spark, cold).collect()}
    assert codecs == {"ZSTD"}
    raw = tmp_path / "raw"
    for name in ("2024-01-01", "2024-01-02", "2024-01-19", "notes", "2023-12-01"):
        _write(raw / f"{name}.jsonl", ["{}"])
    landed = lake.read_lake(spark, root).select(F.concat_ws("-", "year", "month", "day").alias("day_key"))
    plan = retention.retention_plan(retention.raw_day_files(spark, str(raw)), landed, date(2024, 1, 20))
    assert {r.stem: r.decision for r in plan.collect()} == {
        "2024-01-01": "delete", "2024-01-02": "delete", "2024-01-19": "keep", "notes": "invalid_name", "2023-12-01": "no_parquet",
    }
    assert all(r.deleted for r in retention.delete_files(plan).collect())
    assert sorted(p.stem for p in raw.iterdir()) == ["2023-12-01", "2024-01-19", "notes"]


def test_broken_files_are_findings(spark, tmp_path) -> None:
    root = tmp_path / "lake"
    lake.convert_lines(spark.createDataFrame([(_line(1, 1),)], "value string"), str(root))
    day = root / "year=2024" / "month=01" / "day=01"
    (day / "junk.parquet").write_bytes(b"not parquet")
    (day / "empty.parquet").write_bytes(b"")
    spark.range(3).write.parquet(str(day / "other"))
    found = files.footers(spark, str(root)).cache()
    row = quality.validate_partitions(found).filter("day = 1").first()
    assert not row.is_valid
    assert row.errors == ["1 empty files", "1 unreadable files", "files differ in schema"]
    reasons = {os.path.basename(r.file_path): r.reasons for r in quality.file_validity(found).collect()}
    assert reasons["junk.parquet"] == ["unreadable"] and reasons["empty.parquet"] == ["empty file"]


def test_registry_keeps_types(spark, tmp_path) -> None:
    path = str(tmp_path / "registry")
    assert evolution.register_schema(spark, path, "messages", schemas.MESSAGES, "first") == 1
    wider = T.StructType([*schemas.MESSAGES.fields, T.StructField("tags", T.ArrayType(T.DecimalType(9, 2)))])
    assert evolution.register_schema(spark, path, "messages", wider) == 2
    assert evolution.register_schema(spark, path, "contacts", schemas.CONTACTS) == 1
    registry = spark.read.parquet(path)
    assert evolution.registered_struct(registry, "messages") == wider
    assert evolution.registered_struct(registry, "messages", 1) == schemas.MESSAGES
    assert evolution.registered_struct(registry, "absent") is None
    verdict = evolution.check_compatibility(
        evolution.fields_of(spark, schemas.MESSAGES), evolution.fields_of(spark, wider)
    ).first()
    assert (verdict.compatibility_type, verdict.added_fields, verdict.is_compatible) == ("backward", "tags", True)


def test_stream_equals_batch_and_repeats_nothing(spark, tmp_path) -> None:
    raw, root, mark = tmp_path / "raw", str(tmp_path / "lake"), str(tmp_path / "mark")
    _write(raw / "2024-01-01.jsonl", [_line(1), "", "{bad", _line(2), _line(1, content="again")])
    totals = ingest.run_to_end(ingest.ingest_stream(spark, str(raw), root, mark))
    assert totals["lines"] == 5
    _write(raw / "2024-01-02.jsonl", [_line(2), _line(3, 2)])
    ingest.run_to_end(ingest.ingest_stream(spark, str(raw), root, mark))
    rows = {r.msg_id: r.content for r in lake.read_lake(spark, root).collect()}
    assert rows == {"m1": "c1", "m2": "c2", "m3": "c3"}
    repeat = ingest.ingest_batch(
        spark, spark.createDataFrame([(_line(3, 2), "f"), (_line(4, 2), "f")], "value string, source_file string"), root
    )
    assert repeat == {
        "total_lines": 2, "blank_lines": 0, "quarantined": 0, "total_processed": 2, "new_records": 1, "duplicates_skipped": 1
    }


def test_resume_counts_physical_lines(spark, tmp_path) -> None:
    path = _write(tmp_path / "day.jsonl", [_line(1), "", "{bad", _line(2)])
    log = ingest.checkpoint_rows(ingest.resume_lines(spark, path, None).filter("line_no <= 3"))
    rest = ingest.resume_lines(spark, path, log)
    assert [r.line_no for r in rest.collect()] == [4]


def test_activity_window(spark) -> None:
    df = spark.createDataFrame([("a", 10), ("a", 3599), ("a", 3600)], "chatroom string, s long")
    rows = activity.activity(df.withColumn("create_time", F.timestamp_seconds("s"))).collect()
    assert sorted((r.messages, r.window_start.hour) for r in rows) == [(1, 1), (2, 0)]


def test_image_events_fold(spark) -> None:
    made = spark.createDataFrame([("i", "m", "u")], "image_id string, msg_id string, from_username string")
    steps = [
        images.creation_events(made),
        images.status_events(made, F.lit("completed"), download_url=F.lit("http://x")),
        images.ocr_events(made, F.lit(True), F.lit("words")),
        images.ocr_error_events(made, F.lit("late error")),
    ]
    log = None
    for number, events in enumerate(steps):
        step = events.withColumn("event_no", F.lit(number).cast("long"))
        log = step if log is None else log.unionByName(step)
        current = images.current_images(log).first()
        if number == 0:
            assert (current.status, current.download_url, current.downloaded_at) == ("pending", None, None)
    assert (current.status, current.download_url, current.has_text, current.ocr_content) == ("completed", "http://x", True, "words")
    assert current.error_message == "late error" and current.downloaded_at is not None
    failed = images.status_events(made, F.lit("failed"), error_message=F.lit("e")).withColumn("event_no", F.lit(9).cast("long"))
    after = images.current_images(log.unionByName(failed)).first()
    assert (after.status, after.download_url, after.error_message, after.downloaded_at) == ("failed", None, "e", None)


def test_one_day_deduplicated(spark, tmp_path) -> None:
    root = str(tmp_path / "lake")
    messages = cleaning.messages_from_lines(
        spark.createDataFrame([(_line(i % 3, 1 + i % 2),) for i in range(12)], "value string")
    )
    lake.append_messages(messages, root)
    other = dedup.deduplicate_day(spark, root, 2024, 1, 1, in_place=False)
    assert lake.read_lake(spark, other).count() == 3
    assert lake.read_lake(spark, root).count() == 12
    dedup.deduplicate_day(spark, root, 2024, 1, 2)
    counts = {r.day: r.row_count for r in partitions.day_counts(lake.read_lake(spark, root)).collect()}
    assert counts == {1: 6, 2: 3}


def test_delete_archived_days(spark, tmp_path) -> None:
    root, cold = str(tmp_path / "lake"), str(tmp_path / "cold")
    lake.convert_lines(spark.createDataFrame([(_line(i, i),) for i in range(1, 6)], "value string"), root)
    done = retention.archive_days(spark, root, cold, date(2024, 1, 20), 17)
    assert all(r.deleted for r in retention.delete_days(spark, root, done).collect())
    assert sorted(r.day for r in lake.read_lake(spark, root).collect()) == [3, 4, 5]
    assert sorted(r.day for r in lake.read_lake(spark, cold).collect()) == [1, 2]


def test_checksums_match(spark, tmp_path) -> None:
    import hashlib
    import zlib

    (tmp_path / "a.bin").write_bytes(b"some bytes" * 100)
    row = files.checksums(spark, str(tmp_path), "*.bin").first()
    content = b"some bytes" * 100
    assert (row.md5, row.crc32, row.file_size) == (hashlib.md5(content).hexdigest(), zlib.crc32(content), 1000)


def test_given_objects(spark, tmp_path) -> None:
    root, raw, mark = str(tmp_path / "lake"), str(tmp_path / "raw"), str(tmp_path / "mark")
    given = spark.createDataFrame([(_line(1),), ("[1]",), ("{bad",), ("5",)], "value string")
    assert ingest.ingest_objects(spark, given, root)["refused"] == 3
    more = spark.createDataFrame([(_line(2),)], "value string")
    assert ingest.ingest_objects(spark, more, root, raw, mark)["lines"] == 1
    assert {r.msg_id for r in lake.read_lake(spark, root).collect()} == {"m1", "m2"}


def test_extraction_runs_once_per_file(spark, tmp_path) -> None:
    root, log, marks = (str(tmp_path / name) for name in ("lake", "images", "marks"))
    picture = '<msg><img aeskey="k" cdnmidimgurl="u" encryver="1"/></msg>'
    rows = [_line(1, 1, content=picture), _line(2, 1), _line(3, 2, content=picture)]
    lake.convert_lines(spark.createDataFrame([(r,) for r in rows], "value string"), root)
    assert images.extract_all(spark, root, log, marks, "u", dry_run=True).first().images_extracted == 2
    assert images.extract_all(spark, root, log, marks, "u").first().images_extracted == 2
    stored = {r.msg_id: r.content for r in lake.read_lake(spark, root).collect()}
    ids = {r.msg_id: r.image_id for r in images.current_images(spark.read.parquet(log)).collect()}
    assert stored == {"m1": f"image#{ids['m1']}", "m2": "c2", "m3": f"image#{ids['m3']}"}
    again = images.extract_all(spark, root, log, marks, "u").first()
    assert (again.files_scanned, again.images_extracted) == (0, 0)
    lake.append_messages(
        cleaning.messages_from_lines(spark.createDataFrame([(_line(4, 2, content=picture),)], "value string")), root
    )
    assert images.extract_all(spark, root, log, marks, "u").first().images_extracted == 1


def test_damage_inside_a_file_leaves_it_open(spark, tmp_path) -> None:
    """Its footer can be read, its pages cannot; a day between two others that are rewritten."""
    import pyarrow.parquet as pq

    picture = '<msg><img aeskey="k" cdnmidimgurl="u" encryver="1"/></msg>'
    for update in (False, True):
        root, log, marks = str(tmp_path / f"lake{update}"), str(tmp_path / f"log{update}"), str(tmp_path / f"marks{update}")
        rows = [_line(i, i, content=picture) for i in (1, 2, 3)]
        lake.convert_lines(spark.createDataFrame([(r,) for r in rows], "value string"), root)
        path = next(p for p in (tmp_path / f"lake{update}").rglob("*.parquet") if "day=2/" in str(p) or "day=02/" in str(p))
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
        whole, group = path.read_bytes(), pq.ParquetFile(path).metadata.row_group(0)
        chunks = [group.column(i) for i in range(group.num_columns)]
        at = next(c for c in chunks if c.path_in_schema == "content")
        start = at.dictionary_page_offset or at.data_page_offset
        path.write_bytes(whole[:start] + b"\xff" * at.total_compressed_size + whole[start + at.total_compressed_size :])
        run = images.extract_all(spark, root, log, marks, "u", update_content=update).first()
        assert (run.files_scanned, run.images_extracted, run.files_failed) == (2, 2, 1)
        failed = spark.read.parquet(marks).filter("status = 'failed'").collect()
        assert [r.error_message for r in failed] == ["read 0 of 1 rows"] and path.name in failed[0].parquet_file
        path.write_bytes(whole)
        again = images.extract_all(spark, root, log, marks, "u", update_content=update).first()
        assert (again.files_scanned, again.images_extracted, again.files_failed) == (1, 1, 0)
        assert images.current_images(spark.read.parquet(log)).count() == 3


def test_pages_are_grouped_into_tasks(spark, tmp_path) -> None:
    from chatlake.sources import recorded

    for number in range(7):
        (tmp_path / f"p{number}.json").write_text(f'[{{"n": {number}}}, {{"n": -1}}]')
    recorded.register(spark)
    pages = spark.read.format("recorded_pages").option("pages_per_task", "3").load(str(tmp_path))
    assert pages.rdd.getNumPartitions() == 3
    assert sorted(r.page for r in pages.filter("record_no = 0").collect()) == [f"p{n}.json" for n in range(7)]


def _totals(spark, raw, root, mark, **options) -> dict[str, int]:
    return ingest.run_to_end(ingest.ingest_stream(spark, str(raw), root, mark, **options))


def test_every_line_is_accounted_for(spark, tmp_path) -> None:
    """More batches than the progress of a query remembers, and refused lines of every kind."""
    raw, root, mark = tmp_path / "raw", str(tmp_path / "lake"), str(tmp_path / "mark")
    long = "{bad " + "x" * 2000
    for i in range(6):
        _write(raw / f"f{i}.jsonl", [_line(i), _line(0), "", long, '{"content": "no id"}', _line(9, msg_type="x")])
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    totals = _totals(spark, raw, root, mark, files_per_trigger=1)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100")
    assert (totals["batches"], totals["lines"], totals["blank_lines"], totals["quarantined"]) == (6, 36, 6, 18)
    assert (totals["total_processed"], totals["new_records"], totals["duplicates_skipped"]) == (12, 6, 6)
    letters = spark.read.parquet(f"{mark}-dead-letters")
    assert {r.error_type: r["count"] for r in letters.groupBy("error_type").count().collect()} == {
        "parse_error": 6, "schema_error": 6, "validation_error": 6
    }
    assert letters.filter("error_type = 'parse_error'").select("line").distinct().first().line == long
    assert _totals(spark, raw, root, mark)["lines"] == 0


def test_any_cut_gives_one_table(spark, tmp_path) -> None:
    lines = [_line(1, 1), _line(1, 2), _line(2, 1), _line(1, 1, content="again"), _line(2, 1)]
    found = []
    for cut in ([5], [1, 4], [1, 1, 1, 1, 1], [3, 2]):
        root, at = str(tmp_path / f"lake{'-'.join(map(str, cut))}"), 0
        for size in cut:
            rows = [(line, f"f{at + i}") for i, line in enumerate(lines[at : at + size])]
            ingest.ingest_batch(spark, spark.createDataFrame(rows, "value string, source_file string"), root)
            at += size
        found.append(sorted((r.msg_id, r.day, r.content) for r in lake.read_lake(spark, root).collect()))
    assert all(rows == found[0] for rows in found) and len(found[0]) == 3


def test_a_repeated_batch_adds_nothing_without_dedup(spark, tmp_path) -> None:
    root = str(tmp_path / "lake")
    rows = spark.createDataFrame([(_line(1), "f"), (_line(1), "f"), (_line(2), "f")], "value string, source_file string")
    assert ingest.ingest_batch(spark, rows, root, deduplicate=False)["new_records"] == 3
    assert ingest.ingest_batch(spark, rows, root, deduplicate=False, repeated=True)["new_records"] == 0
    assert lake.read_lake(spark, root).count() == 3


def test_checkpoints_are_written(spark, tmp_path, monkeypatch) -> None:
    raw, root, log = tmp_path / "raw", str(tmp_path / "lake"), str(tmp_path / "log")
    path = _write(raw / "a.jsonl", [_line(1), "", "{bad", _line(2)])
    assert ingest.ingest_from_checkpoints(spark, str(raw), root, log)["new_records"] == 2
    current = state.latest(spark.read.parquet(log), ["source_file"], ["log_no"]).first()
    assert (current.status, current.last_processed_line, current.last_processed_msg_id) == ("completed", 4, "m2")
    with open(path.replace("file://", ""), "a") as more:
        more.write(_line(3) + "\n")
    spark.catalog.clearCache()
    whole = ingest.ingest_batch
    monkeypatch.setattr(ingest, "ingest_batch", lambda *_, **__: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        ingest.ingest_from_checkpoints(spark, str(raw), root, log)
    current = state.latest(spark.read.parquet(log), ["source_file"], ["log_no"]).first()
    assert (current.status, current.last_processed_line) == ("failed", 4)
    monkeypatch.setattr(ingest, "ingest_batch", whole)
    assert ingest.ingest_from_checkpoints(spark, str(raw), root, log)["total_lines"] == 1
    assert {r.msg_id for r in lake.read_lake(spark, root).collect()} == {"m1", "m2", "m3"}


def test_late_rows_join_the_archive(spark, tmp_path) -> None:
    root, cold = str(tmp_path / "lake"), str(tmp_path / "cold")
    first = [_line(i, 1) for i in range(5)]
    lake.convert_lines(spark.createDataFrame([(x,) for x in first], "value string"), root)
    done = retention.archive_days(spark, root, cold, date(2024, 2, 20), 15)
    assert [r.rows for r in done.collect()] == [5]
    report = retention.archive_report(spark, root, cold, done).first()
    assert report.bytes_before > 0 and report.bytes_after > 0 and report.ratio == report.bytes_before / report.bytes_after
    # once more without deleting: nothing is doubled
    retention.archive_days(spark, root, cold, date(2024, 2, 20), 15)
    assert lake.read_lake(spark, cold).count() == 5
    assert all(r.deleted for r in retention.delete_days(spark, root, done).collect())
    late = spark.createDataFrame([(_line(77, 1),)], "value string")
    lake.convert_lines(late, root, "append")
    assert [r.rows for r in retention.archive_days(spark, root, cold, date(2024, 2, 20), 15).collect()] == [1]
    assert {r.msg_id for r in lake.read_lake(spark, cold).collect()} == {f"m{i}" for i in (0, 1, 2, 3, 4, 77)}


def test_own_landing_files_are_found(spark, tmp_path) -> None:
    from chatlake.sources import jsonl

    raw = str(tmp_path / "raw")
    rows = spark.createDataFrame([("m1", "2024-01-01"), ("m2", "2024-01-19")], "msg_id string, d string")
    jsonl.append_daily(rows, raw, F.to_timestamp("d"))
    landed = spark.createDataFrame([("2024-01-01",)], "day_key string")
    plan = retention.retention_plan(retention.raw_day_files(spark, raw), landed, date(2024, 1, 20))
    assert {r.stem: r.decision for r in plan.collect()} == {"2024-01-01": "delete", "2024-01-19": "keep"}
    assert retention.delete_files(plan).count() == 1
    assert [r.stem for r in retention.raw_day_files(spark, raw).collect()] == ["2024-01-19"]


def test_cuts_are_filled_side_by_side(spark, tmp_path, monkeypatch) -> None:
    """The first batches of all three tables are under way at once, and each table's batches follow each other."""
    import threading

    from chatlake.catalog import flows
    from chatlake.sources.adapters import Tables

    spark.range(60).selectExpr("id as event_id", "id % 7 as user_id").write.parquet(f"{tmp_path}/events.parquet")
    met, land, roots, busy = threading.Barrier(3), ingest.ingest_batch, [], set()

    def landed(session, lines, root):
        if root not in roots:
            met.wait(60)
        assert root not in busy
        busy.add(root)
        roots.append(root)
        counts = land(session, lines, root)
        busy.remove(root)
        return counts

    monkeypatch.setattr(ingest, "ingest_batch", landed)
    found = {tuple(row) for row in flows.any_batch_cut(Tables(spark, str(tmp_path))).collect()}
    assert found == {(cut, 55, 55) for cut in (1, 3, 7)}
    assert sorted(roots.count(root) for root in set(roots)) == [1, 3, 7]


def test_stored_ids_are_read_in_few_tasks(spark, tmp_path, monkeypatch) -> None:
    """Small files of many days share tasks when a batch is compared with them; where files or bytes are many, so are tasks."""
    root, days = str(tmp_path / "lake"), 24
    lines = [(_line(day, day + 1), "f") for day in range(days)]
    ingest.ingest_batch(spark, spark.createDataFrame(lines, "value string, source_file string"), root)
    batch = ingest.judged(spark.createDataFrame([*lines[::2], (_line(99, 3), "f")], "value string, source_file string"))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # as much as a file is reckoned to cost: a task for each
    try:
        stored = lake.read_lake(spark, root)
        ids = stored.select("msg_id")
        tasks = ids.rdd.getNumPartitions()
        assert tasks >= days
        cores = 2 * spark.sparkContext.defaultParallelism
        assert lake.in_larger_tasks(ids, stored).rdd.getNumPartitions() == cores
        fresh = ingest.unseen(batch, stored, ingest.days_of(batch))
        assert "Coalesce" in fresh._jdf.queryExecution().executedPlan().toString()
        assert [r.msg_id for r in fresh.collect()] == ["m99"]
        monkeypatch.setattr(lake, "FILES_PER_TASK", 2)
        assert lake.in_larger_tasks(ids, stored).rdd.getNumPartitions() == days // 2 + 1
        monkeypatch.setattr(lake, "FILES_PER_TASK", 1)
        monkeypatch.setattr(lake, "BYTES_PER_TASK", 1)
        found = lake.in_larger_tasks(ids, stored)
        assert found.rdd.getNumPartitions() == tasks and found.count() == days
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_the_id_filter_fits_a_small_file(spark, tmp_path) -> None:
    rows = spark.range(200).selectExpr("concat('m', id) as msg_id", "timestamp'2024-01-01 00:00:00' as create_time")
    lake.write_days(rows, str(tmp_path / "lake"))
    (file,) = tmp_path.rglob("*.parquet")
    assert file.stat().st_size < 16_000
    lake.write_days(rows, str(tmp_path / "plain"), id_filter=False)
    (plain,) = (tmp_path / "plain").rglob("*.parquet")
    assert file.stat().st_size > plain.stat().st_size + 200


def test_lines_are_judged_without_a_map_of_their_members(spark) -> None:
    """The fields of a judged line are those of its opened envelope, also where names come twice, are null or nested."""
    odd = [
        None, "", "  ", "{bad", "[1]", "5", "null", '"x"', '{"a":1}', '{"data":[1],"msg_id":"q","create_time":1e3,"msg_type":1.5}',
        '{"msg_id":null,"data":{"msg_id":"m1","create_time":5}}', '{"msg_id":{"a":1},"data":{"msg_id":"in"},"create_time":-5}',
        '{"guid":"g","notify_type":3,"data":{"msg_id":"m1","create_time":5,"guid":null}}', '{"guid":null,"data":{"msg_id":"x"}}',
        '{"guid":"g","notify_type":3.0,"data":{"msg_id":7,"create_time":"5","notify_type":{"a":[1,2.50]},"content":[1,{"b":null}],"source":true}}',
        '{"data":null,"guid":"g","create_time":1.0}', '{"data":{"data":{"msg_id":"z"}},"guid":"g"}', '{"data":{"MSG_ID":"up"}}',
        '{"data":{"msg_id":"a","msg_id":"b","create_time":12345678901234567890},"guid":"g","guid":"h"}', '{"data":{},"msg_id":"x","create_time":"9"}',
        '{"data":{"msg_id":"","create_time":"","from_username":null,"desc":"d","ingestion_time":"2024-01-01T00:00:00Z"},"notify_type":false}',
    ]
    lines = spark.createDataFrame([*enumerate(odd)], "n int, value string")
    names = ["n", "line_kind", *schemas.RAW_MESSAGE.names]
    wanted = cleaning.extract_payload(cleaning.parse_lines(lines)).select(*names).orderBy("n").collect()
    assert cleaning.payload_fields(cleaning.parse_lines(lines)).select(*names).orderBy("n").collect() == wanted
    plan = cleaning.judge_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert "MapType" not in plan and "map_keys" not in plan
    missing = {r.n: r.missing_fields for r in cleaning.judge_lines(lines).filter("error_type = 'schema_error'").collect()}
    assert (missing[8], missing[13], missing[20]) == ("msg_id,create_time", "create_time", "msg_id,create_time")
