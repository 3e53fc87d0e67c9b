"""Deduplication, partition facts, quality, retention, schemas and checkpoints."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.catalog.reading import _CLEAN_LINES, _REQUIRED
from chatlake.catalog.registry import message_lake, query
from chatlake.operators import cleaning, day_facts, dedup, partitions, quality, retention, state
from chatlake.operators import schema_evolution as evolution
from chatlake.session import scratch_path
from chatlake.sources import files, jsonl, lake
from chatlake.sources.adapters import Tables

AS_OF = date(2024, 3, 1)
MID_MONTH = date(2024, 1, 25)

_DAY = "cast(year(create_time) as int) as year, cast(month(create_time) as int) as month, cast(day(create_time) as int) as day"


def _lake(t: Tables, source: str = "fx_messages") -> DataFrame:
    return lake.read_lake(t.spark, message_lake(t, source))


@query("A01_rows_per_day", f"select {_DAY}, count(*) as row_count from fx_messages group by all")
def rows_per_day(t: Tables) -> DataFrame:
    return partitions.day_counts(cleaning.with_day(t.fx_messages))


@query("A02_duplicates", "select msg_id, count(*) as count from fx_duplicates group by 1 having count(*) > 1")
def duplicates(t: Tables) -> DataFrame:
    return dedup.duplicates(_lake(t, "fx_duplicates"))


@query(
    "A03_duplicate_summary",
    "select count(*) as duplicate_ids, cast(sum(n) - count(*) as bigint) as surplus_rows from "
    "(select msg_id, count(*) as n from fx_duplicates group by 1 having count(*) > 1)",
)
def duplicate_summary(t: Tables) -> DataFrame:
    return dedup.duplicate_summary(dedup.duplicates(_lake(t, "fx_duplicates")))


@query(
    "A04_keep_first",
    "select msg_id, copy, content from fx_duplicates qualify row_number() over (partition by msg_id order by copy) = 1",
)
def keep_first(t: Tables) -> DataFrame:
    return dedup.deduplicate(t.fx_duplicates, ["copy"]).select("msg_id", "copy", "content")


@query(
    "A04_keep_first_other_key",
    "select from_username, msg_id from fx_duplicates "
    "qualify row_number() over (partition by from_username order by create_time, msg_id, copy) = 1",
)
def keep_first_other_key(t: Tables) -> DataFrame:
    kept = dedup.deduplicate(t.fx_duplicates, ["create_time", "msg_id", "copy"], ["from_username"])
    return kept.select("from_username", "msg_id")


@query(
    "A05_dedup_one_day",
    "select distinct msg_id, content from fx_duplicates "
    "where create_time >= timestamp '2024-01-05' and create_time < timestamp '2024-01-06'",
)
def dedup_one_day(t: Tables) -> DataFrame:
    day = dedup.with_file_order(_lake(t, "fx_duplicates")).filter("year = 2024 and month = 1 and day = 5")
    return dedup.deduplicate(day, dedup.FILE_ORDER).select("msg_id", "content")


@query(
    "A06_dedup_per_day",
    f"select {_DAY}, count(distinct msg_id) as row_count from fx_duplicates group by all",
)
def dedup_per_day(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "compacted")
    dedup.compact_lake(t.spark, message_lake(t, "fx_duplicates"), out)
    return partitions.day_counts(lake.read_lake(t.spark, out))


_SCANNED = (
    f"select {_DAY}, count(*) as row_count, cast(epoch(min(create_time)) as bigint) as first_epoch, "
    "cast(epoch(max(create_time)) as bigint) as last_epoch from fx_messages group by year(create_time), month(create_time), day(create_time)"
)


@query("A08_partition_scan", _SCANNED)
def partition_scan(t: Tables) -> DataFrame:
    return _scanned(partitions.scan_partitions(_lake(t)))


@query("A08_partition_scan_by_footers", _SCANNED)
def partition_scan_by_footers(t: Tables) -> DataFrame:
    return _scanned(partitions.scan_footers(files.footers(t.spark, message_lake(t))))


def _scanned(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        *schemas.PARTITION_COLUMNS, "row_count",
        F.unix_timestamp("first_time").alias("first_epoch"),
        F.unix_timestamp("last_time").alias("last_epoch"),
    )


@query(
    "A08_partition_totals",
    "select count(distinct cast(create_time as date)) as partitions, count(*) as row_count, "
    "strftime(min(create_time), '%Y-%m-%d') as oldest, strftime(max(create_time), '%Y-%m-%d') as newest from fx_messages",
)
def partition_totals(t: Tables) -> DataFrame:
    return partitions.partition_totals(partitions.scan_partitions(_lake(t)))


@query(
    "D05_partition_metadata",
    f"select {_DAY}, 1 as file_count, count(*) as row_count, strftime(min(create_time), '%Y-%m-%d') as partition_key, "
    "cast(epoch(max(create_time)) as bigint) as last_epoch, true as sized from fx_messages group by year(create_time), month(create_time), day(create_time)",
)
def partition_metadata(t: Tables) -> DataFrame:
    rows = partitions.with_labels(partitions.scan_partitions(_lake(t)))
    return rows.select(
        *schemas.PARTITION_COLUMNS, "file_count", "row_count", "partition_key",
        F.unix_timestamp("last_time").alias("last_epoch"), (F.col("total_size") > 0).alias("sized"),
    )


@query(
    "F33_partition_labels",
    f"select {_DAY}, strftime(min(create_time), '%Y-%m-%d') as partition_key, round(count(*) / 1048576.0, 6) as size_mb "
    "from fx_messages group by year(create_time), month(create_time), day(create_time)",
)
def partition_labels(t: Tables) -> DataFrame:
    counts = partitions.day_counts(_lake(t)).withColumnRenamed("row_count", "total_size")
    return partitions.with_labels(counts).drop("total_size")


@query(
    "A09_storage_usage",
    "with d as (select count(distinct cast(create_time as date)) as n from fx_messages) select 'parquet' as tier, n as file_count, true as sized from d "
    "union all select 'archive', n, true from d union all select 'raw', n, true from d union all select 'total', 3 * n, true from d",
)
def storage_usage(t: Tables) -> DataFrame:
    raw = scratch_path(t.spark, "raw")
    by_day = t.fx_messages.repartition(F.to_date("create_time"))
    jsonl.append_daily(by_day, raw, F.col("create_time"))
    roots = {
        "parquet": (message_lake(t), "*.parquet"),
        "archive": (message_lake(t, "fx_duplicates"), "*.parquet"),
        "raw": (raw, "*.txt"),
    }
    usage = partitions.storage_usage(t.spark, roots)
    return usage.select("tier", "file_count", (F.col("total_bytes") > 0).alias("sized"))


@query(
    "A10_partition_ages",
    """
    with d as (select distinct date_diff('day', cast(create_time as date), date '2024-03-01') as age from fx_messages),
    b as (select unnest([0, 1, 2, 3, 4, 5]) as i,
          unnest(['0-7_days', '8-30_days', '31-90_days', '91-180_days', '181-365_days', 'over_365_days']) as bucket)
    select bucket, count(age) as partitions from b
    left join d on i = case when age <= 7 then 0 when age <= 30 then 1 when age <= 90 then 2 when age <= 180 then 3 when age <= 365 then 4 else 5 end
    group by 1
    """,
)
def partition_ages(t: Tables) -> DataFrame:
    return partitions.age_distribution(partitions.day_counts(_lake(t)), AS_OF)


@query(
    "A11_compression_stats",
    "select count(distinct cast(create_time as date)) as files, true as saved from fx_messages",
)
def compression_stats(t: Tables) -> DataFrame:
    rows = partitions.compression_stats(files.footers(t.spark, message_lake(t)))
    return rows.select("files", (F.col("compression_ratio") > 1.5).alias("saved"))


@query(
    "A12_error_counts",
    _CLEAN_LINES + f"""
    select error_type, count(*) as errors from (
      select 'parse_error' as error_type from fx_raw_lines where trim(value) <> '' and not json_valid(value)
      union all select 'schema_error' from m where not list_has_all(present, {_REQUIRED})
    ) group by 1
    """,
)
def error_counts(t: Tables) -> DataFrame:
    return quality.error_counts(cleaning.quarantine(t.fx_raw_lines))


@query(
    "A13_conversion_report",
    "select cast(sum(n) as bigint) as total_records, count(*) as partitions, cast(sum(ceil(n / 100.0)) as bigint) as batches "
    "from (select cast(create_time as date) as d, count(*) as n from fx_messages group by 1)",
)
def conversion_report(t: Tables) -> DataFrame:
    return partitions.conversion_report(cleaning.with_day(t.fx_messages), 100)


@query(
    "A14_message_types",
    "select concat('', msg_type) as code, case msg_type when 1 then '文本消息' when 3 then '图片消息' when 49 then '应用消息/链接' "
    "when 10000 then '系统消息' when 47 then '表情消息' end as name, count(*) as row_count from fx_messages group by 1, 2",
)
def message_types(t: Tables) -> DataFrame:
    named = quality.named_counts(t.fx_messages, "msg_type", schemas.MESSAGE_TYPES, schemas.NULL_MESSAGE_TYPE)
    return named.withColumn("code", F.col("code").cast("string"))


@query(
    "A14_message_types_with_null",
    "select coalesce(cast(code as varchar), 'null') as code, case when code is null then '空类型' when code = 49 then '应用消息/链接' "
    "when code = 3 then '图片消息' else 'unknown' end as name, count(*) as row_count from "
    "(select case when try_cast(msg_type as double) = floor(try_cast(msg_type as double)) then cast(try_cast(msg_type as double) as int) end as code from fx_loose) group by 1, 2",
)
def message_types_with_null(t: Tables) -> DataFrame:
    from chatlake.functions.clean import whole_number

    typed = t.fx_loose.select(whole_number(F.col("msg_type"), "int").alias("msg_type"))
    named = quality.named_counts(typed, "msg_type", schemas.MESSAGE_TYPES, schemas.NULL_MESSAGE_TYPE)
    return named.withColumn("code", F.coalesce(F.col("code").cast("string"), F.lit("null")))


@query(
    "A14_notify_types",
    "select notify_type as code, case notify_type when 1200 then '联系人更新' when 1201 then '联系人删除' "
    "when 1202 then '联系人详情' end as name, count(*) as row_count from fx_contacts group by 1, 2",
)
def notify_types(t: Tables) -> DataFrame:
    return quality.named_counts(t.fx_contacts, "notify_type", schemas.NOTIFY_TYPES, "")


@query(
    "J06_unprocessed_files",
    """
    with cur as (select * from fx_extraction_log qualify row_number() over (partition by parquet_file order by log_no desc) = 1)
    select distinct f.parquet_file from fx_extraction_log f
    where f.parquet_file not in (select parquet_file from cur where status = 'completed' and from_username = 'user_1')
    """,
)
def unprocessed_files(t: Tables) -> DataFrame:
    known = t.fx_extraction_log.select("parquet_file").distinct()
    return state.unprocessed(known, t.fx_extraction_log, "user_1")


@query(
    "I07_extraction_checkpoints",
    "select parquet_file, from_username, status, total_images_extracted from fx_extraction_log "
    "qualify row_number() over (partition by parquet_file order by log_no desc) = 1",
)
def extraction_checkpoints(t: Tables) -> DataFrame:
    current = state.latest(t.fx_extraction_log, ["parquet_file"], ["log_no"])
    return current.select("parquet_file", "from_username", "status", "total_images_extracted")


@query(
    "I07_completed_files",
    "select parquet_file from (select * from fx_extraction_log qualify row_number() over "
    "(partition by parquet_file order by log_no desc) = 1) where status = 'completed' and from_username = 'user_2'",
)
def completed_files(t: Tables) -> DataFrame:
    return state.completed_files(t.fx_extraction_log, "user_2")


@query(
    "J10_deletable_files",
    "select stem from fx_raw_files where try_cast(stem as date) < date '2024-01-18' "
    "and stem in (select day_key from fx_landed_days)",
)
def deletable_files(t: Tables) -> DataFrame:
    return retention.deletable(t.fx_raw_files, t.fx_landed_days, MID_MONTH)


@query(
    "M07_retention_plan",
    """
    select stem, case when try_cast(stem as date) is null then 'invalid_name' when cast(stem as date) >= date '2024-01-18' then 'keep'
           when stem in (select day_key from fx_landed_days) then 'delete' else 'no_parquet' end as decision
    from fx_raw_files
    """,
)
def retention_plan(t: Tables) -> DataFrame:
    return retention.retention_plan(t.fx_raw_files, t.fx_landed_days, MID_MONTH)


@query(
    "M06_archivable_days",
    f"select distinct {_DAY} from fx_messages where cast(create_time as date) < date '2024-02-20' - interval 40 day",
)
def archivable_days(t: Tables) -> DataFrame:
    days = partitions.day_counts(_lake(t)).drop("row_count")
    return retention.archivable_days(days, date(2024, 2, 20), 40)


@query(
    "M06_archive_days",
    f"select {_DAY}, count(*) as rows from fx_messages where create_time < timestamp '2024-01-11' group by all",
)
def archive_days(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "archive")
    return retention.archive_days(t.spark, message_lake(t), out, date(2024, 2, 20), 40)


@query(
    "M06_archive_late_rows",
    f"select {_DAY}, count(*) as rows, count(distinct msg_id) as ids from fx_messages where create_time < timestamp '2024-01-11' group by all",
)
def archive_late_rows(t: Tables) -> DataFrame:
    """Two thirds of the rows are archived, their days deleted, then the rest comes late."""
    root, cold = scratch_path(t.spark, "lake"), scratch_path(t.spark, "archive")
    rows = t.fx_messages.withColumnRenamed("descr", "desc")
    late = F.pmod(F.xxhash64("msg_id"), F.lit(3)) == 0
    for part in (rows.filter(~late), rows.filter(late)):
        lake.write_days(part, root)
        done = retention.archive_days(t.spark, root, cold, date(2024, 2, 20), 40)
        retention.delete_days(t.spark, root, done).count()
    stored = lake.read_lake(t.spark, cold)
    return stored.groupBy(*schemas.PARTITION_COLUMNS).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("msg_id").alias("ids")
    )


@query(
    "M06_archive_report",
    f"select {_DAY}, count(*) as rows, true as sized from fx_messages where create_time < timestamp '2024-01-11' group by all",
)
def archive_report(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "archive")
    done = retention.archive_days(t.spark, message_lake(t), out, date(2024, 2, 20), 40)
    report = retention.archive_report(t.spark, message_lake(t), out, done)
    sized = (F.col("bytes_before") > 0) & (F.col("bytes_after") > 0) & (
        F.col("ratio") == F.col("bytes_before") / F.col("bytes_after")
    )
    return report.select(*schemas.PARTITION_COLUMNS, "rows", sized.alias("sized"))


@query(
    "M07_own_landing_files",
    """
    select strftime(ts, '%Y-%m-%d') as stem, case when cast(ts as date) >= date '2024-01-18' then 'keep'
           when cast(ts as date) in (select cast(create_time as date) from fx_messages) then 'delete' else 'no_parquet' end as decision
    from events group by all
    """,
)
def own_landing_files(t: Tables) -> DataFrame:
    """Events landed by day, the message table beside them, and what retention would do."""
    raw = scratch_path(t.spark, "raw")
    jsonl.append_daily(t.table("events").select("event_id", "ts"), raw, F.col("ts"))
    landed = partitions.day_counts(_lake(t)).select(
        F.date_format(F.make_date(*schemas.PARTITION_COLUMNS), "yyyy-MM-dd").alias("day_key")
    )
    plan = retention.retention_plan(retention.raw_day_files(t.spark, raw), landed, MID_MONTH)
    return plan.select("stem", "decision").distinct()


@query(
    "A13_conversion_sizes",
    "select count(distinct cast(create_time as date)) as stored_files, true as sized from fx_messages",
)
def conversion_sizes(t: Tables) -> DataFrame:
    raw = scratch_path(t.spark, "raw")
    t.fx_messages.select(F.to_json(F.struct("msg_id", "content")).alias("value")).write.text(raw)
    sizes = partitions.conversion_sizes(
        files.list_files(t.spark, raw, "*.txt"), files.list_files(t.spark, message_lake(t))
    )
    sized = (F.col("bytes_before") > 0) & (F.col("ratio") == F.col("bytes_before") / F.col("bytes_after"))
    return sizes.select("stored_files", sized.alias("sized"))


_FILES = f"select {_DAY}, {{}} from fx_messages group by year(create_time), month(create_time), day(create_time)"


def _placed(df: DataFrame) -> DataFrame:
    """File facts with the day of the file in place of its path."""
    return df.withColumn("_p", files.parse_path(F.col("file_path"))).select("_p.*", *df.columns).drop("file_path")


@query("M01_validate_partitions", _FILES.format("1 as file_count, count(*) as total_records, true as is_valid, '' as errors"))
def validate_partitions(t: Tables) -> DataFrame:
    rows = quality.validate_partitions(files.footers(t.spark, message_lake(t)))
    return rows.withColumn("errors", F.array_join("errors", ",")).drop("total_size")


@query(
    "M02_quarantine",
    _CLEAN_LINES + f"""
    select line_no, 'parse_error' as error_type, '' as missing_fields, value as raw from fx_raw_lines where trim(value) <> '' and not json_valid(value)
    union all
    select m.line_no, 'schema_error', array_to_string(list_filter({_REQUIRED}, lambda x: not list_contains(present, x)), ','), left(f.value, 500)
    from m join fx_raw_lines f on f.line_no = m.line_no where not list_has_all(present, {_REQUIRED})
    """,
)
def quarantine(t: Tables) -> DataFrame:
    return cleaning.quarantine(t.fx_raw_lines).select("line_no", "error_type", "missing_fields", "raw")


@query("M03_file_metadata", _FILES.format("count(*) as row_count, 13 as column_count, 'SNAPPY' as codec"))
def file_metadata(t: Tables) -> DataFrame:
    return _placed(quality.file_metadata(files.footers(t.spark, message_lake(t)))).drop("file_size")


@query("M04_file_validity", _FILES.format("true as valid, '' as reasons"))
def file_validity(t: Tables) -> DataFrame:
    rows = _placed(quality.file_validity(files.footers(t.spark, message_lake(t))))
    return rows.withColumn("reasons", F.array_join("reasons", ","))


@query("M05_file_statistics", _FILES.format("1 as row_groups, count(*) as row_count, true as smaller, true as written_by_spark"))
def file_statistics(t: Tables) -> DataFrame:
    rows = _placed(quality.file_statistics(files.footers(t.spark, message_lake(t))))
    return rows.select(
        *schemas.PARTITION_COLUMNS, "row_groups", "row_count",
        (F.col("compressed") < F.col("uncompressed")).alias("smaller"),
        F.contains("writer", F.lit("parquet-mr")).alias("written_by_spark"),
    )


@query(
    "M08_scan_estimate",
    """
    with k as (select count(distinct cast(create_time as date)) as known from fx_messages)
    select user_id, cast(date_diff('day', first_day, last_day) + 1 as int) as days,
           least(date_diff('day', first_day, last_day) + 1, known) as partitions,
           least(date_diff('day', first_day, last_day) + 1, known) * 100 as cost,
           least(date_diff('day', first_day, last_day) + 1, known) <= 31 as efficient
    from fx_ranges, k
    """,
)
def scan_estimate(t: Tables) -> DataFrame:
    known = partitions.day_counts(_lake(t)).count()
    estimate = partitions.scan_estimate(t.fx_ranges, "first_day", "last_day", F.lit(known).cast("long"))
    return estimate.drop("first_day", "last_day")


@query(
    "M09_checkpoint_status",
    """
    with s as (select distinct concat('file_', user_id % 45) as source_file from events),
    cur as (select * from fx_checkpoint_log qualify row_number() over (partition by source_file order by log_no desc) = 1)
    select source_file, coalesce(status, 'not_started') as status, coalesce(last_processed_line, 0) as last_processed_line,
           coalesce(processed_record_count, 0) as processed_record_count, coalesce(last_processed_msg_id, '') as last_processed_msg_id
    from s left join cur using (source_file)
    """,
)
def checkpoint_status(t: Tables) -> DataFrame:
    sources = t.table("events").select(F.concat(F.lit("file_"), F.col("user_id") % 45).alias("source_file"))
    rows = state.checkpoint_status(t.fx_checkpoint_log, sources)
    return rows.withColumn("last_processed_msg_id", F.coalesce("last_processed_msg_id", F.lit(""))).drop("log_no")


@query(
    "D06_quality_metrics",
    """
    with w as (select cast(create_time as date) as d, count(*) as n, count(distinct msg_id) as ids,
                      count(*) filter (where nullif(chatroom, '') is null) as nulls,
                      count(*) filter (where msg_type = 47) as bad from fx_duplicates group by 1)
    select cast(year(d) as int) as year, cast(month(d) as int) as month, cast(day(d) as int) as day, metric_name, metric_value from (
      select d, 'null_rate' as metric_name, round(nulls / (n * 2.0), 6) as metric_value from w
      union all select d, 'duplicate_rate', round((n - ids) / (n * 1.0), 6) from w
      union all select d, 'schema_violations', cast(bad as double) from w)
    """,
)
def quality_metrics(t: Tables) -> DataFrame:
    rows = _lake(t, "fx_duplicates").withColumn("room", F.nullif("chatroom", F.lit("")))
    return quality.quality_metrics(rows, ["msg_id", "room"], F.col("msg_type") == 47)


@query(
    "D06_kept_facts",
    f"select {_DAY}, count(*) as row_count, count(*) filter (where chatroom is null) as nulls, "
    "count(*) filter (where msg_type = 47) as violations, cast(epoch(min(create_time)) as bigint) as first_epoch, "
    "cast(epoch(max(create_time)) as bigint) as last_epoch, true as ids_close "
    "from fx_duplicates group by year(create_time), month(create_time), day(create_time)",
)
def kept_facts(t: Tables) -> DataFrame:
    """Facts of days from kept rows per file; the distinct ids are held against an exact count."""
    root, kept = message_lake(t, "fx_duplicates"), scratch_path(t.spark, "day_facts")
    day_facts.update_facts(t.spark, root, kept, ["msg_id", "chatroom"], F.col("msg_type") == 47)
    exact = _lake(t, "fx_duplicates").groupBy(*schemas.PARTITION_COLUMNS).agg(F.count_distinct("msg_id").alias("_ids"))
    found = day_facts.day_facts(t.spark, root, kept).join(exact, schemas.PARTITION_COLUMNS)
    return found.select(
        *schemas.PARTITION_COLUMNS, "row_count", "nulls", "violations",
        F.unix_timestamp("first_time").alias("first_epoch"),
        F.unix_timestamp("last_time").alias("last_epoch"),
        (F.abs(F.col("distinct_ids") - F.col("_ids")) <= 0.03 * F.col("_ids") + 1).alias("ids_close"),
    )


_FIELDS = """
with j as (
  select case when json_valid(value) then cast(value as json) end as v from fx_raw_lines where trim(value) <> '' and json_valid(value)
), p as (
  select list_contains(json_keys(v), 'msg_id') as flat, case when list_contains(json_keys(v), 'msg_id') then v else v->'data' end as d from j
), k as (
  select flat, d, unnest(json_keys(d)) as name from p
), obs as (
  select distinct flat, name, case json_type(json_extract(d, '$.' || name)) when 'UBIGINT' then 'number' when 'BIGINT' then 'number'
         when 'VARCHAR' then 'string' when 'NULL' then 'null' else 'other' end as type from k
)
"""


def _observed(t: Tables, flat: bool) -> DataFrame:
    rows = cleaning.extract_payload(cleaning.valid_lines(t.fx_raw_lines))
    return evolution.observed_fields(rows.filter(F.map_contains_key("_body", "guid") == flat))


@query(
    "E01_field_changes",
    _FIELDS + """
    select coalesce(a.name, b.name) as name, coalesce(a.type, '') as old_type, coalesce(b.type, '') as new_type,
           case when a.name is null then 'added' when b.name is null then 'removed' when a.type <> b.type then 'changed' else 'same' end as status
    from (select * from obs where flat) a full join (select * from obs where not flat) b on a.name = b.name
    """,
)
def field_changes(t: Tables) -> DataFrame:
    changes = evolution.field_changes(_observed(t, True), _observed(t, False))
    return changes.fillna("", ["old_type", "new_type"])


@query(
    "E01_compatibility",
    _FIELDS + """
    , c as (select coalesce(a.name, b.name) as name,
           case when a.name is null then 'added' when b.name is null then 'removed' when a.type <> b.type then 'changed' else 'same' end as status
    from (select * from obs where flat) a full join (select * from obs where not flat) b on a.name = b.name)
    select coalesce(string_agg(name, ',' order by name) filter (where status = 'added'), '') as added_fields,
           coalesce(string_agg(name, ',' order by name) filter (where status = 'removed'), '') as removed_fields,
           coalesce(string_agg(name, ',' order by name) filter (where status = 'changed'), '') as changed_fields,
           case when count(*) filter (where status in ('removed', 'changed')) > 0 then 'breaking'
                when count(*) filter (where status = 'added') > 0 then 'backward' else 'full' end as compatibility_type,
           count(*) filter (where status in ('removed', 'changed')) = 0 as is_compatible
    from c
    """,
)
def compatibility(t: Tables) -> DataFrame:
    return evolution.check_compatibility(_observed(t, True), _observed(t, False))


@query(
    "E02_dataset_layouts",
    "with d as (select count(distinct cast(create_time as date)) as files from fx_messages) "
    "select files, true as is_base from d union all select files, false from d",
)
def dataset_layouts(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "layouts")
    lake.write_days(t.fx_messages, f"{root}/a")
    lake.write_days(t.fx_duplicates, f"{root}/b")
    return evolution.dataset_layouts(files.footers(t.spark, root)).select("files", "is_base")


_EXTRA_LINES = """
select line_no, replace(value, '"content":', concat(
         case when line_no % 3 = 0 then concat('"mood":', line_no, ',') when line_no % 3 = 1 then '"mood":"calm",' else '' end,
         case when line_no % 200 >= 120 then concat('"place":{"floor":', line_no % 7, '},') else '' end, '"content":')) as value
from fx_raw_lines where line_no % 50 not in (7, 9, 11, 13)
"""


def _extra_rows(t: Tables) -> DataFrame:
    lines = t.fx_raw_lines.where("line_no % 50 not in (7, 9, 11, 13)")
    mood = F.expr("case when line_no % 3 = 0 then concat('\"mood\":', line_no, ',') when line_no % 3 = 1 then '\"mood\":\"calm\",' else '' end")
    place = F.expr("case when line_no % 200 >= 120 then concat('{\"floor\":', line_no % 7, '}') end")
    named = F.coalesce(F.concat(F.lit('"place":'), place, F.lit(",")), F.lit(""))
    value = F.replace("value", F.lit('"content":'), F.concat(mood, named, F.lit('"content":')))
    opened = cleaning.extract_payload(cleaning.valid_lines(lines.select(value.alias("value"))))
    kept = cleaning.coerce_numbers(cleaning.prepare_messages(cleaning.keep_unknown(opened)))
    return cleaning.with_day(kept)


@query(
    "E02_extra_fields",
    "with l as (" + _EXTRA_LINES + """), d as (select json_extract(value, '$.data') as v from l),
    k as (select make_timestamp(cast(json_extract_string(v, '$.create_time') as bigint) * 1000000) as create_time, v, unnest(json_keys(v)) as name from d),
    f as (select *, case json_type(json_extract(v, '$.' || name)) when 'UBIGINT' then 'BIGINT' when 'VARCHAR' then 'STRING'
                         else 'OBJECT<floor: BIGINT>' end as type from k where name in ('mood', 'place'))
    select cast(year(create_time) as int) as year, cast(month(create_time) as int) as month, cast(day(create_time) as int) as day, name,
           case when count(distinct type) > 1 then 'VARIANT' else min(type) end as type, count(*) as row_count
    from f group by year(create_time), month(create_time), day(create_time), name
    """,
)
def extra_fields(t: Tables) -> DataFrame:
    """Fields that no schema names, per day, from what is kept in ``extra``."""
    return evolution.extra_fields(_extra_rows(t))


@query(
    "E03_merged_fields",
    _FIELDS + "select name, case when count(distinct type) > 1 then 'string' else min(type) end as type from obs group by 1",
)
def merged_fields(t: Tables) -> DataFrame:
    both = _observed(t, True).unionByName(_observed(t, False))
    return evolution.merge_fields(both)


@query(
    "E03_merged_two",
    _FIELDS + "select coalesce(a.name, b.name) as name, coalesce(a.type, b.type) as type "
    "from (select * from obs where flat) a full join (select * from obs where not flat) b on a.name = b.name",
)
def merged_two(t: Tables) -> DataFrame:
    return evolution.merge_two(_observed(t, True), _observed(t, False))


@query(
    "E04_latest_versions",
    "select schema_name, max(version) as version, arg_max(fields, version) as fields, count(*) as versions from fx_registry group by 1",
)
def latest_versions(t: Tables) -> DataFrame:
    return evolution.latest_versions(t.fx_registry)


@query(
    "E04_next_versions",
    "select n.schema_name, coalesce(max(version), 0) + 1 as version from "
    "(select distinct case when event_type = 'view' then 'fresh' else event_type end as schema_name from events) n "
    "left join fx_registry r on r.schema_name = n.schema_name group by 1",
)
def next_versions(t: Tables) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "fresh").otherwise(F.col("event_type"))
    return evolution.next_versions(t.fx_registry, t.table("events").select(name.alias("schema_name")))


@query(
    "E05_file_schema_errors",
    "with d as (select distinct cast(create_time as date) as d from fx_messages), p as (select unnest(['msg_type', 'room_name']) as name, unnest(['type_mismatch', 'missing']) as problem) "
    "select cast(year(d) as int) as year, cast(month(d) as int) as month, cast(day(d) as int) as day, name, problem from d cross join p",
)
def file_schema_errors(t: Tables) -> DataFrame:
    expected = {"msg_id": "string", "msg_type": "int64", "room_name": "string"}
    return _placed(evolution.file_schema_errors(files.footers(t.spark, message_lake(t)), expected))


@query(
    "U01_union_of_layouts",
    "select msg_id, content, coalesce(descr, '') as descr, coalesce(role, '') as role from ("
    "select msg_id, content, descr, null as role from fx_messages union all select msg_id, content, null, from_username from fx_chat)",
)
def union_of_layouts(t: Tables) -> DataFrame:
    first, second = scratch_path(t.spark, "layout"), scratch_path(t.spark, "layout")
    t.fx_messages.select("msg_id", "content", "descr").write.parquet(first)
    t.fx_chat.select("msg_id", "content", F.col("from_username").alias("role")).write.parquet(second)
    rows = lake.read_union(t.spark, [first, second])
    return rows.fillna("", ["descr", "role"]).select("msg_id", "content", "descr", "role")


@query(
    "U03_missing_files",
    "select distinct day_key from (select concat('', cast(ts as date)) as day_key from events) "
    "except select day_key from fx_landed_days",
)
def missing_files(t: Tables) -> DataFrame:
    days = t.table("events").select(F.col("ts").cast("date").cast("string").alias("day_key")).distinct()
    return days.join(t.fx_landed_days, "day_key", "left_anti")


@query(
    "U04_common_fields",
    _FIELDS + "select distinct a.name from obs a join obs b on a.name = b.name where a.flat and not b.flat",
)
def common_fields(t: Tables) -> DataFrame:
    return _observed(t, True).select("name").intersect(_observed(t, False).select("name"))
