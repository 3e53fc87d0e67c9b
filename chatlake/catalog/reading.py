"""Sources, sinks and message cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake import schemas
from chatlake.catalog.registry import message_lake, query
from chatlake.functions import clean
from chatlake.operators import cleaning, selection
from chatlake.session import scratch_path
from chatlake.sources import files, jsonl, lake
from chatlake.sources.adapters import Tables
from chatlake.streaming import ingest

_REQUIRED = "['msg_id','from_username','to_username','msg_type','create_time','is_chatroom_msg','source','guid','notify_type']"

# One landing file per 2500 lines, named like days, so that resuming has files to resume in.
_LANDED = """
with landed as (
  select line_no, value, concat('f', cast(floor(line_no / 2500) as bigint)) as landing_file from fx_raw_lines
), placed as (
  select landing_file, value, row_number() over (partition by landing_file order by line_no) as n from landed
)
"""


def _landing(t: Tables) -> str:
    path = scratch_path(t.spark, "landing")
    lines = t.fx_raw_lines.select(
        "value",
        F.concat(F.lit("f"), F.floor(F.col("line_no") / 2500)).alias("landing_file"),
        "line_no",
    )
    ordered = lines.repartition("landing_file").sortWithinPartitions("landing_file", "line_no")
    ordered.drop("line_no").write.partitionBy("landing_file").text(path)
    return path


@query(
    "S01_jsonl_scan",
    "select line_no, value from fx_raw_lines where trim(value) <> '' and json_valid(value)",
)
def jsonl_scan(t: Tables) -> DataFrame:
    return cleaning.valid_lines(t.fx_raw_lines).select("line_no", "value")


@query(
    "S02_resume_from_line",
    _LANDED + "select landing_file, n as line_no, value from placed "
    "where n > 1000 and trim(value) <> '' and json_valid(value)",
)
def resume_from_line(t: Tables) -> DataFrame:
    rows = jsonl.read_from_line(t.spark, _landing(t), 1000)
    return rows.select("landing_file", "line_no", "value")


@query(
    "S03_line_count",
    _LANDED + "select landing_file, count(*) as lines from placed where trim(value) <> '' group by 1",
)
def line_count(t: Tables) -> DataFrame:
    counts = jsonl.count_lines(jsonl.read_lines(t.spark, _landing(t)))
    name = F.regexp_extract("source_file", r"landing_file=([^/]+)", 1)
    return counts.select(name.alias("landing_file"), "lines")


@query(
    "S04_line_batches",
    _LANDED + ", good as (select landing_file, row_number() over (partition by landing_file order by n) as v "
    "from placed where trim(value) <> '' and json_valid(value)) "
    "select landing_file, cast(floor((v - 1) / 700) as bigint) as batch_id, count(*) as row_count from good group by 1, 2",
)
def line_batches(t: Tables) -> DataFrame:
    batches = jsonl.batches_of(jsonl.read_lines(t.spark, _landing(t)), 700)
    return batches.groupBy("landing_file", "batch_id").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "S05_request_parse",
    """
    with k as (
      select request_id, body, lower(content_type) as ct,
             contains(lower(content_type), 'json') as is_json,
             contains(lower(content_type), 'form') as is_form from fx_requests
    ), pairs as (
      select request_id, pos, url_decode(replace(split_part(part, '=', 1), '+', ' ')) as key,
             url_decode(replace(substr(part, strpos(part, '=') + 1), '+', ' ')) as val
      from (select request_id, unnest(split(body, '&')) as part, generate_subscripts(split(body, '&'), 1) as pos
            from k where not is_json and is_form)
      where strpos(part, '=') > 0 and length(part) > strpos(part, '=')
    ), firsts as (
      select request_id, key, arg_min(val, pos) as val, min(pos) as pos from pairs group by 1, 2
    ), forms as (
      select request_id, string_agg(concat(key, '>', val), '|' order by pos) as form from firsts group by 1
    )
    select k.request_id,
           case when (is_json or (not is_form and left(trim(body), 1) in ('{', '['))) and json_valid(body) then body else '' end as parsed_json,
           case when is_json and not json_valid(body) then 'JSON decode error' else '' end as parse_error,
           coalesce(form, '') as form
    from k left join forms using (request_id)
    """,
)
def request_parse(t: Tables) -> DataFrame:
    parsed = jsonl.parse_requests(t.fx_requests.withColumn("body", F.encode("body", "UTF-8")))
    pairs = F.transform(
        F.map_entries("parsed_form"), lambda e: F.concat(e["key"], F.lit(">"), e["value"])
    )
    return parsed.select(
        "request_id",
        F.coalesce("parsed_json", F.lit("")).alias("parsed_json"),
        F.coalesce("parse_error", F.lit("")).alias("parse_error"),
        F.coalesce(F.array_join(pairs, "|"), F.lit("")).alias("form"),
    )


@query(
    "S06_daily_landing",
    "select strftime(create_time, '%Y-%m-%d') as arrival_date, count(*) as row_count from fx_messages group by 1",
)
def daily_landing(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "daily")
    jsonl.append_daily(t.fx_messages, path, F.col("create_time"))
    landed = t.spark.read.text(path).filter(clean.is_json(F.col("value")))
    day = F.date_format("arrival_date", "yyyy-MM-dd").alias("arrival_date")
    return landed.groupBy(day).agg(F.count(F.lit(1)).alias("row_count"))


_CLEAN_LINES = """
with j as (
  select line_no, case when json_valid(value) then cast(value as json) end as v
  from fx_raw_lines where trim(value) <> '' and json_valid(value)
), p as (
  select line_no, v, case when not list_contains(json_keys(v), 'msg_id') and json_type(v->'data') = 'OBJECT' then v->'data' else v end as d from j
), m as (
  select line_no, d->>'msg_id' as msg_id, d->>'from_username' as from_username, d->>'to_username' as to_username,
         d->>'create_time' as create_time, d->>'msg_type' as msg_type, d->>'is_chatroom_msg' as is_chatroom_msg,
         d->>'source' as source, d->>'content' as content, d->>'chatroom' as chatroom,
         case when list_contains(json_keys(d), 'guid') then d->>'guid' else v->>'guid' end as guid,
         case when list_contains(json_keys(d), 'notify_type') then d->>'notify_type' else v->>'notify_type' end as notify_type,
         list_concat(json_keys(d), list_filter(json_keys(v), lambda x: x in ('guid', 'notify_type'))) as present
  from p
)
"""


@query(
    "S07_convert_to_days",
    _CLEAN_LINES + """
    select msg_id, coalesce(from_username, '') as from_username, cast(epoch(make_timestamp(cast(create_time as bigint) * 1000000)) as bigint) as create_epoch,
           cast(year(make_timestamp(cast(create_time as bigint) * 1000000)) as int) as year,
           cast(month(make_timestamp(cast(create_time as bigint) * 1000000)) as int) as month,
           cast(day(make_timestamp(cast(create_time as bigint) * 1000000)) as int) as day,
           coalesce(source, '') as source, cast(msg_type as int) as msg_type
    from m where list_has_all(present, REQUIRED) and try_cast(create_time as bigint) is not null
    """.replace("REQUIRED", _REQUIRED),
)
def convert_to_days(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "converted")
    lake.convert_lines(t.fx_raw_lines, path)
    return lake.read_lake(t.spark, path).select(
        "msg_id", "from_username", F.unix_timestamp("create_time").alias("create_epoch"),
        "year", "month", "day", "source", "msg_type",
    )


@query(
    "S08_append_days",
    "select strftime(create_time, '%Y-%m-%d') as day_key, 2 * count(*) as row_count from fx_messages group by 1",
)
def append_days(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "appended")
    rows = t.fx_messages.withColumnRenamed("descr", "desc")
    lake.append_messages(rows, path)
    lake.append_messages(rows, path)
    stored = lake.read_lake(t.spark, path).filter(F.col("ingestion_time").isNotNull())
    key = F.date_format(F.make_date("year", "month", "day"), "yyyy-MM-dd").alias("day_key")
    return stored.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "S09_lake_scan",
    "select cast(year(create_time) as int) as year, cast(month(create_time) as int) as month, "
    "cast(day(create_time) as int) as day, msg_id, msg_type, content from fx_messages",
)
def lake_scan(t: Tables) -> DataFrame:
    rows = lake.read_lake(t.spark, message_lake(t))
    return rows.select("year", "month", "day", "msg_id", "msg_type", "content")


@query(
    "S10_partition_files",
    "select distinct cast(year(create_time) as int) as year, cast(month(create_time) as int) as month, cast(day(create_time) as int) as day, true as sized "
    "from fx_messages where create_time >= timestamp '2024-01-01' and create_time < timestamp '2024-02-01'",
)
def partition_files(t: Tables) -> DataFrame:
    rows = files.partition_files(t.spark, message_lake(t), year=2024, month=1)
    return rows.select("year", "month", "day", (F.col("file_size") > 0).alias("sized"))


@query(
    "S11_file_checksums",
    """
    select c_nationkey * 1000000 + c_custkey // 500 as page, md5(concat(string_agg(c_name, ',' order by c_custkey), chr(10))) as md5,
           length(concat(string_agg(c_name, ',' order by c_custkey), chr(10))) as file_size
    from customer group by 1
    """,
)
def file_checksums(t: Tables) -> DataFrame:
    """Files whose content is known: names of customers, a page per nation and five hundred keys."""
    out = scratch_path(t.spark, "pages")
    page = (F.col("c_nationkey") * 1000000 + F.floor(F.col("c_custkey") / 500)).alias("page")
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    pages = t.table("customer").groupBy(page).agg(F.array_join(names, ",").alias("value"))
    # a folder holds a thousand pages at most, so that listing them takes few tasks
    name = F.coalesce(F.col("page").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    folder = F.coalesce(F.floor(F.col("page") / 1000).cast("string"), F.lit("none"))
    files.write_texts(pages.select(F.concat(F.lit("part="), folder, F.lit("/page="), name, F.lit(".txt")).alias("path"), "value"), out)
    found = files.checksums(t.spark, out, "*.txt")
    number = F.regexp_extract("file_path", r"page=(\d+)", 1).cast("bigint")
    return found.select(number.alias("page"), "md5", "file_size")


@query(
    "S12_csv_export",
    "select msg_id, chatroom, from_username from fx_messages "
    "where create_time >= timestamp '2024-01-05' and create_time < timestamp '2024-01-08' and chatroom <> ''",
)
def csv_export(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    rows = selection.query_messages(
        lake.read_lake(t.spark, message_lake(t)), "2024-01-05", "2024-01-07",
        columns=["msg_id", "chatroom", "from_username"],
    )
    files.write_csv(rows.filter(F.col("chatroom") != ""), path)
    return t.spark.read.csv(path, header=True)


@query(
    "S13_ingest_objects",
    _CLEAN_LINES + "select m.msg_id, count(*) as copies from m "
    f"where list_has_all(present, {_REQUIRED}) and try_cast(create_time as bigint) is not null group by 1",
)
def ingest_objects(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "objects")
    ingest.ingest_objects(t.spark, t.fx_raw_lines.select("value"), path)
    stored = lake.read_lake(t.spark, path)
    return stored.groupBy("msg_id").agg(F.count(F.lit(1)).alias("copies"))


def _text(*names: str) -> list:
    return [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in names]


@query(
    "P01_flatten_envelope",
    _CLEAN_LINES + "select line_no, coalesce(msg_id, '') as msg_id, coalesce(guid, '') as guid, "
    "coalesce(notify_type, '') as notify_type, coalesce(content, '') as content from m",
)
def flatten_envelope(t: Tables) -> DataFrame:
    rows = cleaning.extract_payload(cleaning.valid_lines(t.fx_raw_lines))
    return rows.select("line_no", *_text("msg_id", "guid", "notify_type", "content"))


@query("P02_source_text", _CLEAN_LINES + "select line_no, coalesce(source, '') as source from m")
def source_text(t: Tables) -> DataFrame:
    rows = cleaning.extract_payload(cleaning.valid_lines(t.fx_raw_lines))
    return cleaning.clean_fields(rows).select("line_no", "source")


@query(
    "P03_optional_text",
    _CLEAN_LINES + "select line_no, coalesce(content, '') as content, coalesce(chatroom, '') as chatroom from m",
)
def optional_text(t: Tables) -> DataFrame:
    rows = cleaning.extract_payload(cleaning.valid_lines(t.fx_raw_lines))
    return cleaning.clean_fields(rows).select("line_no", "content", "chatroom")


@query(
    "P04_batch_clean",
    _CLEAN_LINES + "select line_no, coalesce(msg_id, '') as msg_id, coalesce(source, '') as source, "
    "coalesce(content, '') as content, coalesce(chatroom, '') as chatroom from m",
)
def batch_clean(t: Tables) -> DataFrame:
    rows = cleaning.clean_fields(cleaning.extract_payload(cleaning.valid_lines(t.fx_raw_lines)))
    return rows.select("line_no", *_text("msg_id"), "source", "content", "chatroom")


@query(
    "P05_required_fields",
    _CLEAN_LINES + f"select line_no, msg_id from m where list_has_all(present, {_REQUIRED})",
)
def required_fields(t: Tables) -> DataFrame:
    rows = cleaning.extract_payload(cleaning.valid_lines(t.fx_raw_lines))
    return cleaning.required_only(rows).select("line_no", "msg_id")


@query(
    "P06_prepare",
    _CLEAN_LINES + """
    select line_no, msg_id, create_time, coalesce(from_username, '') as from_username, coalesce(to_username, '') as to_username,
           coalesce(msg_type, '0') as msg_type, coalesce(is_chatroom_msg, '0') as is_chatroom_msg, coalesce(source, '') as source,
           coalesce(guid, '') as guid, coalesce(notify_type, '0') as notify_type, true as stamped
    from m where coalesce(msg_id, '') <> '' and coalesce(create_time, '') <> ''
    """,
)
def prepare(t: Tables) -> DataFrame:
    rows = cleaning.prepare_messages(cleaning.extract_payload(cleaning.valid_lines(t.fx_raw_lines)))
    return rows.select(
        "line_no", "msg_id", "create_time", *schemas.INGEST_DEFAULTS,
        F.col("ingestion_time").isNotNull().alias("stamped"),
    )


@query(
    "P07_nested_as_json",
    "select event_id, concat('{\"user\":', user_id, ',\"kind\":\"', event_type, '\"}') as cell, "
    "concat('[', event_id, ',', user_id, ']') as items from events",
)
def nested_as_json(t: Tables) -> DataFrame:
    nested = t.table("events").select(
        "event_id",
        F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("cell"),
        F.array("event_id", "user_id").alias("items"),
    )
    return nested.withColumns({n: clean.as_json_text(F.col(n)) for n in ("cell", "items")})


@query(
    "P08_coerce_numbers",
    """
    select row_id, cast(create_time as bigint) as create_time, cast(try_cast(msg_type as double) as bigint) as msg_type,
           cast(notify_type as bigint) as notify_type, cast(is_chatroom_msg as bigint) as is_chatroom_msg
    from fx_loose
    where msg_id <> '' and try_cast(create_time as double) is not null and try_cast(notify_type as double) is not null
      and try_cast(msg_type as double) = floor(try_cast(msg_type as double))
    """,
)
def coerce_numbers(t: Tables) -> DataFrame:
    rows = cleaning.coerce_numbers(t.fx_loose.filter(F.col("msg_id") != ""))
    return rows.select("row_id", *schemas.NUMERIC_FIELDS)


@query(
    "P09_partition_fields",
    "select msg_id, cast(year(make_timestamp(create_epoch * 1000000)) as int) as year, "
    "cast(month(make_timestamp(create_epoch * 1000000)) as int) as month, "
    "cast(day(make_timestamp(create_epoch * 1000000)) as int) as day from fx_chat",
)
def partition_fields(t: Tables) -> DataFrame:
    return cleaning.with_day(t.fx_chat, "create_epoch").select("msg_id", "year", "month", "day")


@query(
    "P10_partition_keys",
    """
    select msg_id, strftime(create_time, '%Y-%m-%d') as partition_key,
           strftime(create_time, 'year=%Y/month=%m/day=%d') as path,
           cast(year(create_time) as int) as year, cast(month(create_time) as int) as month, cast(day(create_time) as int) as day
    from fx_messages
    """,
)
def partition_keys(t: Tables) -> DataFrame:
    key = files.partition_key(F.year("create_time"), F.month("create_time"), F.day("create_time"))
    keyed = t.fx_messages.select("msg_id", key.alias("partition_key"))
    parsed = keyed.withColumn("_d", files.parse_key(F.col("partition_key")))
    path = files.partition_path(F.col("_d.year"), F.col("_d.month"), F.col("_d.day"))
    placed = parsed.select("msg_id", "partition_key", path.alias("path"))
    return placed.withColumn("_p", files.parse_path(F.col("path"))).select(
        "msg_id", "partition_key", "path", "_p.*"
    )


@query(
    "P11_time_to_timestamp",
    "select msg_id, strftime(make_timestamp(create_epoch * 1000000), '%Y-%m-%d %H:%M:%S') as at from fx_chat",
)
def time_to_timestamp(t: Tables) -> DataFrame:
    rows = cleaning.times_to_timestamp(t.fx_chat, "create_epoch")
    return rows.select("msg_id", F.date_format("create_epoch", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "P12_conform_schema",
    "select msg_id, chatroom, from_username, msg_type, content, '' as to_username, '' as guid from fx_chat",
)
def conform_schema(t: Tables) -> DataFrame:
    rows = cleaning.conform(t.fx_chat.withColumn("unknown", F.lit(1)))
    assert rows.columns == schemas.MESSAGES.names
    return rows.select("msg_id", "chatroom", "from_username", "msg_type", "content",
                       *_text("to_username", "guid"))


_RANGE = "create_time >= timestamp '2024-01-05' and create_time < timestamp '2024-01-08'"


@query("P13_date_range", f"select msg_id, cast(epoch(create_time) as bigint) as create_epoch, content from fx_messages where {_RANGE}")
def date_range(t: Tables) -> DataFrame:
    rows = selection.query_messages(lake.read_lake(t.spark, message_lake(t)), "2024-01-05", "2024-01-07")
    return rows.select("msg_id", F.unix_timestamp("create_time").alias("create_epoch"), "content")


@query(
    "P14_extra_predicates",
    f"select msg_id, chatroom, msg_type from fx_messages where {_RANGE} and chatroom = 'room_0' and msg_type in (1, 3)",
)
def extra_predicates(t: Tables) -> DataFrame:
    return selection.query_messages(
        lake.read_lake(t.spark, message_lake(t)), "2024-01-05", "2024-01-07",
        {"chatroom": "room_0", "msg_type": [1, 3]}, ["msg_id", "chatroom", "msg_type"],
    )


@query(
    "P15_lookup_by_ids",
    "select msg_id, content from fx_messages where msg_id in ('evt_1', 'evt_20', 'evt_333', 'evt_none')",
)
def lookup_by_ids(t: Tables) -> DataFrame:
    ids = ["evt_1", "evt_20", "evt_333", "evt_none"]
    return selection.by_ids(lake.read_lake(t.spark, message_lake(t)), ids).select("msg_id", "content")


@query(
    "P15_lookup_by_id_table",
    "select msg_id, content from fx_messages where msg_id in (select concat('evt_', o_orderkey) from orders)",
)
def lookup_by_id_table(t: Tables) -> DataFrame:
    ids = t.table("orders").select(F.concat(F.lit("evt_"), "o_orderkey").alias("msg_id"))
    return selection.by_ids(lake.read_lake(t.spark, message_lake(t)), ids).select("msg_id", "content")


@query("P16_projection", "select content, msg_id, cast(epoch(create_time) as bigint) as at from fx_messages")
def projection(t: Tables) -> DataFrame:
    rows = selection.project(
        lake.read_lake(t.spark, message_lake(t)), ["content", "msg_id"], ["msg_id", "create_time"]
    )
    return rows.select("content", "msg_id", F.unix_timestamp("create_time").alias("at"))


@query(
    "P17_group_messages",
    "select chatroom, count(*) as messages from fx_messages where is_chatroom_msg = 1 "
    "and chatroom in ('room_0', 'room_3') group by 1",
)
def group_messages(t: Tables) -> DataFrame:
    rows = selection.group_messages(lake.read_lake(t.spark, message_lake(t)), ["room_0", "room_3"])
    return rows.groupBy("chatroom").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "P18_route_events",
    """
    select case c_custkey % 4 when 0 then 'messages' when 1 then 'contact_updates' when 2 then 'contact_deletes' else 'contact_details' end as branch,
           concat('g', c_custkey) as guid, cast(cast(value as json)->'data' as varchar) as data
    from fx_envelopes
    """,
)
def route_events(t: Tables) -> DataFrame:
    branches = cleaning.route_events(t.fx_envelopes)
    tagged = [df.select(F.lit(n).alias("branch"), "guid", "data") for n, df in branches.items()]
    result = tagged[0]
    for other in tagged[1:]:
        result = result.unionByName(other)
    return result


@query(
    "P19_contact_table",
    """
    with e as (select c_custkey, cast(value as json) as v, cast(value as json)->'data' as d from fx_envelopes where c_custkey % 4 > 0)
    select coalesce(d->'userName'->>'string', d->>'tpUsername') as username, coalesce(d->>'alias', '') as alias,
           coalesce(cast(d->>'contactType' as int), 0) as contact_type, coalesce(cast(d->>'sex' as int), 0) as sex,
           coalesce(d->>'city', '') as city, coalesce(d->>'mobile', '') as mobile,
           coalesce(d->>'nickName', d->>'nickname', '{}') as nick, coalesce(d->>'remark', '{}') as remark,
           coalesce(d->>'snsUserInfo', '{}') as sns, coalesce(d->>'customInfo', '{}') as custom_info,
           v->>'guid' as guid, cast(v->>'notify_type' as int) as notify_type
    from e
    """,
)
def contact_table(t: Tables) -> DataFrame:
    branches = cleaning.route_events(t.fx_envelopes)
    events = branches["contact_updates"].unionByName(branches["contact_deletes"])
    rows = cleaning.contacts_from_events(events.unionByName(branches["contact_details"]))
    return rows.select(
        "username", "alias", F.col("contactType").alias("contact_type"), F.col("sex").cast("int").alias("sex"),
        "city", "mobile", F.col("nickName").alias("nick"), "remark", F.col("snsUserInfo").alias("sns"),
        F.col("customInfo").alias("custom_info"), "guid", "notify_type",
    )


@query(
    "P20_value_rules",
    """
    select c_custkey, concat_ws(',', case when contacttype < 0 then 'contactType' end,
           case when deleteflag not in (0, 1) then 'deleteFlag' end, case when sex not in (0, 1, 2) then 'sex' end) as broken
    from fx_contact_checks where contacttype < 0 or deleteflag not in (0, 1) or sex not in (0, 1, 2)
    """,
)
def value_rules(t: Tables) -> DataFrame:
    checked = t.fx_contact_checks.withColumn("_broken", cleaning.contact_violations())
    broken = checked.filter(F.size("_broken") > 0)
    return broken.select("c_custkey", F.array_join("_broken", ",").alias("broken"))


@query(
    "P20_message_rules",
    "select msg_id from fx_messages where msg_type < 0 or is_chatroom_msg not in (0, 1) or msg_type is null",
)
def message_rules(t: Tables) -> DataFrame:
    checked = t.fx_messages.withColumn("_broken", cleaning.message_violations())
    return checked.filter(F.size("_broken") > 0).select("msg_id")


@query(
    "T01_first_rows",
    "select msg_id, cast(epoch(create_time) as bigint) as create_epoch from fx_messages order by create_time, msg_id limit 50",
)
def first_rows(t: Tables) -> DataFrame:
    rows = selection.first_rows(lake.read_lake(t.spark, message_lake(t)), 50)
    return rows.select("msg_id", F.unix_timestamp("create_time").alias("create_epoch"))


@query(
    "room_day_activity",
    """
    select chatroom, strftime(create_time, '%Y-%m-%d') as day_key, count(*) as messages,
           count(distinct chatroom_sender) as senders
    from fx_messages
    where is_chatroom_msg = 1 and chatroom <> ''
    group by 1, 2
    """,
)
def room_day_activity(t: Tables) -> DataFrame:
    rows = selection.group_messages(t.fx_messages)
    day = F.date_format("create_time", "yyyy-MM-dd").alias("day_key")
    return rows.groupBy("chatroom", day).agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("chatroom_sender").alias("senders")
    )
