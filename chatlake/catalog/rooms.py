"""Text form, sequence, batches and prompts of chatroom messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.catalog.enrichment import ENRICHED, xml_messages
from chatlake.catalog.registry import query
from chatlake.functions import privacy
from chatlake.functions import text as line
from chatlake.functions import topics as fn
from chatlake.operators import enrichment, sequence
from chatlake.plans import prompts
from chatlake.sources.adapters import Tables

SMALL_BUDGET = 400


def chat(t: Tables) -> DataFrame:
    """The chat adapter with a timestamp."""
    return t.fx_chat.withColumn("create_time", F.timestamp_seconds("create_epoch"))


def chat_members(t: Tables) -> DataFrame:
    """Members of the topic adapters in long form: one topic per conversation, ids in order."""
    return t.fx_chat.select("chatroom", F.col("conv_id").alias("topic_no"), F.lit(0).alias("pos"), "msg_id")


def sequenced_chat(t: Tables) -> DataFrame:
    return sequence.assign_sequence(chat(t))


@query(
    "F01_local_time",
    "select msg_id, strftime(make_timestamp(create_epoch * 1000000) + interval 8 hour, '%Y-%m-%d %H:%M:%S') as at from fx_chat",
)
def local_time(t: Tables) -> DataFrame:
    local = line.local_time_of_epoch(F.col("create_epoch").cast("string"), "Asia/Shanghai")
    return t.fx_chat.select("msg_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("at"))


# Ranges with and without seconds, dates or times, made from the event times.
_SPANS = """
with spans as (
  select event_id, case event_id % 5 when 0 then concat(strftime(ts, '%H:%M'), '-', strftime(ts + interval 90 minute, '%H:%M'))
         when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 2 then '' when 3 then concat(cast(hour(ts) as varchar), strftime(ts, ':%M')) else 'later' end as a,
         case event_id % 3 when 0 then strftime(ts + interval 30 minute, '%H:%M:%S') when 1 then '' else strftime(ts, '%H:%M') end as b
  from events
), times as (
  select *, regexp_extract_all(a, '[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?') as ta, regexp_extract_all(b, '[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?') as tb from spans
)
"""


def _spans(t: Tables) -> DataFrame:
    later = F.col("ts") + F.expr("interval 90 minutes")
    soon = F.col("ts") + F.expr("interval 30 minutes")
    part = F.col("event_id") % 5
    first = (
        F.when(part == 0, F.concat(F.date_format("ts", "HH:mm"), F.lit("-"), F.date_format(later, "HH:mm")))
        .when(part == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(part == 2, "")
        .when(part == 3, F.date_format("ts", "H:mm"))
        .otherwise("later")
    )
    third = F.col("event_id") % 3
    second = (
        F.when(third == 0, F.date_format(soon, "HH:mm:ss")).when(third == 1, "")
        .otherwise(F.date_format("ts", "HH:mm"))
    )
    return t.table("events").select("event_id", first.alias("a"), second.alias("b"))


@query("F02_times_in_text", _SPANS + "select event_id, array_to_string(ta, '|') as times from times")
def times_in_text(t: Tables) -> DataFrame:
    return _spans(t).select("event_id", F.array_join(line.extract_times(F.col("a")), "|").alias("times"))


_SECONDS = "cast(split_part({0}, ':', 1) as int) * 3600 + cast(split_part({0}, ':', 2) as int) * 60 + coalesce(try_cast(split_part({0}, ':', 3) as int), 0)"


@query("F03_time_seconds", _SPANS + f"select event_id, {_SECONDS.format('tb[1]')} as secs from times where len(tb) > 0")
def time_seconds(t: Tables) -> DataFrame:
    rows = _spans(t).filter(F.col("b") != "")
    return rows.select("event_id", line.seconds_of(F.col("b")).alias("secs"))


@query(
    "F04_time_format",
    _SPANS + "select event_id, case when event_id % 2 = 0 then case when len(split(tb[1], ':')) = 2 then tb[1] || ':00' else tb[1] end "
    "else split_part(tb[1], ':', 1) || ':' || split_part(tb[1], ':', 2) end as shown from times where len(tb) > 0",
)
def time_format(t: Tables) -> DataFrame:
    rows = _spans(t).filter(F.col("b") != "")
    return rows.select("event_id", line.format_time(F.col("b"), F.col("event_id") % 2 == 0).alias("shown"))


@query(
    "F05_merged_ranges",
    _SPANS + """
    , ordered as (select event_id, a, b, ta, tb, list_transform(list_concat(ta, tb), lambda x, i: {'s': %s, 'i': i, 't': x}) as items from times)
    , picked as (select *, list_sort(items)[1].t as lo, list_sort(list_transform(items, lambda x: {'s': x.s, 'i': -x.i, 't': x.t}), 'desc')[1].t as hi,
                 len(list_filter(items, lambda x: len(split(x.t, ':')) = 3)) > 0 as precise from ordered)
    select event_id, case when len(ta) = 0 then coalesce(nullif(b, ''), a) when len(tb) = 0 then a
      when precise then concat(case when len(split(lo, ':')) = 2 then lo || ':00' else lo end, '-', case when len(split(hi, ':')) = 2 then hi || ':00' else hi end)
      else concat(lo, '-', hi) end as merged from picked
    """ % _SECONDS.format("x"),
)
def merged_ranges(t: Tables) -> DataFrame:
    return _spans(t).select("event_id", line.merge_time_ranges(F.col("a"), F.col("b")).alias("merged"))


@query(
    "F06_report_times",
    _SPANS + "select event_id, case when a = '' then '-' else trim(regexp_replace(a, '[0-9]{4}-[0-9]{2}-[0-9]{2}\\s*', '', 'g')) end as shown from times",
)
def report_times(t: Tables) -> DataFrame:
    return _spans(t).select("event_id", line.report_time(F.col("a")).alias("shown"))


@query(
    "F07_plain_keywords",
    "select doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g') as word from documents",
)
def plain_keywords(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", line.normalize_keyword(F.col("text")).alias("word"))


# The words of this table are equal or far apart, so greedy matching is a multiset intersection.
@query(
    "F08_keyword_similarity",
    """
    with p as (select a.chatroom, a.topic_no, a.keywords as ka, b.keywords as kb from fx_topics a join fx_topics b on a.chatroom = b.chatroom and b.topic_no = a.topic_no + 7),
    w as (select chatroom, topic_no, unnest(list_distinct(ka)) as word, ka, kb from p),
    c as (select chatroom, topic_no, sum(least(len(list_filter(ka, lambda x: x = word)), len(list_filter(kb, lambda x: x = word)))) as n from w group by 1, 2)
    select chatroom, topic_no, round(n / 3.0, 6) as similarity from c
    """,
)
def keyword_similarity(t: Tables) -> DataFrame:
    left = t.fx_topics.select("chatroom", "topic_no", "keywords")
    right = left.select("chatroom", (F.col("topic_no") - 7).alias("topic_no"), F.col("keywords").alias("others"))
    pairs = left.join(right, ["chatroom", "topic_no"])
    score = fn.keyword_similarity(F.col("keywords"), F.col("others"))
    return pairs.select("chatroom", "topic_no", F.round(score, 6).alias("similarity"))


@query("F09_token_estimate", "select conv_id, turn, greatest(1, length(text) // 4) as tokens from conversations")
def token_estimate(t: Tables) -> DataFrame:
    tokens = line.estimate_tokens(F.col("text")).cast("long")
    return t.table("conversations").select("conv_id", "turn", tokens.alias("tokens"))


LINES = ENRICHED + """
, seq as (select *, row_number() over (partition by chatroom order by create_epoch, msg_id) as seq_id,
                 strftime(make_timestamp(create_epoch * 1000000), '%Y-%m-%d %H:%M:%S') as stamp from done)
, shown as (select *, case
     when appmsg_type in (4, 5) and appmsg_title <> '' then concat('[分享] ', appmsg_title)
     when svrid is not null then concat('[引用 @', coalesce(nullif(ref_name, ''), '?'), ': ', case when length(trim(ref_content)) > 30 then concat(rtrim(left(trim(ref_content), 30)), '...') else trim(ref_content) end, '] ', appmsg_title)
     else trim(content) end as body from seq)
, lines as (select *, case when should_filter then '' else concat(stamp, ' ', coalesce(nullif(chatroom_sender, ''), 'unknown'), ': ',
     case when length(body) > 120 then concat(rtrim(left(body, 120)), '...') else body end) end as line from shown)
"""
OPTIONS = line.LineFormat(max_content_length=120)


def sequenced_xml(t: Tables) -> DataFrame:
    return enrichment.enrich(sequence.assign_sequence(xml_messages(t)))


@query("F10_message_line", LINES + "select msg_id, line from lines")
def message_line(t: Tables) -> DataFrame:
    rows = enrichment.enrich(xml_messages(t))
    return rows.select("msg_id", line.message_line(OPTIONS).alias("line"))


@query(
    "F10_message_line_v2",
    LINES + "select msg_id, case when should_filter then '' else concat('[', seq_id, '] ', line) end as line from lines "
    "union all select concat(msg_id, '_ref'), concat('[', row_number() over (partition by chatroom order by create_epoch, msg_id), '] ', "
    "strftime(make_timestamp(create_epoch * 1000000), '%Y-%m-%d %H:%M:%S'), ' unknown: [图片]') from fx_image_refs",
)
def message_line_v2(t: Tables) -> DataFrame:
    options = line.LineFormat(max_content_length=120, prompt_version="v2")
    refs = t.fx_image_refs.withColumns(
        {"create_time": F.timestamp_seconds("create_epoch"), "from_username": F.lit(""),
         "chatroom_sender": F.lit(""), "msg_type": F.lit(3)}
    )
    images = enrichment.enrich(sequence.assign_sequence(refs)).withColumn("msg_id", F.concat("msg_id", F.lit("_ref")))
    rows = sequenced_xml(t).select("msg_id", line.message_line(options).alias("line"))
    return rows.unionByName(images.select("msg_id", line.message_line(options).alias("line")))


@query(
    "F11_summary_line",
    "select msg_id, concat(strftime(make_timestamp(create_epoch * 1000000), '%Y-%m-%d %H:%M:%S'), ' ', chatroom_sender, ': ', "
    "case when length(trim(replace(content, chr(10), ' '))) > 120 then concat(rtrim(left(trim(replace(content, chr(10), ' ')), 120)), '...') "
    "else trim(replace(content, chr(10), ' ')) end) as line from fx_chat",
)
def summary_line(t: Tables) -> DataFrame:
    return chat(t).select("msg_id", line.summary_line(OPTIONS).alias("line"))


@query("F12_skip_flag", ENRICHED + "select msg_id, should_filter as skip from done")
def skip_flag(t: Tables) -> DataFrame:
    return enrichment.enrich(t.fx_xml).select("msg_id", F.col("should_filter").alias("skip"))


@query(
    "F13_masked_secret",
    "select username, case when length(mobile) <= 4 then '***' else concat(left(mobile, 4), '***') end as masked, "
    "case when length(guid) <= 5 then '***' else concat(left(guid, 5), '***') end as masked_guid from fx_contacts",
)
def masked_secret(t: Tables) -> DataFrame:
    return t.fx_contacts.select(
        "username", privacy.mask_secret(F.col("mobile")).alias("masked"),
        privacy.mask_secret(F.col("guid"), 5).alias("masked_guid"),
    )


@query("F14_hashed_field", "select username, left(sha256(mobile), 8) as hashed from fx_contacts")
def hashed_field(t: Tables) -> DataFrame:
    return t.fx_contacts.select("username", privacy.hash_pii(F.col("mobile")).alias("hashed"))


@query(
    "F15_sanitized_columns",
    "select username, left(sha256(mobile), 8) as mobile_hash, case when length(guid) <= 4 then '***' else concat(left(guid, 4), '***') end as \"Token\", sex from fx_contacts",
)
def sanitized_columns(t: Tables) -> DataFrame:
    rows = t.fx_contacts.select("username", "mobile", F.col("guid").alias("Token"), "sex")
    return privacy.sanitize(rows, ["mobile"])


@query(
    "F15_sanitized_map",
    "select username, left(sha256(mobile), 8) as mobile_hash, concat(left(alias, 4), '***') as secret, guid from fx_contacts",
)
def sanitized_map(t: Tables) -> DataFrame:
    values = F.create_map(F.lit("mobile"), "mobile", F.lit("API_Key"), "alias", F.lit("guid"), "guid")
    clean = t.fx_contacts.select("username", privacy.sanitize_map(values, ["mobile"]).alias("m"))
    return clean.select(
        "username", F.col("m")["mobile_hash"].alias("mobile_hash"),
        F.col("m")["API_Key"].alias("secret"), F.col("m")["guid"].alias("guid"),
    )


# -- order and batches --------------------------------------------------------------------


@query(
    "W01_sequence_numbers",
    "select msg_id, chatroom, row_number() over (partition by chatroom order by create_epoch, msg_id) as seq_id from fx_chat",
)
def sequence_numbers(t: Tables) -> DataFrame:
    return sequenced_chat(t).select("msg_id", "chatroom", "seq_id")


@query(
    "W01_sequence_numbers_lake",
    "select msg_id, chatroom, row_number() over (partition by chatroom order by create_time, msg_id) as seq_id from fx_messages",
)
def sequence_numbers_lake(t: Tables) -> DataFrame:
    return sequence.assign_sequence(t.fx_messages).select("msg_id", "chatroom", "seq_id")


@query(
    "W02_filled_ids",
    "select chatroom, content, case when turn % 3 = 1 then concat('auto_', row_number() over (partition by chatroom order by create_epoch, conv_id, turn)) else msg_id end as msg_id from fx_chat",
)
def filled_ids(t: Tables) -> DataFrame:
    from chatlake.operators.skew import number_rows

    holes = chat(t).withColumn("msg_id", F.when(F.col("turn") % 3 != 1, F.col("msg_id")))
    placed = number_rows(holes, ["chatroom"], ["create_epoch", "conv_id", "turn"], "seq_id")
    return sequence.ensure_ids(placed).select("chatroom", "content", "msg_id")


@query(
    "W03_count_batches",
    "select msg_id, (row_number() over (partition by chatroom order by create_epoch, msg_id) - 1) // 6 + 1 as batch_index from fx_chat",
)
def count_batches(t: Tables) -> DataFrame:
    return sequence.batches_by_count(sequenced_chat(t), 6).select("msg_id", "batch_index")


def greedy_sql(rows: str, group: str, budget: int, name: str = "batch_index") -> str:
    """The fold, row by row: ``rows`` is a CTE with the group, ``place``, ``cost`` and ids."""
    return f"""
    , walk as (
      select {group}, place, cost as total, cast(1 as bigint) as {name} from {rows} where place = 1
      union all
      select r.{group.replace(', ', ', r.')}, r.place, case when w.total + r.cost > {budget} then r.cost else w.total + r.cost end,
             case when w.total + r.cost > {budget} then w.{name} + 1 else w.{name} end
      from walk w join {rows} r using ({group}) where r.place = w.place + 1
    )
    """


_COSTED = """
with costed as (
  select msg_id, chatroom, row_number() over (partition by chatroom order by create_epoch, msg_id) as place,
         greatest(1, length(content) // 4) + 1 as cost from fx_chat)
"""


@query(
    "W04_token_batches",
    _COSTED + greedy_sql("costed", "chatroom", SMALL_BUDGET) + "select c.msg_id, batch_index from walk join costed c using (chatroom, place)",
)
def token_batches(t: Tables) -> DataFrame:
    costed = sequenced_chat(t).withColumn("cost", line.estimate_tokens(F.col("content")) + 1)
    rows = sequence.greedy_batches(costed, ["chatroom"], "seq_id", "cost", SMALL_BUDGET)
    return rows.select("msg_id", "batch_index")


@query(
    "W04_token_batches_in_chunks",
    _COSTED + greedy_sql("costed", "chatroom", 900) + "select c.msg_id, batch_index from walk join costed c using (chatroom, place)",
)
def token_batches_in_chunks(t: Tables) -> DataFrame:
    costed = sequenced_chat(t).withColumn("cost", line.estimate_tokens(F.col("content")) + 1)
    rows = sequence.greedy_batches(costed, ["chatroom"], "seq_id", "cost", 900, chunk_rows=16)
    return rows.select("msg_id", "batch_index")


_MEMBERS = """
with found as (
  select t.chatroom, t.topic_no, c.msg_id, c.content, c.create_epoch, c.chatroom_sender, c.from_username, t.pos,
         row_number() over (partition by t.chatroom, t.topic_no order by t.pos) as place,
         count(*) over (partition by t.chatroom, t.topic_no) as n
  from (select chatroom, topic_no, unnest(message_ids) as msg_id, generate_subscripts(message_ids, 1) as pos from fx_topics) t
  join fx_chat c on c.chatroom = t.chatroom and c.msg_id = t.msg_id
)
"""
_SUMMARY_LINE = (
    "concat(strftime(make_timestamp(create_epoch * 1000000), '%Y-%m-%d %H:%M:%S'), ' ', chatroom_sender, ': ', trim(replace(content, chr(10), ' ')))"
)
CHUNKS = _MEMBERS + f"""
, sampled as (select * exclude (place), row_number() over (partition by chatroom, topic_no order by pos) as place
              from found where n <= 3 or (place - 1) % greatest(1, n // 3) = 0)
, costed as (select *, {_SUMMARY_LINE} as line, greatest(1, length({_SUMMARY_LINE}) // 4) + 1 as cost from sampled)
""" + greedy_sql("costed", "chatroom, topic_no", 150, "chunk_index")


@query(
    "W05_summary_chunks",
    CHUNKS + "select chatroom, topic_no, c.msg_id, chunk_index from walk join costed c using (chatroom, topic_no, place)",
)
def summary_chunks(t: Tables) -> DataFrame:
    rows = prompts.summary_chunks(chat_members(t), chat(t), max_messages=3, budget=150)
    return rows.select("chatroom", "topic_no", "msg_id", "chunk_index")


@query(
    "W06_stride_sample",
    _MEMBERS + "select chatroom, topic_no, msg_id, row_number() over (partition by chatroom, topic_no order by pos) as place from found where n <= 3 or (place - 1) % greatest(1, n // 3) = 0",
)
def stride_sample(t: Tables) -> DataFrame:
    from chatlake.operators.skew import number_rows

    topic = ["chatroom", "topic_no"]
    found = number_rows(
        enrichment.topic_messages(chat_members(t), chat(t)), topic, ["pos", "msg_id"], "place"
    )
    return sequence.stride_sample(found, topic, "place", 3).select(*topic, "msg_id", "place")


BATCHED = LINES + """
, costed as (select *, seq_id as place, greatest(1, length(line) // 4) + 1 as cost from lines)
""" + greedy_sql("costed", "chatroom", SMALL_BUDGET) + ", batched as (select c.*, batch_index from walk join costed c using (chatroom, place))\n"


def batched_xml(t: Tables) -> DataFrame:
    return prompts.with_batches(sequenced_xml(t), OPTIONS, SMALL_BUDGET)


@query("W07_batch_of_message", BATCHED + "select msg_id, seq_id, batch_index from batched")
def batch_of_message(t: Tables) -> DataFrame:
    return batched_xml(t).select("msg_id", "seq_id", "batch_index")


GROUPED = BATCHED + """
, grouped as (select chatroom, batch_index, count(*) as total_messages, left(min(stamp), 10) as d1, left(max(stamp), 10) as d2,
              coalesce(string_agg(line, chr(10) order by seq_id) filter (where line <> ''), '') as body from batched group by 1, 2)
, ranged as (select *, case when d1 = d2 then d1 else concat(d1, ' to ', d2) end as date_range from grouped)
"""


@query(
    "K01_batch_prompts",
    GROUPED + """
    select chatroom, batch_index, total_messages, date_range,
      concat('群聊 ID: ', chatroom, chr(10), '群聊名称: ', chr(10), '分析日期范围: ', date_range, chr(10), '消息总数: ', total_messages, chr(10),
             '消息列表(格式: 时间 发送者: 内容):', chr(10), case when body = '' then '（无有效内容）' else body end) as prompt from ranged
    """,
)
def batch_prompts(t: Tables) -> DataFrame:
    rows = prompts.batch_prompts(batched_xml(t), OPTIONS)
    return rows.select("chatroom", "batch_index", "total_messages", "date_range", "prompt")


@query(
    "K02_batch_headers",
    GROUPED + "select chatroom, batch_index, concat('chatroom_id: ', chatroom, chr(10), 'chatroom_name: ', chr(10), 'date_range: ', date_range, chr(10), 'total_messages: ', total_messages) as header from ranged",
)
def batch_headers(t: Tables) -> DataFrame:
    return prompts.batch_prompts(batched_xml(t), OPTIONS).select("chatroom", "batch_index", "header")
