"""Topics: parsing, merging, facts, categories, reports and traces."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.catalog.registry import query
from chatlake.catalog.rooms import BATCHED, CHUNKS, OPTIONS, batched_xml, chat, chat_members, sequenced_chat
from chatlake.functions import topics as fn
from chatlake.functions.responses import register_parse_topics
from chatlake.operators import enrichment
from chatlake.operators import topics as top
from chatlake.plans import analysis, prompts, report
from chatlake.session import cut_lineage
from chatlake.sources.adapters import Tables

TOPIC = ["chatroom", "topic_no"]


def room_members(t: Tables) -> DataFrame:
    """Members of the adapter with three topics per room."""
    return chat_members(t).withColumn("topic_no", F.col("topic_no") % 3)


def _holds(text: str, terms: list[str]) -> list[str]:
    return [f"contains(lower({text}), '{t.lower()}')" if t.isascii() else f"contains({text}, '{t}')" for t in terms]


def _any(text: str, terms: list[str]) -> str:
    return "(" + " or ".join(_holds(text, terms)) + ")"


def _count(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"cast({test} as int)" for test in _holds(text, terms)) + ")"


def _category_case(text: str) -> str:
    cases = [f"when {text} in ({', '.join(repr(c) for c in fn.CATEGORIES)}) then {text}"]
    cases += [f"when {_any(text, words)} then '{name}'" for name, words in fn.CATEGORY_WORDS.items()]
    return f"case {' '.join(cases)} else '{fn.LIFE}' end"


@query(
    "F23_term_matches",
    f"select msg_id, {_any('content', fn.WATCH_TERMS)} as watched, {_count('content', fn.INVEST_TERMS)} as invest_terms from fx_term_chat",
)
def term_matches(t: Tables) -> DataFrame:
    return t.fx_term_chat.select(
        "msg_id", fn.has_term(F.col("content")).alias("watched"),
        fn.term_matches(F.col("content"), fn.INVEST_TERMS).alias("invest_terms"),
    )


@query("F24_category", f"select chatroom, topic_no, {_category_case('category')} as category from fx_topics")
def category(t: Tables) -> DataFrame:
    return t.fx_topics.select(*TOPIC, fn.normalize_category(F.col("category")).alias("category"))


_LISTED = """
with l as (select event_id, concat('"', event_type, '", x', user_id, '，', case when event_id % 3 = 0 then ' ' else concat('''', event_id, '''') end, ',,') as raw from events)
"""


@query(
    "F25_split_list",
    _LISTED + "select event_id, array_to_string(list_filter(list_transform(regexp_split_to_array(raw, '[,，]'), lambda x: trim(trim(trim(x), '\"'), '''')), lambda x: x <> ''), '|') as items from l",
)
def split_list(t: Tables) -> DataFrame:
    tail = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit("'"), "event_id", F.lit("'")))
    raw = F.concat(F.lit('"'), "event_type", F.lit('", x'), "user_id", F.lit("，"), tail, F.lit(",,"))
    return t.table("events").select("event_id", F.array_join(fn.split_list(raw), "|").alias("items"))


_NUMBERS = "with n as (select event_id, case event_id % 4 when 0 then concat('', value) when 1 then concat(' ', event_id, ' ') when 2 then 'n/a' else '-2.7' end as raw from events)\n"


@query(
    "F26_parsed_numbers",
    _NUMBERS + "select event_id, coalesce(cast(trunc(try_cast(trim(raw) as double)) as int), 7) as whole, round(coalesce(try_cast(trim(raw) as double), 1.0), 6) as real from n",
)
def parsed_numbers(t: Tables) -> DataFrame:
    part = F.col("event_id") % 4
    raw = (
        F.when(part == 0, F.col("value").cast("string"))
        .when(part == 1, F.concat(F.lit(" "), "event_id", F.lit(" ")))
        .when(part == 2, "n/a").otherwise("-2.7")
    )
    rows = t.table("events").select("event_id", raw.alias("raw"))
    return rows.select(
        "event_id", fn.parse_int(F.col("raw"), 7).alias("whole"),
        F.round(fn.parse_float(F.col("raw"), 1.0), 6).alias("real"),
    )


@query(
    "F27_parsed_indices",
    """
    with x as (select event_id, [concat(event_id % 7 + 3, '-', event_id % 5), concat('', user_id), 'junk', concat('a-', user_id)] as items from events)
    select event_id, array_to_string(list_concat(generate_series(least(event_id % 7 + 3, event_id % 5), greatest(event_id % 7 + 3, event_id % 5)), [cast(items[2] as bigint)]), ',') as indices from x
    """,
)
def parsed_indices(t: Tables) -> DataFrame:
    first, second = F.col("event_id") % 7 + 3, F.col("event_id") % 5
    items = F.array(
        F.concat(first, F.lit("-"), second), F.col("user_id").cast("string"), F.lit("junk"),
        F.concat(F.lit("a-"), "user_id"),
    )
    return t.table("events").select("event_id", F.array_join(fn.parse_indices(items), ",").alias("indices"))


# Pairs of topics: each topic with the one seven numbers further in its room.
_PAIRS = """
with p as (select a.chatroom, a.topic_no, a.keywords as ka, b.keywords as kb, a.message_count as ma, b.message_count as mb, a.confidence as ca, b.confidence as cb,
                  a.summary as sa, b.summary as sb, a.notes as na, b.notes as nb, a.participants as pa, b.participants as pb
           from fx_term_topics a join fx_term_topics b on a.chatroom = b.chatroom and b.topic_no = a.topic_no + 7)
"""


def _pairs(t: Tables) -> DataFrame:
    names = {"keywords": "k", "message_count": "m", "confidence": "c", "summary": "s", "notes": "n", "participants": "p"}
    left = t.fx_term_topics.select(*TOPIC, *[F.col(n).alias(f"{s}a") for n, s in names.items()])
    right = t.fx_term_topics.select(
        "chatroom", (F.col("topic_no") - 7).alias("topic_no"), *[F.col(n).alias(f"{s}b") for n, s in names.items()]
    )
    return left.join(right, TOPIC)


@query(
    "F28_merged_confidence",
    _PAIRS + "select chatroom, topic_no, round(greatest(0, least(1, (ca * greatest(1, ma) + cb * greatest(1, mb)) / (greatest(1, ma) + greatest(1, mb)))), 6) as confidence from p",
)
def merged_confidence(t: Tables) -> DataFrame:
    score = fn.merge_confidence(F.col("ca"), F.col("ma"), F.col("cb"), F.col("mb"))
    return _pairs(t).select(*TOPIC, F.round(score, 6).alias("confidence"))


@query(
    "F29_merged_notes",
    _PAIRS + "select chatroom, topic_no, case when na = '' then nb when nb = '' or na = nb then na else concat(na, '；', nb) end as notes from p",
)
def merged_notes(t: Tables) -> DataFrame:
    return _pairs(t).select(*TOPIC, fn.merge_notes(F.col("na"), F.col("nb")).alias("notes"))


@query(
    "F30_picked_summary",
    _PAIRS + "select chatroom, topic_no, case when sa = '' then sb when sb = '' then sa when mb > ma then sb when ma > mb then sa when length(sa) >= length(sb) then sa else sb end as summary from p",
)
def picked_summary(t: Tables) -> DataFrame:
    chosen = fn.pick_summary(F.col("sa"), F.col("ma"), F.col("sb"), F.col("mb"))
    return _pairs(t).select(*TOPIC, chosen.alias("summary"))


@query(
    "F31_keyword_display",
    "select chatroom, topic_no, concat('[', array_to_string(keywords[1:5], ', '), case when len(keywords) > 5 then ', ...' else '' end, ']') as shown from fx_room_topics",
)
def keyword_display(t: Tables) -> DataFrame:
    return t.fx_room_topics.select(*TOPIC, fn.keyword_display(F.col("keywords")).alias("shown"))


@query(
    "F32_safe_names",
    "select page_id, coalesce(nullif(trim(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), '_'), ''), 'chatroom') as name from pages",
)
def safe_names(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", fn.safe_name(F.col("url")).alias("name"))


@query(
    "U02_united_lists",
    _PAIRS + "select chatroom, topic_no, array_to_string(list_sort(list_distinct(list_concat(pa, pb))), ',') as participants, array_to_string(list_sort(list_distinct(list_concat(ka, kb))), ',') as keywords from p",
)
def united_lists(t: Tables) -> DataFrame:
    return _pairs(t).select(
        *TOPIC, F.array_join(fn.union_sorted(F.col("pa"), F.col("pb")), ",").alias("participants"),
        F.array_join(fn.union_sorted(F.col("ka"), F.col("kb")), ",").alias("keywords"),
    )


# -- responses ----------------------------------------------------------------------------


_PARSED = """
select conv_id * 1000 + turn as batch_no, concat('room_', conv_id % 7) as chatroom, concat('k', conv_id % 4, ',k', conv_id % 6) as keywords,
       concat('1-', conv_id % 3 + 1) as indices, cast(conv_id % 3 + 1 as int) as message_count, round((conv_id % 9 + 1) / 10.0, 6) as confidence,
       concat('n', conv_id) as notes, '未命名话题' as title, '其他' as category
from conversations
"""


@query("K03_parsed_responses", _PARSED)
def parsed_responses(t: Tables) -> DataFrame:
    rows = top.parse_responses(t.fx_responses)
    return rows.select(
        "batch_no", "chatroom", F.array_join("keywords", ",").alias("keywords"),
        F.array_join("message_indices", ",").alias("indices"), "message_count",
        F.round("confidence", 6).alias("confidence"), "notes", "title", "category",
    )


@query("K03_table_function", _PARSED)
def table_function(t: Tables) -> DataFrame:
    """The same by ``parse_topics`` in SQL."""
    register_parse_topics(t.spark)
    return t.spark.sql(
        """
        select r.batch_no, r.chatroom, array_join(p.keywords, ',') as keywords, array_join(p.message_indices, ',') as indices,
               p.message_count, round(p.confidence, 6) as confidence, p.notes, p.title, p.category
        from {responses} r, lateral parse_topics(r.response) p
        """,
        responses=t.fx_responses,
    )


@query("K03_parse_warnings", "select batch_no, 'no_topic_blocks_found' as warning from fx_responses where batch_no % 4 = 1")
def parse_warnings(t: Tables) -> DataFrame:
    spoiled = t.fx_responses.withColumn(
        "response", F.when(F.col("batch_no") % 4 == 1, "nothing to report").otherwise(F.col("response"))
    )
    return top.parse_warnings(spoiled, ["batch_no"])


_RESOLVED = """
with seq as (select chatroom, msg_id, row_number() over (partition by chatroom order by create_epoch, msg_id) as seq_id from fx_chat),
r as (select conv_id * 1000 + turn as batch_no, concat('room_', conv_id % 7) as chatroom, conv_id % 3 + 1 as hi, conv_id from conversations),
hit as (select r.batch_no, r.chatroom, s.msg_id, s.seq_id, hi, conv_id from r join seq s on s.chatroom = r.chatroom and s.seq_id between 1 and r.hi)
"""


@query("J09_resolved_ids", _RESOLVED + "select batch_no, chatroom, msg_id from hit")
def resolved_ids(t: Tables) -> DataFrame:
    parsed = top.parse_responses(t.fx_responses)
    members = top.resolve_members(parsed, sequenced_chat(t), ["chatroom", "batch_no"])
    return members.select("batch_no", "chatroom", "msg_id")


@query(
    "K04_valid_topics",
    _RESOLVED + "select batch_no, chatroom, count(*) as resolved, cast(max(hi) as int) as message_count from hit group by 1, 2",
)
def valid_topics(t: Tables) -> DataFrame:
    key = ["chatroom", "batch_no"]
    parsed = top.parse_responses(t.fx_responses)
    members = top.resolve_members(parsed, sequenced_chat(t), key)
    return top.valid_topics(parsed, members, key).select(*key, "resolved", "message_count")


# -- merging ------------------------------------------------------------------------------


@query("K05_merged_topics")
def merged_topics(t: Tables) -> DataFrame:
    heads = t.fx_term_topics.drop("message_ids")
    rows, members = top.merge_topics_and_members(heads, chat_members(t))
    sizes = members.groupBy(*TOPIC).agg(F.count(F.lit(1)).alias("ids"))
    return rows.join(sizes, TOPIC).select(
        *TOPIC, "title", "message_count", F.round("confidence", 6).alias("confidence"), "notes",
        F.array_join("keywords", ",").alias("keywords"), "ids",
    )


@query(
    "K06_merged_same_keywords",
    """
    with k as (select *, array_to_string(list_sort(list_distinct(list_transform(keywords, lambda x: lower(x)))), '|') as merge_key from fx_topics),
    i as (select distinct chatroom, merge_key, unnest(message_ids) as id from k),
    p as (select distinct chatroom, merge_key, unnest(participants) as who from k)
    select h.chatroom, h.merge_key, topics, confidence, message_count, participants from
      (select chatroom, merge_key, count(*) as topics, round(sum(confidence * message_count) / sum(message_count), 6) as confidence from k group by 1, 2) h
      join (select chatroom, merge_key, count(*) as message_count from i group by 1, 2) c using (chatroom, merge_key)
      join (select chatroom, merge_key, string_agg(who, ',' order by who) as participants from p group by 1, 2) w using (chatroom, merge_key)
    """,
)
def merged_same_keywords(t: Tables) -> DataFrame:
    rows = top.merge_same_keywords(t.fx_topics)
    return rows.select(
        "chatroom", "merge_key", "topics", F.round("confidence", 6).alias("confidence"),
        "message_count", F.array_join("participants", ",").alias("participants"),
    )


# The topics of this table share five of six words, so each room ends up with one topic.
@query(
    "K07_merge_log",
    """
    with o as (select chatroom, topic_no, row_number() over (partition by chatroom order by message_count desc, topic_no) as p from fx_room_topics),
    w as (select c.chatroom, c.topic_no, a.topic_no as kept_no, c.p, b.topic_no as mid from o c join o a on a.chatroom = c.chatroom and a.p = 1
          left join o b on b.chatroom = c.chatroom and b.p = 2 where c.p > 1)
    select chatroom, topic_no, kept_no, case when p = 2 then concat('merge=[r', kept_no, ', s, t, u, v, ...] <- [r', topic_no, ', s, t, u, v, ...]; keyword_sim=0.83; reason=keyword_similarity')
      else concat('merge=[r', least(kept_no, mid), ', r', greatest(kept_no, mid), ', s, t, u, ...] <- [r', topic_no, ', s, t, u, v, ...]; keyword_sim=0.71; reason=keyword_similarity') end as log from w
    """,
)
def merge_log(t: Tables) -> DataFrame:
    return report.merge_report(top.assign_merges(t.fx_room_topics))


@query(
    "X01_own_merge_rule",
    """
    select chatroom, topic_no, kept_no, case when topic_no = kept_no then 0 else 1 end as merged from (
      select chatroom, topic_no, first_value(topic_no) over (partition by chatroom, keywords[1] order by message_count desc, topic_no) as kept_no from fx_topics)
    """,
)
def own_merge_rule(t: Tables) -> DataFrame:
    first_word_of_all = t.fx_topics.withColumn("keywords", F.slice("keywords", 1, 1))
    rows = top.assign_merges(first_word_of_all, should_merge=lambda kept, new: kept[0] == new[0])
    return rows.select(*TOPIC, "kept_no", F.when(F.col("step") > 0, 1).otherwise(0).alias("merged"))


@query(
    "T07_merge_order",
    "select chatroom, topic_no, row_number() over (partition by chatroom order by message_count desc, topic_no) as place from fx_topics",
)
def merge_order(t: Tables) -> DataFrame:
    from chatlake.operators.skew import number_rows

    sized = t.fx_topics.withColumn("_less", -F.col("message_count"))
    return number_rows(sized, ["chatroom"], ["_less", "topic_no"], "place").select(*TOPIC, "place")


# -- facts --------------------------------------------------------------------------------

_FOUND = """
with m as (
  select t.chatroom, t.topic_no, c.*  exclude (chatroom), row_number() over (partition by t.chatroom, t.topic_no order by t.pos) as place
  from (select chatroom, topic_no, unnest(message_ids) as msg_id, generate_subscripts(message_ids, 1) as pos from fx_term_topics) t
  join fx_term_chat c on c.chatroom = t.chatroom and c.msg_id = t.msg_id
), f as (
  select chatroom, topic_no, count(*) as found, count(*) filter (where place <= 200 and WATCH) as wm, count(*) filter (where place <= 200 and INVEST) as im,
         make_timestamp(min(create_epoch) * 1000000) as t0, make_timestamp(max(create_epoch) * 1000000) as t1,
         string_agg(distinct chatroom_sender, ',' order by chatroom_sender) as people
  from m group by 1, 2
), judged as (
  select t.*, found, wm, im, (WTITLE or WSUMMARY or (KW / (greatest(1, len(keywords)) * 1.0) >= 0.3 and coalesce(wm, 0) >= 2)
         or (coalesce(wm, 0) >= 5 and wm / (greatest(1, found) * 1.0) >= 0.06)) as is_watch,
         (ITEXT or coalesce(im, 0) >= 2) as is_invest
  from fx_term_topics t left join f using (chatroom, topic_no)
), days as (
  select chatroom, topic_no, cast(make_timestamp(create_epoch * 1000000) as date) as d, count(*) as n from m group by 1, 2, 3
), prime as (
  select chatroom, topic_no, strftime(d, '%Y-%m-%d') as primary_date from days qualify row_number() over (partition by chatroom, topic_no order by n desc, d) = 1
)
"""
for _mark, _text in {
    "WATCH)": _any("content", fn.WATCH_TERMS) + ")",
    "INVEST)": _any("content", fn.INVEST_TERMS) + ")",
    "WTITLE": _any("title", fn.WATCH_TERMS),
    "WSUMMARY": _any("summary", fn.WATCH_TERMS),
    "KW": _count("array_to_string(keywords, ' ')", fn.WATCH_TERMS),
    "ITEXT": _any("concat_ws(' ', array_to_string(keywords, ' '), title, summary)", fn.INVEST_TERMS),
}.items():
    _FOUND = _FOUND.replace(_mark, _text)
# the customary form searches the first messages of a topic only
_LEADING, _FOUND = _FOUND, _FOUND.replace("place <= 200 and ", "")


def term_chat(t: Tables) -> DataFrame:
    return t.fx_term_chat.withColumn("create_time", F.timestamp_seconds("create_epoch"))


@query(
    "A15_room_ranges",
    """
    with r as (select chatroom, make_timestamp(min(create_epoch) * 1000000) as t0, make_timestamp(max(create_epoch) * 1000000) as t1 from fx_chat group by 1)
    select chatroom, case when cast(t0 as date) = cast(t1 as date) then strftime(t0, '%Y-%m-%d') else concat(strftime(t0, '%Y-%m-%d'), ' to ', strftime(t1, '%Y-%m-%d')) end as date_range,
           case when second(t0) > 0 or second(t1) > 0 then concat(strftime(t0, '%H:%M:%S'), '-', strftime(t1, '%H:%M:%S')) else concat(strftime(t0, '%H:%M'), '-', strftime(t1, '%H:%M')) end as time_range from r
    """,
)
def room_ranges(t: Tables) -> DataFrame:
    from chatlake.functions import text as line

    first, last = F.min("create_time"), F.max("create_time")
    return chat(t).groupBy("chatroom").agg(
        line.date_range(first, last).alias("date_range"), line.time_range(first, last).alias("time_range")
    )


@query(
    "A15_sender_ranges",
    """
    with r as (select from_username, min(create_time) as t0, max(create_time) as t1 from fx_messages group by 1)
    select from_username, case when second(t0) > 0 or second(t1) > 0 then concat(strftime(t0, '%H:%M:%S'), '-', strftime(t1, '%H:%M:%S')) else concat(strftime(t0, '%H:%M'), '-', strftime(t1, '%H:%M')) end as time_range from r
    """,
)
def sender_ranges(t: Tables) -> DataFrame:
    from chatlake.functions import text as line

    span = line.time_range(F.min("create_time"), F.max("create_time"))
    return t.fx_messages.groupBy("from_username").agg(span.alias("time_range"))


@query(
    "A16_participants",
    "select chatroom, string_agg(distinct coalesce(nullif(chatroom_sender, ''), from_username), ',' order by coalesce(nullif(chatroom_sender, ''), from_username)) as participants from fx_chat group by 1",
)
def participants(t: Tables) -> DataFrame:
    people = F.array_sort(F.collect_set(top.participants_of()))
    return t.fx_chat.groupBy("chatroom").agg(F.array_join(people, ",").alias("participants"))


@query("A17_primary_dates", _FOUND + "select * from prime")
def primary_dates(t: Tables) -> DataFrame:
    return top.primary_dates(chat_members(t), term_chat(t))


_POPULAR = """
with p as (select *, len(list_distinct(participants)) as u from fx_room_topics),
s as (select *, pow(ln(1 + u), 1.2) * pow(ln(1 + message_count), 0.8) / pow(1 + greatest(0, message_count / (u * 1.0) - 6), 0.4) as popularity from p)
"""


@query("A18_popularity", _POPULAR + "select chatroom, topic_no, round(popularity, 6) as popularity from s")
def popularity(t: Tables) -> DataFrame:
    rows = top.with_popularity(t.fx_room_topics)
    return rows.select(*TOPIC, F.round("popularity", 6).alias("popularity"))


@query("A19_popular_topics", _POPULAR + "select chatroom, topic_no from s where popularity > 5.0")
def popular_topics(t: Tables) -> DataFrame:
    return top.popular(t.fx_room_topics).select(*TOPIC)


@query(
    "T05_report_order",
    _POPULAR + "select chatroom, topic_no, cast(row_number() over (partition by chatroom order by popularity desc, message_count desc, topic_no) as int) as rank from s where popularity > 5.0",
)
def report_order(t: Tables) -> DataFrame:
    return top.ranked(t.fx_room_topics).select(*TOPIC, "rank")


@query("K08_watched_topics", _FOUND + "select chatroom, topic_no, is_watch from judged")
def watched_topics(t: Tables) -> DataFrame:
    joined = t.fx_term_topics.join(top.term_facts(chat_members(t), term_chat(t)), TOPIC, "left")
    return joined.select(*TOPIC, top.is_watch_topic().alias("is_watch"))


@query(
    "K08_watched_topics_leading", _LEADING + "select chatroom, topic_no, is_watch, coalesce(wm, 0)::bigint as mentions from judged"
)
def watched_topics_leading(t: Tables) -> DataFrame:
    facts = top.term_facts(chat_members(t), term_chat(t), top.LEADING_MESSAGES)
    joined = t.fx_term_topics.join(facts, TOPIC, "left")
    return joined.select(
        *TOPIC, top.is_watch_topic().alias("is_watch"), F.coalesce("watch_mentions", F.lit(0)).alias("mentions")
    )


@query("K09_investment_topics", _FOUND + "select chatroom, topic_no, is_invest from judged")
def investment_topics(t: Tables) -> DataFrame:
    joined = t.fx_term_topics.join(top.term_facts(chat_members(t), term_chat(t)), TOPIC, "left")
    return joined.select(*TOPIC, top.looks_like_investment().alias("is_invest"))


@query(
    "K10_final_categories",
    _FOUND + f"""
    , c as (select *, {_category_case('category')} as normal from judged)
    select chatroom, topic_no, case when is_watch then '{fn.WATCH}' when normal = '{fn.WATCH}' then case when is_invest then '{fn.INVEST}' else '{fn.LIFE}' end else normal end as category from c
    """,
)
def final_categories(t: Tables) -> DataFrame:
    return top.with_categories(t.fx_term_topics, chat_members(t), term_chat(t)).select(*TOPIC, "category")


@query(
    "K11_collapsed_topics",
    _FOUND + """
    , g as (select j.*, case when is_watch then coalesce(primary_date, 'unknown') end as gd from judged j left join prime using (chatroom, topic_no)),
    w as (select chatroom, gd, count(*) as n, min(topic_no) as topic_no, max(confidence) as confidence, string_agg(notes, '；' order by topic_no) as ns from g where is_watch group by 1, 2),
    ids as (select chatroom, gd, count(distinct id) as ids from (select chatroom, gd, unnest(message_ids) as id from g where is_watch) group by 1, 2),
    kws as (select chatroom, gd, string_agg(distinct k, ',' order by k) as keywords from (select chatroom, gd, unnest(keywords) as k from g where is_watch) group by 1, 2)
    select g.chatroom, g.topic_no, title, message_count, round(g.confidence, 6) as confidence, notes, array_to_string(keywords, ',') as keywords
    from g left join w on w.chatroom = g.chatroom and w.gd = g.gd where coalesce(w.n, 1) = 1
    union all
    select w.chatroom, w.topic_no, '未命名话题', ids, round(confidence, 6), concat('合并同日迪子话题；', ns), keywords
    from w join ids using (chatroom, gd) join kws using (chatroom, gd) where n > 1
    """,
)
def collapsed_topics(t: Tables) -> DataFrame:
    members = chat_members(t)
    rows, _ = top.collapse_watch_topics(t.fx_term_topics, members, term_chat(t))
    return rows.select(
        *TOPIC, "title", "message_count", F.round("confidence", 6).alias("confidence"), "notes",
        F.array_join("keywords", ",").alias("keywords"),
    )


@query(
    "K12_topic_facts",
    _FOUND + """
    select chatroom, topic_no, found, people as participants, case when second(t0) > 0 or second(t1) > 0 then concat(strftime(t0, '%H:%M:%S'), '-', strftime(t1, '%H:%M:%S'))
      else concat(strftime(t0, '%H:%M'), '-', strftime(t1, '%H:%M')) end as time_range from f
    """,
)
def topic_facts(t: Tables) -> DataFrame:
    rows = top.topic_facts(chat_members(t), term_chat(t))
    return rows.select(*TOPIC, "found", F.array_join("participants", ",").alias("participants"), "time_range")


# -- summaries ----------------------------------------------------------------------------


@query(
    "K13_summary_prompts",
    CHUNKS + """
    , g as (select chatroom, topic_no, chunk_index, count(*) as total_messages, string_agg(line, chr(10) order by place) as body
            from walk join costed c using (chatroom, topic_no, place) group by 1, 2, 3),
    r as (select chatroom, strftime(make_timestamp(min(create_epoch) * 1000000), '%Y-%m-%d') as d1, strftime(make_timestamp(max(create_epoch) * 1000000), '%Y-%m-%d') as d2 from fx_chat group by 1)
    select g.chatroom, g.topic_no, chunk_index, max(chunk_index) over (partition by g.chatroom, g.topic_no) as chunk_total, total_messages,
      concat('群聊 ID: ', g.chatroom, chr(10), '群聊名称: ', chr(10), '分析日期范围: ', case when d1 = d2 then d1 else concat(d1, ' to ', d2) end, chr(10),
             '关键词: ', array_to_string(t.keywords, ', '), chr(10), '分段: ', chunk_index, '/', max(chunk_index) over (partition by g.chatroom, g.topic_no), chr(10),
             '片段消息数: ', total_messages, chr(10), chr(10), '消息列表(格式: 时间 发送者: 内容):', chr(10), body) as prompt
    from g join fx_topics t on t.chatroom = g.chatroom and t.topic_no = g.topic_no join r on r.chatroom = g.chatroom
    """,
)
def summary_prompts(t: Tables) -> DataFrame:
    chunks = prompts.summary_chunks(chat_members(t), chat(t), max_messages=3, budget=150)
    rows = prompts.summary_prompts(chunks, t.fx_topics, room_ranges(t))
    return rows.select(*TOPIC, "chunk_index", "chunk_total", "total_messages", "prompt")


_SUMMED = """
with s as (select *, row_number() over (partition by chatroom, topic_no order by chunk_index) as i from fx_chunk_summaries where summary <> ''),
n as (select *, row_number() over (partition by chatroom, topic_no order by chunk_index) as i from fx_chunk_summaries where notes <> ''),
sg as (select chatroom, topic_no, count(*) as chunk_total, string_agg(concat('[', i, '] ', summary), chr(10) order by i) as st, string_agg(summary, '；' order by i) as joined from s group by 1, 2),
ng as (select chatroom, topic_no, string_agg(concat('[', i, '] ', notes), chr(10) order by i) as nt, string_agg(notes, '；' order by i) as nj from n group by 1, 2)
"""


@query(
    "K14_merged_summaries",
    _SUMMED + "select chatroom, topic_no, cast(chunk_total as int) as chunk_total, concat(st, case when nt is null then '' else concat(chr(10), chr(10), '补充说明:', chr(10), nt) end) as chunk_summaries from sg left join ng using (chatroom, topic_no)",
)
def merged_summaries(t: Tables) -> DataFrame:
    return prompts.merged_summary_prompts(t.fx_chunk_summaries)


@query(
    "K15_fallback_texts",
    _SUMMED + "select t.chatroom, t.topic_no, case when topic_no % 2 = 0 then 'given' else coalesce(joined, '') end as summary, coalesce(nj, '') as notes, "
    "case when topic_no % 3 = 0 then concat('话题', topic_no) else array_to_string(keywords[1:3], ' / ') end as title, '其他' as category "
    "from fx_topics t left join sg using (chatroom, topic_no) left join ng using (chatroom, topic_no)",
)
def fallback_texts(t: Tables) -> DataFrame:
    def ordered(name: str):
        items = F.array_sort(F.collect_list(F.when(F.col(name) != "", F.struct("chunk_index", name))))
        return F.transform(items, lambda e: e[name])

    chunks = t.fx_chunk_summaries.groupBy(*TOPIC).agg(
        ordered("summary").alias("chunk_summaries"), ordered("notes").alias("chunk_notes")
    )
    even = F.col("topic_no") % 2 == 0
    base = t.fx_topics.join(chunks, TOPIC, "left").withColumns(
        {
            "summary": F.when(even, "given").otherwise(""), "notes": F.lit(""), "title": F.lit(""), "category": F.lit(""),
            "keywords": F.when(F.col("topic_no") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("keywords")),
            "topic_index": F.col("topic_no"),
        }
    )
    return report.with_fallbacks(base).select(*TOPIC, "summary", "notes", "title", "category")


# -- trace and report ---------------------------------------------------------------------


def _batched(t: Tables) -> DataFrame:
    """Batched messages, written once because a trace reads them several times."""
    return cut_lineage(batched_xml(t))


_TRACED = BATCHED + """
, traced as (select b.chatroom, b.msg_id, b.seq_id, b.batch_index, b.stamp, b.chatroom_sender as sender, b.create_epoch,
    case when b.should_filter then concat('[', b.seq_id, '] ', b.stamp, ' ', b.chatroom_sender, ': [已过滤]') else b.line end as display_content,
    case when b.should_filter then 'filtered' when b.appmsg_type in (4, 5) then 'share' when b.svrid is not null then 'quote' else 'text' end as message_type,
    q.seq_id as refers_to, b.url as share_url, concat(b.stamp, ' ', b.chatroom_sender, ': ', case when length(trim(b.content)) > 120 then concat(rtrim(left(trim(b.content), 120)), '...') else trim(b.content) end) as summary_line
  from batched b left join batched q on q.chatroom = b.chatroom and q.msg_id = nullif(b.svrid, ''))
"""


@query(
    "K16_trace_messages",
    _TRACED + "select msg_id, seq_id, batch_index, stamp as time_str, sender, display_content, message_type, coalesce(refers_to, 0) as refers_to, coalesce(share_url, '') as share_url from traced",
)
def trace_messages(t: Tables) -> DataFrame:
    rows = report.trace_messages(_batched(t), t.fx_images, OPTIONS)
    return rows.select(
        "msg_id", "seq_id", "batch_index", "time_str", "sender", "display_content", "message_type",
        F.coalesce("refers_to_seq_id", F.lit(0)).alias("refers_to"), F.coalesce("share_url", F.lit("")).alias("share_url"),
    )


@query(
    "K16_trace_topics",
    _TRACED + """
    , tm as (select t.chatroom, t.topic_no, r.msg_id, r.seq_id, greatest(1, length(summary_line) // 4) + 1 as cost,
             row_number() over (partition by t.chatroom, t.topic_no order by seq_id) as place
             from (select chatroom, topic_no, unnest(message_ids) as msg_id from fx_topics) t join traced r on r.chatroom = t.chatroom and r.msg_id = t.msg_id)
    , step as (select chatroom, topic_no, place, cost as total, cast(1 as bigint) as chunk from tm where place = 1
               union all select r.chatroom, r.topic_no, r.place, case when w.total + r.cost > 60 then r.cost else w.total + r.cost end, case when w.total + r.cost > 60 then w.chunk + 1 else w.chunk end
               from step w join tm r on r.chatroom = w.chatroom and r.topic_no = w.topic_no and r.place = w.place + 1)
    select chatroom, topic_no, msg_id, seq_id, chunk as batch_index from step join tm using (chatroom, topic_no, place)
    """,
)
def trace_topics(t: Tables) -> DataFrame:
    trace = report.trace_messages(_batched(t), t.fx_images, OPTIONS)
    rows = report.trace_topic_messages(chat_members(t), trace, 60)
    return rows.select(*TOPIC, "msg_id", "seq_id", "batch_index")


@query(
    "K16_trace_rooms",
    _TRACED + "select chatroom, count(*) as total_messages, max(batch_index) as batch_count, (select count(*) from fx_topics t where t.chatroom = traced.chatroom) as topics, "
    "min(create_epoch) as first_epoch, max(create_epoch) as last_epoch from traced group by chatroom",
)
def trace_rooms(t: Tables) -> DataFrame:
    return report.trace_rooms(report.trace_messages(_batched(t), t.fx_images, OPTIONS), t.fx_topics)


@query(
    "T06_topic_message_order",
    _TRACED + """
    , tm as (select t.chatroom, t.topic_no, r.msg_id, r.seq_id from (select chatroom, topic_no, unnest(message_ids) as msg_id from fx_topics) t join traced r on r.chatroom = t.chatroom and r.msg_id = t.msg_id)
    select chatroom, topic_no, msg_id, row_number() over (partition by chatroom, topic_no order by seq_id) as place from tm
    """,
)
def topic_message_order(t: Tables) -> DataFrame:
    from chatlake.operators.skew import number_rows

    rows = enrichment.topic_messages(chat_members(t), batched_xml(t))
    return number_rows(rows, TOPIC, ["seq_id"], "place").select(*TOPIC, "msg_id", "place")


@query(
    "K17_trace_export",
    _TRACED + """
    , tm as (select t.chatroom, t.topic_no, t.title, r.*  exclude (chatroom), row_number() over (partition by t.chatroom, t.topic_no order by seq_id) as place
             from (select chatroom, topic_no, title, unnest(message_ids) as msg_id from fx_room_topics) t join traced r on r.chatroom = t.chatroom and r.msg_id = t.msg_id)
    select concat(chatroom, '_', topic_no) as topic_key, (place - 1) // 10 + 1 as part,
      concat('{"title":"', any_value(title), '","chatroom_id":"', chatroom, '","messages":[', string_agg(concat('{"seq_id":', seq_id, ',"time_str":"', stamp, '","sender":"', sender, '","display_content":', cast(to_json(display_content) as varchar),
        ',"message_type":"', message_type, '","batch_index":', batch_index, ',"refers_to_seq_id":', coalesce(cast(refers_to as varchar), 'null'), ',"ocr_content":null,"has_text":null,"image_url":null,"image_status":null,"share_url":',
        case when share_url is null then 'null' else concat('"', share_url, '"') end, '}'), ',' order by seq_id), ']}') as json
    from tm group by chatroom, topic_no, (place - 1) // 10
    """,
)
def trace_export(t: Tables) -> DataFrame:
    trace = report.trace_messages(_batched(t), t.fx_images, OPTIONS)
    rows = report.trace_topic_messages(room_members(t), trace, None)
    return report.trace_export(rows, t.fx_room_topics, 10)


@query(
    "K18_report_rows",
    _POPULAR + """
    , r as (select *, row_number() over (partition by chatroom order by popularity desc, message_count desc, topic_no) as rank from s where popularity > 5.0),
    rooms as (select distinct chatroom from fx_chat union all select 'quiet_room')
    select rooms.chatroom, cast(coalesce(rank, 0) as int) as rank, case when rank is null then '无热门话题。' else concat('## ', title) end as heading,
      case when rank is null then '' else concat('🏷️ ', category, ' 🔥 ', printf('%.2f', popularity), ' 💬 ', message_count, ' 👥 ', len(participants)) end as label,
      case when rank is null then '' when time_range = '' then '🕒 -' else '🕒 10:00-11:30' end as times,
      case when rank is null then '' else concat('📝 ', trim(summary)) end as body
    from rooms left join r on r.chatroom = rooms.chatroom
    """,
)
def report_rows(t: Tables) -> DataFrame:
    quiet = t.spark.range(1).select(F.lit("quiet_room").alias("chatroom"))
    return report.report_rows(t.fx_room_topics, t.fx_chat.select("chatroom").unionByName(quiet))


@query(
    "K19_topic_debug",
    """
    select chatroom, topic_no, concat('<<<TOPIC>>>', chr(10), 'keywords:', chr(10), '- ', array_to_string(keywords, chr(10) || '- '), chr(10), 'participants:', chr(10), '- ', array_to_string(participants, chr(10) || '- '), chr(10),
      'message_ids:', chr(10), '- ', array_to_string(message_ids, chr(10) || '- '), chr(10), 'message_count: ', message_count, chr(10), 'confidence: ', confidence, chr(10), 'notes: ', notes) as block
    from fx_term_topics
    """,
)
def topic_debug(t: Tables) -> DataFrame:
    return report.topic_debug(t.fx_term_topics)


@query(
    "K19_summary_debug",
    """
    with c as (select s.*, count(*) over (partition by s.chatroom, s.topic_no) as n, keywords from fx_chunk_summaries s join fx_topics t using (chatroom, topic_no))
    select chatroom, topic_no, chunk_index, trim(concat('topic_index: ', topic_no, chr(10), 'chunk_index: ', chunk_index, '/', n, chr(10), 'keywords: ', array_to_string(keywords, ', '), chr(10), 'summary: ', summary,
      case when notes <> '' then concat(chr(10), 'notes: ', notes) else '' end)) as block from c
    """,
)
def summary_debug(t: Tables) -> DataFrame:
    totals = t.fx_chunk_summaries.groupBy(*TOPIC).agg(F.count(F.lit(1)).alias("chunk_total"))
    rows = t.fx_chunk_summaries.join(totals, TOPIC).join(t.fx_topics.select(*TOPIC, "keywords"), TOPIC)
    return report.chunk_debug(rows)


@query(
    "K19_merged_debug",
    """
    select chatroom, topic_no, trim(concat('topic_index: ', topic_no, chr(10), 'keywords: ', array_to_string(keywords, ', '), chr(10), 'title: ', title, chr(10), 'category: ', category, chr(10), 'summary: ', summary,
      chr(10), 'notes: ', notes)) as block from fx_term_topics
    """,
)
def merged_debug(t: Tables) -> DataFrame:
    return report.merged_debug(t.fx_term_topics)


# -- whole runs ---------------------------------------------------------------------------


def counting_model() -> Callable[[str], str]:
    """A stand-in model: one topic per prompt over its first messages, plus one on senders."""

    def answer(prompt: str) -> str:
        room = re.search(r"群聊 ID: (\S+)", prompt).group(1)
        people = sorted(set(re.findall(r"^[-\d]+ [:\d]+ (\S+): ", prompt, re.MULTILINE)))
        listed = "".join(f"- {name}\n" for name in people)
        if "消息总数" not in prompt:
            return "<<<RESULT_START>>>\n<<<TOPIC>>>\nsummary: talk\nnotes: seen\n<<<RESULT_END>>>"
        total = int(re.search(r"消息总数: (\d+)", prompt).group(1))
        return (
            f"<<<RESULT_START>>>\n<<<TOPIC>>>\nkeywords:\n- {room}\n- all\n- chat\nparticipants:\n{listed}message_indices:\n- 1-{total}\n"
            f"message_count: {total}\nconfidence: 0.9\nnotes: whole batch\n"
            f"<<<TOPIC>>>\nkeywords: odd, few\nmessage_indices: 1, 3, 999999\nconfidence: 0.5\n<<<RESULT_END>>>"
        )

    return answer


@query(
    "X02_model_call",
    BATCHED + "select chatroom, batch_index, count(*) as total_messages from batched group by 1, 2",
)
def model_call(t: Tables) -> DataFrame:
    asked = prompts.batch_prompts(batched_xml(t), OPTIONS)
    answered = prompts.invoke(asked, counting_model, ["chatroom", "batch_index"])
    topics = top.parse_responses(answered).filter(F.col("notes") == "whole batch")
    return topics.select("chatroom", "batch_index", F.col("message_count").cast("long").alias("total_messages"))


@query("K20_room_analysis")
def room_analysis(t: Tables) -> DataFrame:
    from chatlake.catalog.enrichment import xml_messages

    messages = xml_messages(t).withColumn("is_chatroom_msg", F.lit(1))
    settings = analysis.Settings(lines=OPTIONS, max_input_tokens=400)
    span = messages.agg(*[F.date_format(f("create_time"), "yyyy-MM-dd") for f in (F.min, F.max)]).first()
    picked = analysis.select_messages(messages, *(day or "2024-01-01" for day in span))
    return analysis.analyze(picked, counting_model, t.fx_images, settings)["report"]
