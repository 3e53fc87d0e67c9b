"""Adapters that shape the given tables like chat data.

Each adapter is one SELECT that Spark and DuckDB both accept, so a query and its
check start from the same rows. ``views()`` builds them lazily over a table directory.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTERS: dict[str, str] = {
    "fx_messages": """
select concat('evt_', event_id) as msg_id,
       concat('user_', user_id) as from_username,
       'svc' as to_username,
       case when event_id % 3 = 0 then concat('room_', event_id % 5) else '' end as chatroom,
       case when event_id % 3 = 0 then concat('user_', user_id) else '' end as chatroom_sender,
       cast(case event_type when 'click' then 1 when 'view' then 3 when 'purchase' then 49
                            when 'error' then 10000 else 47 end as int) as msg_type,
       date_trunc('second', ts) as create_time,
       cast(case when event_id % 3 = 0 then 1 else 0 end as int) as is_chatroom_msg,
       concat(event_type, ' ', coalesce(props, '')) as content,
       case when event_id % 5 = 0 then concat('d', event_id) else '' end as descr,
       concat('', event_id % 3) as source,
       concat('g_', event_id) as guid,
       1010 as notify_type
from events
""",
    "fx_duplicates": """
select 1 as copy, m.* from fx_messages m
union all
select 2 as copy, m.* from fx_messages m where cast(substr(m.msg_id, 5) as bigint) % 20 = 0
""",
    "fx_raw_lines": """
select event_id as line_no,
       case when event_id % 50 = 7 then '{bad'
            when event_id % 50 = 9 then ''
            when event_id % 50 = 11 then concat('{"guid":"g', event_id, '","notify_type":1010,"data":{"msg_id":"m', event_id, '"}}')
            when event_id % 50 = 13 then concat('{"msg_id":"m', event_id, '","from_username":"u', user_id, '","to_username":"svc","msg_type":1,"create_time":', 1704067200 + event_id, ',"is_chatroom_msg":0,"source":7,"guid":"g","notify_type":1010,"content":null}')
            else concat('{"guid":"g', event_id, '","notify_type":1010,"data":{"msg_id":"m', event_id, '","from_username":"u', user_id, '","to_username":"svc","msg_type":', event_id % 4 + 1, ',"create_time":', 1704067200 + event_id * 60, ',"is_chatroom_msg":', event_id % 2, ',"source":"s","content":"c', event_id, '"}}')
       end as value
from events
""",
    "fx_lines": """
select line_no, case when line_no % 50 = 21 then replace(value, '"msg_type":', '"msg_type":0.5') when line_no % 50 = 23 then '[1]' else value end as value
from fx_raw_lines
""",
    "fx_chat": """
select concat('c', conv_id, '_', turn) as msg_id,
       concat('room_', conv_id % 7) as chatroom,
       concat(role, '_', conv_id % 5) as chatroom_sender,
       role as from_username,
       1704067200 + conv_id * 3600 + turn * 60 as create_epoch,
       conv_id, turn,
       text as content,
       cast(1 as int) as msg_type
from conversations
""",
    "fx_xml": """
select msg_id, chatroom, chatroom_sender, create_epoch, conv_id, turn,
       cast(case when (conv_id + turn) % 9 = 6 then 3 else 49 end as int) as msg_type,
       case (conv_id + turn) % 9
         when 0 then concat('<msg><appmsg><title>t', conv_id, '</title><type>57</type><refermsg><svrid>c', conv_id, '_', turn - 1, '</svrid><type>1</type><displayname>n', conv_id % 5, '</displayname><content>quoted text number ', conv_id, ' of some length</content><createtime>', create_epoch, '</createtime></refermsg></appmsg></msg>')
         when 1 then concat('<msg><appmsg><title>t', conv_id, '</title><type>5</type><des>d', conv_id, '</des><url>http://h/', conv_id, '</url></appmsg></msg>')
         when 2 then '<msg><appmsg><title>m</title><type>3</type></appmsg></msg>'
         when 3 then '<msg><emoji md5="a" len="1"/></msg>'
         when 4 then '<sysmsg type="revokemsg"><revokemsg><session>s</session></revokemsg></sysmsg>'
         when 5 then '<msg><op id="5"><name>lastMessage</name></op></msg>'
         when 6 then concat('<?xml version="1.0"?><msg><img aeskey="k', conv_id, '" cdnmidimgurl="u', turn, '" encryver="1" length="12"/></msg>')
         when 7 then '<msg><appmsg><title>r</title><type>1</type><refermsg><svrid>x</svrid></refermsg></appmsg></msg>'
         else 'plain text, not xml <' end as content
from fx_chat
""",
    "fx_images": """
select concat('a', conv_id, '-', turn) as image_id, msg_id, chatroom_sender as from_username,
       case when conv_id % 4 = 0 then 'pending' when conv_id % 4 = 3 then 'failed' else 'completed' end as status,
       case when conv_id % 4 in (1, 2) then concat('http://i/', conv_id) end as download_url,
       case when conv_id % 4 = 3 then 'Error code: 1' end as error_message,
       case when conv_id % 4 = 1 then concat('text ', conv_id) end as ocr_content,
       case when conv_id % 4 = 1 then true end as has_text,
       create_epoch as extracted_epoch
from fx_xml where msg_type = 3
""",
    "fx_image_refs": """
select x.msg_id, x.chatroom, x.create_epoch, concat('image#', i.image_id) as content
from fx_xml x join fx_images i on x.msg_id = i.msg_id
""",
    "fx_topics": """
select chatroom, conv_id as topic_no,
       split(concat('k', conv_id % 4, ',k', conv_id % 6, ',w', conv_id % 9), ',') as keywords,
       array_sort(array_agg(distinct chatroom_sender)) as participants,
       array_sort(array_agg(msg_id)) as message_ids,
       count(*) as message_count,
       cast(conv_id % 10 as double) / 10 as confidence,
       case conv_id % 5 when 0 then '财经' when 1 then '国际新闻' when 2 then '' when 3 then '工作生活' else '迪子' end as category
from fx_chat group by chatroom, conv_id
""",
    "fx_responses": """
select conv_id * 1000 + turn as batch_no, concat('room_', conv_id % 7) as chatroom,
       concat('noise', chr(10), '<<<RESULT_START>>>', chr(10), '<<<TOPIC>>>', chr(10),
              'keywords:', chr(10), '- k', conv_id % 4, chr(10), '- k', conv_id % 6, chr(10),
              'message_indices:', chr(10), '- 1-', conv_id % 3 + 1, chr(10),
              'message_count: ', conv_id % 3 + 1, chr(10), 'confidence: 0.', conv_id % 9 + 1, chr(10),
              'notes: n', conv_id, chr(10), '<<<RESULT_END>>>', chr(10), 'tail ', text) as response
from conversations
""",
    "fx_contacts": """
select concat('wx_', c_custkey) as username, c_name as alias,
       cast(c_custkey % 3 as int) as sex, cast(c_custkey % 2 as int) as deleteflag,
       concat('138', lpad(concat('', c_custkey), 8, '0')) as mobile,
       concat('{"string":"', c_name, '"}') as nickname,
       concat('g_', c_custkey) as guid,
       cast(case c_custkey % 3 when 0 then 1200 when 1 then 1201 else 1202 end as int) as notify_type
from customer
""",
    "fx_requests": """
select event_id as request_id,
       case event_id % 6 when 0 then 'application/json' when 1 then 'Application/JSON; charset=utf-8'
            when 2 then 'application/x-www-form-urlencoded' when 3 then 'text/plain'
            when 4 then 'multipart/FORM-data' else '' end as content_type,
       case event_id % 6 when 0 then concat('{"id":', event_id, ',"t":"', event_type, '"}')
            when 1 then case when event_id % 4 = 1 then '{broken' else concat('[', event_id, ']') end
            when 2 then concat('a=', event_id, '&b=&a=2&k=x%20y+z&', event_type, '=1')
            when 3 then case when event_id % 4 = 3 then '{maybe' else concat(' {"g":', event_id, '}') end
            when 4 then concat('u=user_', user_id, '&flag')
            else event_type end as body
from events
""",
    "fx_loose": """
select concat('m', event_id) as row_id,
       case when event_id % 11 = 0 then '' else concat('m', event_id) end as msg_id,
       case event_id % 13 when 0 then 'soon' when 1 then '' else concat('', 1704067200 + event_id * 60) end as create_time,
       case event_id % 7 when 0 then 'x' when 1 then '1.5' when 2 then '3.0' else '49' end as msg_type,
       case when event_id % 17 = 0 then 'n' else '1010' end as notify_type,
       case when event_id % 2 = 0 then '1' else '0' end as is_chatroom_msg
from events
""",
    "fx_envelopes": """
select c_custkey,
       case c_custkey % 4
         when 0 then concat('{"guid":"g', c_custkey, '","notify_type":1010,"data":{"msg_id":"m', c_custkey, '","content":"', c_mktsegment, '"}}')
         when 1 then concat('{"guid":"g', c_custkey, '","notify_type":1200,"data":{"userName":{"string":"wx_', c_custkey, '"},"nickName":{"string":"', c_name, '"},"alias":"al', c_custkey, '","sex":', c_custkey % 3, ',"deleteFlag":0,"contactType":3,"verifyFlag":', c_custkey % 2, ',"city":"', c_mktsegment, '","mobile":"138', c_custkey, '","snsUserInfo":{"snsFlag":', c_custkey % 5, '}}}')
         when 2 then concat('{"guid":"g', c_custkey, '","notify_type":1201,"data":{"userName":{"string":"wx_', c_custkey, '"},"deleteContactScene":0}}')
         else concat('{"guid":"g', c_custkey, '","notify_type":1202,"data":{"tpUsername":"tp_', c_custkey, '","nickname":"', c_name, '","type":1,"remark":"r', c_custkey, '","source":3,"customInfo":{"detailVisible":1,"detail":"d"}}}')
       end as value
from customer
""",
    "fx_contact_checks": """
select c_custkey, cast(c_custkey % 5 - 1 as int) as contacttype, cast(c_custkey % 3 as int) as deleteflag,
       0 as verifyflag, cast(c_custkey % 4 as int) as sex, 1200 as notify_type
from customer
""",
    "fx_raw_files": """
select distinct case when user_id % 50 = 0 then concat('notes_', user_id) else concat('', cast(ts as date)) end as stem
from events
""",
    "fx_landed_days": """
select distinct concat('', cast(ts as date)) as day_key from events where day(ts) % 3 > 0
""",
    "fx_ranges": """
select user_id, cast(min(ts) as date) as first_day, cast(max(ts) as date) as last_day from events group by user_id
""",
    "fx_checkpoint_log": """
select concat('file_', user_id % 40) as source_file, event_id as log_no, event_id * 3 as last_processed_line,
       concat('evt_', event_id) as last_processed_msg_id, event_id + 1 as processed_record_count,
       case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'processing' end as status
from events
""",
    "fx_extraction_log": """
select concat('day_', cast(ts as date)) as parquet_file, concat('user_', user_id % 3) as from_username, event_id as log_no,
       case when event_type in ('click', 'view') then 'completed' when event_type = 'error' then 'failed' else 'processing' end as status,
       user_id as total_images_extracted
from events
""",
    "fx_registry": """
select event_type as schema_name, event_id as version, concat('k bigint, u', user_id % 9, ' string') as fields, concat('v', event_id) as description
from events
""",
    "fx_image_events": """
select concat('a', user_id) as image_id, event_id as event_no,
       case event_type when 'click' then 'pending' when 'view' then 'downloading' when 'purchase' then 'completed' when 'error' then 'failed' end as status,
       case when event_type = 'purchase' then concat('http://i/', event_id) end as download_url,
       case when event_type = 'error' then concat('Error code: ', event_id) end as error_message,
       case when event_type = 'signup' then event_id % 2 = 0 end as has_text,
       case when event_type = 'signup' and event_id % 2 = 0 then concat('ocr ', event_id) end as ocr_content
from events
""",
    "fx_download_responses": """
select i.image_id,
       case length(i.image_id) % 4 when 0 then concat('{"errcode":0,"data":{"url":"http://d/', i.image_id, '"}}')
            when 1 then concat('{"errcode":0,"data":{"download_url":"http://e/', i.image_id, '"}}')
            when 2 then '{"errcode":0,"data":{}}'
            else case when i.msg_id > 'c5' then '{"errcode":7,"errmsg":"busy"}' else '{"errcode":9}' end end as response
from fx_images i
""",
    "fx_ocr_responses": """
select image_id, case when length(image_id) % 2 = 0 then concat('{"content":"t ', image_id, '","prism_wnum":3}') else '{"content":"","prism_wnum":0}' end as response
from fx_images where status = 'completed'
""",
    "fx_term_chat": """
select msg_id, chatroom, chatroom_sender, from_username, create_epoch, conv_id, turn,
       case when conv_id % 5 = 0 then concat('byd ', content) when conv_id % 9 = 4 and turn % 2 = 0 then concat(content, ' 大盘 etf')
            when turn % 4 = 3 then concat(content, ' 迪链') else content end as content
from fx_chat
""",
    "fx_term_topics": """
select chatroom, topic_no, case when topic_no % 7 = 0 then array_append(keywords, '迪链') else keywords end as keywords,
       participants, message_ids, message_count, confidence, category, concat('t', topic_no) as title,
       case when topic_no % 11 = 0 then '比亚迪新车' when topic_no % 11 = 1 then '看看大盘' else '' end as summary,
       concat('n', topic_no % 3) as notes, '' as time_range
from fx_topics
""",
    "fx_room_topics": """
select chatroom, conv_id % 3 as topic_no, split(concat('r', conv_id % 3, ',s,t,u,v,w'), ',') as keywords,
       array_sort(array_agg(distinct chatroom_sender)) as participants,
       array_sort(array_agg(msg_id)) as message_ids, count(*) as message_count,
       cast(0.5 as double) as confidence, '其他' as category, concat('title ', conv_id % 3) as title,
       concat(' summary ', conv_id % 3, ' ') as summary, 'note' as notes,
       case when conv_id % 3 = 0 then '' else '2024-01-05 10:00-2024-01-06 11:30' end as time_range
from fx_chat group by chatroom, conv_id % 3
""",
    "fx_chunk_summaries": """
select chatroom, conv_id as topic_no, turn + 1 as chunk_index,
       case when turn % 3 = 2 then '' else concat('s', conv_id, '.', turn) end as summary,
       case when turn % 2 = 0 then concat('n', turn) else '' end as notes
from fx_chat
""",
}

_NAME = re.compile(r"\bfx_\w+\b")


def with_adapters(sql: str) -> str:
    """Prefix a check query with the adapter views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in ADAPTERS and name not in needed:
                visit(ADAPTERS[name])
                needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{name} as ({ADAPTERS[name].strip()})" for name in needed)
    rest = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    if rest:
        return f"with recursive {ctes},\n{body[rest.end():]}"
    return f"with recursive {ctes}\n{body}"


class Tables:
    """The given parquet tables and the adapter views over them, by attribute name."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._built:
            text = ADAPTERS[name].replace("{", "{{").replace("}", "}}")
            sources: dict[str, DataFrame] = {}
            for source in re.findall(r"\b(?:from|join)\s+(\w+)", text):
                sources[source] = self.view(source) if source in ADAPTERS else self.table(source)
            for source in sources:
                text = re.sub(rf"\b(from|join)\s+{source}\b", rf"\1 {{{source}}}", text)
            self._built[name] = self.spark.sql(text, **sources)
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            return self.view(name)
        raise AttributeError(name)
