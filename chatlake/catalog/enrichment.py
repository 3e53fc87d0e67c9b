"""XML enrichment, references between messages, images and their state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.catalog.registry import query
from chatlake.functions import xml
from chatlake.operators import enrichment, images, state
from chatlake.operators.sequence import assign_sequence
from chatlake.operators.shaping import evaluate_once
from chatlake.session import scratch_path
from chatlake.sources import files
from chatlake.sources.adapters import Tables
from chatlake.sources.lake import read_lake, write_days

# The check reads the same documents with regular expressions; the adapter is well-formed.
ENRICHED = """
with enr as (
  select *, right(trim(content), 1) = '>' as is_xml,
         coalesce(try_cast(nullif(regexp_extract(content, '<appmsg>.*?<type>([0-9]+)</type>', 1), '') as int), 0) as app_type
  from fx_xml
), cls as (
  select *, case when not is_xml then 'unknown' when contains(content, '<emoji') then 'emoji' when contains(content, '<sysmsg') then 'sysmsg'
         when contains(content, '<op') then 'op' when contains(content, '<appmsg>') then 'appmsg' when contains(content, '<img') then 'img' else 'unknown' end as category,
         case when not is_xml then '' when contains(content, '<emoji') then 'emoji' when contains(content, '<sysmsg') then 'sysmsg'
         when contains(content, '<op') and contains(content, '<name>lastMessage</name>') then 'op:lastMessage'
         when contains(content, '<appmsg>') and app_type in (3, 47, 51, 124) then concat('appmsg:type=', app_type)
         when contains(content, '<appmsg>') and app_type = 1 and contains(content, '<refermsg>') then 'appmsg:type=1+refermsg' else '' end as reason
  from enr
), done as (
  select *, msg_type = 49 and reason <> '' as should_filter,
         case when msg_type = 49 and reason = '' and category = 'appmsg' then app_type end as appmsg_type,
         case when msg_type = 49 and reason = '' and category = 'appmsg' then regexp_extract(content, '<title>(.*?)</title>', 1) end as appmsg_title,
         case when msg_type = 49 and reason = '' and category = 'appmsg' and app_type in (57, 49, 1) then regexp_extract(content, '<svrid>(.*?)</svrid>', 1) end as svrid,
         regexp_extract(content, '<displayname>(.*?)</displayname>', 1) as ref_name,
         regexp_extract(content, '<refermsg>.*<content>(.*?)</content>', 1) as ref_content,
         case when msg_type = 49 and reason = '' and app_type in (4, 5) then regexp_extract(content, '<des>(.*?)</des>', 1) end as des,
         case when msg_type = 49 and reason = '' and app_type in (4, 5) then regexp_extract(content, '<url>(.*?)</url>', 1) end as url
  from cls
)
"""


def xml_messages(t: Tables) -> DataFrame:
    """The XML adapter with a timestamp and a sender column."""
    return t.fx_xml.withColumns(
        {"create_time": F.timestamp_seconds("create_epoch"), "from_username": F.lit("")}
    )


def _documents(t: Tables) -> DataFrame:
    return evaluate_once(t.fx_xml, {"_doc": xml.parse(F.col("content"))})


@query(
    "F16_xml_kind",
    ENRICHED + "select msg_id, category, reason, case when category = 'appmsg' then app_type else -1 end as app_type, reason <> '' as should_filter from cls",
)
def xml_kind(t: Tables) -> DataFrame:
    kinds = evaluate_once(_documents(t), {"_k": xml.classify(F.col("_doc"), F.col("content"))})
    return kinds.select(
        "msg_id", "_k.category",
        F.coalesce("_k.filter_reason", F.lit("")).alias("reason"),
        F.coalesce("_k.appmsg_type", F.lit(-1)).alias("app_type"),
        "_k.should_filter",
    )


@query(
    "F17_app_content",
    ENRICHED + """select msg_id, app_type, regexp_extract(content, '<title>(.*?)</title>', 1) as title,
    case when app_type in (4, 5) then regexp_extract(content, '<des>(.*?)</des>', 1) else '' end as des,
    case when app_type in (4, 5) then regexp_extract(content, '<url>(.*?)</url>', 1) else '' end as url
    from cls where category = 'appmsg'""",
)
def app_content(t: Tables) -> DataFrame:
    parsed = evaluate_once(_documents(t), {"_a": xml.appmsg_content(F.col("_doc"), F.col("content"))})
    return parsed.filter(F.col("_a").isNotNull()).select(
        "msg_id", F.col("_a.appmsg_type").alias("app_type"), "_a.title",
        F.coalesce("_a.des", F.lit("")).alias("des"), F.coalesce("_a.url", F.lit("")).alias("url"),
    )


@query(
    "F18_quoted_message",
    ENRICHED + """select msg_id, svrid, ref_name as displayname, ref_content as quoted,
    cast(coalesce(try_cast(regexp_extract(content, '<refermsg>.*<type>([0-9]+)</type>', 1) as int), 0) as int) as kind,
    cast(coalesce(try_cast(regexp_extract(content, '<createtime>([0-9]+)</createtime>', 1) as bigint), 0) as bigint) as createtime
    from done where svrid is not null""",
)
def quoted_message(t: Tables) -> DataFrame:
    rows = enrichment.enrich(t.fx_xml).filter(F.col("refermsg").isNotNull())
    return rows.select(
        "msg_id", "refermsg.svrid", "refermsg.displayname", F.col("refermsg.content").alias("quoted"),
        F.col("refermsg.type").alias("kind"), "refermsg.createtime",
    )


@query(
    "F19_encrypted_images",
    "select msg_id, regexp_extract(content, 'aeskey=\"(.*?)\"', 1) as aes_key, regexp_extract(content, 'cdnmidimgurl=\"(.*?)\"', 1) as cdn_mid_img_url, "
    "cast(regexp_extract(content, 'length=\"([0-9]+)\"', 1) as bigint) as length from fx_xml where contains(content, '<img') and contains(content, 'encryver=\"1\"')",
)
def encrypted_images(t: Tables) -> DataFrame:
    return images.image_messages(t.fx_xml).select("msg_id", "aes_key", "cdn_mid_img_url", "length")


@query(
    "F20_enriched",
    ENRICHED + """select msg_id, should_filter, case when should_filter then reason else '' end as filter_reason, coalesce(appmsg_type, -1) as appmsg_type,
    coalesce(appmsg_title, '') as appmsg_title, coalesce(svrid, '') as svrid, coalesce(des, '') as appmsg_des, coalesce(url, '') as appmsg_url from done""",
)
def enriched(t: Tables) -> DataFrame:
    rows = enrichment.enrich(t.fx_xml)
    return rows.select(
        "msg_id", "should_filter",
        F.coalesce("appmsg_type", F.lit(-1)).alias("appmsg_type"),
        F.coalesce("refermsg.svrid", F.lit("")).alias("svrid"),
        *[F.coalesce(n, F.lit("")).alias(n) for n in ("filter_reason", "appmsg_title", "appmsg_des", "appmsg_url")],
    )


@query(
    "F21_message_class",
    ENRICHED + """select msg_id, case when should_filter then 'filtered' when appmsg_type in (4, 5) then 'share' when svrid is not null then 'quote' else 'text' end as kind from done
    union all select concat(msg_id, '_ref'), 'image' from fx_image_refs""",
)
def message_class(t: Tables) -> DataFrame:
    refs = t.fx_image_refs.select(
        F.concat("msg_id", F.lit("_ref")).alias("msg_id"), "content", F.lit(3).alias("msg_type")
    )
    both = t.fx_xml.select("msg_id", "content", "msg_type").unionByName(refs)
    rows = enrichment.enrich(both)
    return rows.select("msg_id", enrichment.message_class(rows).alias("kind"))


@query(
    "F22_image_reference",
    "select msg_id, regexp_extract(content, '^image#([a-f0-9-]+)$', 1) as image_id from fx_image_refs "
    "union all select concat(msg_id, '_x'), '' from fx_xml",
)
def image_reference(t: Tables) -> DataFrame:
    other = t.fx_xml.select(F.concat("msg_id", F.lit("_x")).alias("msg_id"), "content")
    both = t.fx_image_refs.select("msg_id", "content").unionByName(other)
    return both.select("msg_id", F.coalesce(enrichment.image_id_of(F.col("content")), F.lit("")).alias("image_id"))


@query(
    "X03_enricher_chain",
    ENRICHED + "select msg_id, should_filter, lower(msg_id) as tag from done",
)
def enricher_chain(t: Tables) -> DataFrame:
    def tag(df: DataFrame) -> DataFrame:
        return df.withColumn("tag", F.lower("msg_id"))

    return enrichment.apply_enrichers(t.fx_xml, [enrichment.enrich, tag]).select(
        "msg_id", "should_filter", "tag"
    )


# -- lookups ------------------------------------------------------------------------------


def _references(t: Tables) -> DataFrame:
    plain = t.fx_chat.select("msg_id", "chatroom", "content")
    return t.fx_image_refs.select("msg_id", "chatroom", "content").unionByName(plain)


_REFS = """
with refs as (select msg_id, content from fx_image_refs union all select msg_id, content from fx_chat),
hit as (select r.msg_id, i.* exclude (msg_id) from refs r left join fx_images i on concat('image#', i.image_id) = r.content)
"""


@query("J01_image_text", _REFS + "select msg_id, coalesce(ocr_content, '') as ocr_content from hit")
def image_text(t: Tables) -> DataFrame:
    rows = enrichment.with_images(_references(t), t.fx_images)
    return rows.select("msg_id", F.coalesce("ocr_content", F.lit("")).alias("ocr_content"))


@query(
    "J02_image_status",
    _REFS + "select msg_id, coalesce(ocr_content, '') as ocr_content, coalesce(cast(has_text as varchar), '') as has_text, coalesce(status, '') as image_status from hit",
)
def image_status(t: Tables) -> DataFrame:
    rows = enrichment.with_images(_references(t), t.fx_images)
    return rows.select(
        "msg_id", *[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("ocr_content", "has_text", "image_status")]
    )


@query("J03_image_link", _REFS + "select msg_id, coalesce(download_url, '') as image_url from hit")
def image_link(t: Tables) -> DataFrame:
    rows = enrichment.with_images(_references(t), t.fx_images)
    return rows.select("msg_id", F.coalesce("image_url", F.lit("")).alias("image_url"))


_SEQUENCED = ENRICHED + """
, seq as (select *, row_number() over (partition by chatroom order by create_epoch, msg_id) as seq_id from done)
"""


@query(
    "J04_quote_links",
    _SEQUENCED + "select a.msg_id, a.seq_id, coalesce(b.seq_id, 0) as refers_to from seq a "
    "left join seq b on a.chatroom = b.chatroom and nullif(a.svrid, '') = b.msg_id",
)
def quote_links(t: Tables) -> DataFrame:
    sequenced = assign_sequence(xml_messages(t))
    rows = enrichment.resolve_quotes(enrichment.enrich(sequenced), targets=sequenced)
    return rows.select("msg_id", "seq_id", F.coalesce("refers_to_seq_id", F.lit(0)).alias("refers_to"))


@query(
    "J04_quote_links_earlier_batch",
    _SEQUENCED + """, b as (select *, (seq_id - 1) // 4 + 1 as batch_index from seq)
    select x.msg_id, coalesce(case when y.batch_index <= x.batch_index then y.seq_id end, 0) as refers_to from b x
    left join b y on x.chatroom = y.chatroom and nullif(x.svrid, '') = y.msg_id""",
)
def quote_links_earlier_batch(t: Tables) -> DataFrame:
    from chatlake.operators.sequence import batches_by_count

    rows = batches_by_count(assign_sequence(xml_messages(t)), 4)
    linked = enrichment.resolve_quotes(enrichment.enrich(rows), earlier_only=True, targets=rows)
    return linked.select("msg_id", F.coalesce("refers_to_seq_id", F.lit(0)).alias("refers_to"))


@query(
    "J05_topic_messages",
    "select t.chatroom, t.topic_no, c.msg_id, c.content from (select chatroom, topic_no, unnest(message_ids) as msg_id from fx_topics) t "
    "join fx_chat c on c.chatroom = t.chatroom and c.msg_id = t.msg_id",
)
def topic_messages(t: Tables) -> DataFrame:
    rows = enrichment.topic_messages(enrichment.topic_members(t.fx_topics), t.fx_chat)
    return rows.select("chatroom", "topic_no", "msg_id", "content")


@query(
    "J07_new_images",
    "select image_id, msg_id from fx_images where msg_id not in (select msg_id from fx_images where status = 'completed')",
)
def new_images(t: Tables) -> DataFrame:
    twice = t.fx_images.unionByName(t.fx_images)
    known = t.fx_images.filter(F.col("status") == "completed")
    return images.insertable(twice, known).select("image_id", "msg_id")


@query(
    "J08_rewritten_content",
    "select x.msg_id, case when i.image_id is not null then concat('image#', i.image_id) else x.content end as content "
    "from fx_xml x left join fx_images i on i.msg_id = x.msg_id and i.status = 'completed'",
)
def rewritten_content(t: Tables) -> DataFrame:
    mapping = t.fx_images.filter(F.col("status") == "completed").select("msg_id", F.col("image_id").alias("value"))
    return images.rewrite_content(t.fx_xml, mapping).select("msg_id", "content")


@query(
    "J08_rewritten_days",
    "select x.msg_id, case when i.image_id is not null then concat('image#', i.image_id) else x.content end as content "
    "from fx_xml x left join fx_images i on i.msg_id = x.msg_id and i.status = 'failed'",
)
def rewritten_days(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "rewritten")
    write_days(xml_messages(t), root)
    mapping = t.fx_images.filter(F.col("status") == "failed").select("msg_id", F.col("image_id").alias("value"))
    images.rewrite_days(t.spark, root, mapping)
    return read_lake(t.spark, root).select("msg_id", "content")


# -- image state --------------------------------------------------------------------------

_ID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"


@query(
    "I01_extracted_images",
    f"""
    with x as (select *, sha256(msg_id) as h from fx_xml where chatroom_sender = 'assistant_1' and contains(content, 'encryver="1"'))
    select x.msg_id, coalesce(i.image_id, {_ID}) as image_id, i.image_id is null as is_new, regexp_extract(content, 'aeskey="(.*?)"', 1) as aes_key
    from x left join fx_images i on i.msg_id = x.msg_id and i.status = 'completed'
    """,
)
def extracted_images(t: Tables) -> DataFrame:
    sent = xml_messages(t).withColumn("from_username", F.col("chatroom_sender"))
    known = t.fx_images.filter(F.col("status") == "completed")
    rows = images.extract_images(sent, "assistant_1", known)
    return rows.select("msg_id", "image_id", "is_new", "aes_key")


def _image_lake(t: Tables) -> str:
    root = scratch_path(t.spark, "with_images")
    write_days(xml_messages(t).withColumn("from_username", F.col("chatroom_sender")), root)
    return root


@query(
    "I02_processed_files",
    f"with x as (select *, sha256(msg_id) as h from fx_xml where chatroom_sender = 'assistant_1' and contains(content, 'encryver=\"1\"')) "
    f"select msg_id, concat('image#', {_ID}) as content from x",
)
def processed_files(t: Tables) -> DataFrame:
    root, log, marks = _image_lake(t), scratch_path(t.spark, "images"), scratch_path(t.spark, "marks")
    images.extract_all(t.spark, root, log, marks, "assistant_1")
    return read_lake(t.spark, root).filter(F.col("content").startswith("image#")).select("msg_id", "content")


@query(
    "I03_extraction_run",
    """
    with d as (select count(distinct make_timestamp(create_epoch * 1000000)::date) as n, count(*) filter (where chatroom_sender = 'assistant_1' and contains(content, 'encryver="1"')) as images from fx_xml)
    select n as files_scanned, images as images_extracted, 0 as files_skipped, 0 as files_failed, 1 as run from d
    union all select 0, 0, n, 0, 2 from d
    """,
)
def extraction_run(t: Tables) -> DataFrame:
    root, log, marks = _image_lake(t), scratch_path(t.spark, "images"), scratch_path(t.spark, "marks")
    first = images.extract_all(t.spark, root, log, marks, "assistant_1")
    second = images.extract_all(t.spark, root, log, marks, "assistant_1")
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))


_IMAGE_DAYS = """
with d as (select make_timestamp(create_epoch * 1000000)::date as d,
                  count(*) filter (where chatroom_sender = 'assistant_1' and contains(content, 'encryver="1"')) as images
           from fx_xml group by 1)
"""


@query(
    "I02_file_counts",
    _IMAGE_DAYS + "select strftime(d, '%Y-%m-%d') as day_key, 'completed' as status, images::bigint as images from d",
)
def image_file_counts(t: Tables) -> DataFrame:
    """Images that the first run found in each file."""
    root, log, marks = _image_lake(t), scratch_path(t.spark, "images"), scratch_path(t.spark, "marks")
    images.extract_all(t.spark, root, log, marks, "assistant_1", update_content=False)
    rows = t.spark.read.parquet(marks).withColumn("_p", files.parse_path(F.col("parquet_file")))
    day = F.format_string("%04d-%02d-%02d", "_p.year", "_p.month", "_p.day").alias("day_key")
    return rows.groupBy(day, "status").agg(F.sum("total_images_extracted").alias("images"))


@query(
    "I03_failed_file",
    _IMAGE_DAYS + """
    select count(*) as files_scanned, sum(images)::bigint as images_extracted, 1 as files_failed, 'failed' as broken_status from d
    """,
)
def failed_file(t: Tables) -> DataFrame:
    """A run over the same files and one that is no Parquet file."""
    root, log, marks = _image_lake(t), scratch_path(t.spark, "images"), scratch_path(t.spark, "marks")
    broken = f"{root}/year=1999/month=01/day=01"
    t.table("customer").select(F.col("c_name").alias("value")).coalesce(1).write.text(scratch := scratch_path(t.spark, "text"))
    hadoop = t.spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = t.spark.sparkContext._jsc.hadoopConfiguration()
    source = hadoop.Path(files.list_files(t.spark, scratch, "*.txt").first()["file_path"])
    target = hadoop.Path(f"{broken}/part-0.parquet")
    hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    run = images.extract_all(t.spark, root, log, marks, "assistant_1")
    status = t.spark.read.parquet(marks).filter(F.col("parquet_file").contains("year=1999")).select(F.col("status").alias("broken_status"))
    found = [row["broken_status"] for row in status.collect()]
    return run.select("files_scanned", "images_extracted", F.col("files_failed").cast("int"), F.lit(",".join(found)).alias("broken_status"))


def _event_log(t: Tables) -> DataFrame:
    kind = F.when(F.col("status").isNotNull(), "status").otherwise("ocr")
    return t.fx_image_events.withColumns(
        {
            "kind": kind, "msg_id": F.concat(F.lit("m_"), "image_id"), "from_username": F.lit("u"),
            "at": F.timestamp_seconds("event_no"),
        }
    )


_CURRENT = """
with s as (select image_id, arg_max(coalesce(status, ''), event_no) as status, arg_max(coalesce(download_url, ''), event_no) as download_url,
                  arg_max(coalesce(error_message, ''), event_no) as error_message from fx_image_events where status is not null group by 1),
o as (select image_id, arg_max(cast(has_text as varchar), event_no) as has_text, arg_max(coalesce(ocr_content, ''), event_no) as ocr_content
      from fx_image_events where has_text is not null group by 1),
cur as (select coalesce(s.image_id, o.image_id) as image_id, coalesce(status, '') as status, coalesce(download_url, '') as download_url,
               coalesce(error_message, '') as error_message, coalesce(has_text, '') as has_text, coalesce(ocr_content, '') as ocr_content
        from s full join o on s.image_id = o.image_id)
"""
_STATE = ["status", "download_url", "error_message", "has_text", "ocr_content"]


def _as_text(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names})


@query("I04_status_changes", _CURRENT + "select image_id, status, download_url, error_message from cur")
def status_changes(t: Tables) -> DataFrame:
    current = images.current_images(_event_log(t))
    return _as_text(current, _STATE[:3]).select("image_id", *_STATE[:3])


@query("I05_current_image", _CURRENT + "select * from cur where image_id in ('a3', 'a7', 'a50', 'missing')")
def current_image(t: Tables) -> DataFrame:
    wanted = ["a3", "a7", "a50", "missing"]
    current = images.current_images(_event_log(t).filter(F.col("image_id").isin(wanted)))
    return _as_text(current, _STATE).select("image_id", *_STATE)


@query("I06_text_results", _CURRENT + "select image_id, has_text, ocr_content from cur")
def text_results(t: Tables) -> DataFrame:
    current = images.current_images(_event_log(t))
    return _as_text(current, _STATE[3:]).select("image_id", *_STATE[3:])


_DOWNLOADS = """
with r as (select image_id, cast(response as json) as j from fx_download_responses),
d as (select image_id, j->>'errcode' as code, coalesce(j->'data'->>'url', j->'data'->>'download_url') as link, j->>'errmsg' as msg from r),
o as (select image_id, case when code = '0' and link is not null then 'completed' else 'failed' end as status,
             case when code = '0' then coalesce(link, '') else '' end as download_url,
             case when code = '0' and link is null then 'No download URL in response' when code <> '0' then coalesce(msg, concat('Error code: ', code)) else '' end as error_message from d)
"""


@query("I08_download_results", _DOWNLOADS + "select * from o")
def download_results(t: Tables) -> DataFrame:
    rows = images.download_results(t.fx_download_responses).drop("response")
    return _as_text(rows, ["download_url", "error_message"])


@query(
    "I08_download_totals",
    _DOWNLOADS + "select count(*) as total, count(*) filter (where status = 'completed') as succeeded, count(*) filter (where status = 'failed') as failed from o",
)
def download_totals(t: Tables) -> DataFrame:
    return images.download_totals(images.download_results(t.fx_download_responses))


@query(
    "I09_text_responses",
    "select image_id, cast(cast(response as json)->>'prism_wnum' as int) > 0 as has_text, "
    "case when cast(cast(response as json)->>'prism_wnum' as int) > 0 then cast(response as json)->>'content' else '' end as ocr_content from fx_ocr_responses",
)
def text_responses(t: Tables) -> DataFrame:
    rows = images.ocr_results(t.fx_ocr_responses).drop("response")
    return _as_text(rows, ["ocr_content"])


@query(
    "A07_image_statistics",
    """
    select 'images' as kind, count(*) as total, count(*) filter (where status = 'pending') as pending,
           count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed from fx_images
    union all
    select 'checkpoints', count(*), count(*) filter (where status = 'pending'), count(*) filter (where status = 'completed'), count(*) filter (where status = 'failed')
    from (select * from fx_extraction_log qualify row_number() over (partition by parquet_file order by log_no desc) = 1)
    """,
)
def image_statistics(t: Tables) -> DataFrame:
    marks = state.latest(t.fx_extraction_log, ["parquet_file"], ["log_no"])
    return images.image_statistics(t.fx_images, marks)


@query(
    "T02_pending_queue",
    "select image_id, extracted_epoch from fx_images where status = 'pending' order by extracted_epoch, image_id limit 10",
)
def pending_queue(t: Tables) -> DataFrame:
    return images.pending(t.fx_images, 10, "extracted_epoch").select("image_id", "extracted_epoch")


@query(
    "T03_text_queue",
    "select image_id, download_url from fx_images where download_url is not null and has_text is null and error_message is null "
    "order by extracted_epoch, image_id limit 10",
)
def text_queue(t: Tables) -> DataFrame:
    return images.pending_ocr(t.fx_images, 10, "extracted_epoch").select("image_id", "download_url")


@query(
    "T04_retry_queue",
    "select image_id, 'pending' as status from (select * from fx_images where status = 'failed' order by extracted_epoch, image_id limit 10)",
)
def retry_queue(t: Tables) -> DataFrame:
    chosen = images.retryable(t.fx_images, 10, "extracted_epoch")
    return images.status_events(chosen, F.lit("pending")).select("image_id", "status")
