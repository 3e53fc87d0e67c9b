"""Report, trace and debug datasets over merged topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as line
from chatlake.operators import topics as top
from chatlake.operators.enrichment import (
    message_class,
    resolve_quotes,
    with_images,
)
from chatlake.operators.sequence import greedy_batches
from chatlake.operators.skew import number_rows

# Wording of the report.
NO_TOPICS = "无热门话题。"
NO_MESSAGES = "未找到可分析的群聊消息。"
DEFAULT_TITLE = "群聊消息分析报告"
EXPORT_ROWS = 10_000


def with_fallbacks(topics: DataFrame) -> DataFrame:
    """Fill summary, notes, title and category the model left empty.

    ``chunk_summaries`` and ``chunk_notes`` are lists of the chunk texts.
    """

    def filled(name: str, other: Column) -> Column:
        return F.coalesce(F.nullif(name, F.lit("")), other)

    by_words = F.array_join(F.slice("keywords", 1, 3), " / ")
    numbered = F.concat(F.lit("话题"), F.col("topic_index").cast("string"))
    return topics.withColumns(
        {
            "summary": filled("summary", F.array_join("chunk_summaries", "；")),
            "notes": filled("notes", F.array_join("chunk_notes", "；")),
            "title": filled("title", F.when(F.size("keywords") > 0, by_words).otherwise(numbered)),
            "category": filled("category", F.lit(top.OTHER)),
        }
    )


def report_rows(topics: DataFrame, rooms: DataFrame) -> DataFrame:
    """Ranked report lines of each room; a room without popular topics gets one row."""
    ranked = top.ranked(topics)
    label = F.concat(
        F.lit("🏷️ "), F.col("category"), F.lit(" 🔥 "), F.format_string("%.2f", "popularity"),
        F.lit(" 💬 "), F.col("message_count").cast("string"), F.lit(" 👥 "),
        F.size("participants").cast("string"),
    )
    rows = ranked.select(
        "chatroom", "rank",
        F.concat(F.lit("## "), F.col("title")).alias("heading"),
        label.alias("label"),
        F.concat(F.lit("🕒 "), line.report_time(F.col("time_range"))).alias("times"),
        F.concat(F.lit("📝 "), line.strip(F.coalesce("summary", F.lit("")))).alias("body"),
    )
    joined = rooms.select("chatroom").distinct().join(rows, "chatroom", "left")
    empty = F.col("rank").isNull()
    return joined.select(
        "chatroom",
        F.coalesce("rank", F.lit(0)).alias("rank"),
        F.when(empty, NO_TOPICS).otherwise(F.col("heading")).alias("heading"),
        *[F.coalesce(name, F.lit("")).alias(name) for name in ("label", "times", "body")],
    )


def report_text(rows: DataFrame) -> DataFrame:
    """Markdown text of each report row."""
    parts = [F.nullif(name, F.lit("")) for name in ("heading", "label", "times", "body")]
    return rows.select("chatroom", "rank", F.concat_ws("\n", F.lit(""), *parts).alias("markdown"))


def report_head(date: str, title: str | None = None, empty: bool = False) -> str:
    """Title and date of a report, and the note that takes the place of missing rooms."""
    one_line = " ".join((title or "").split("\n")).strip() or DEFAULT_TITLE
    return f"# {one_line}\n\n- 日期: {date}\n" + (f"\n{NO_MESSAGES}" if empty else "")


def report_document(rows: DataFrame, date: str, title: str | None = None) -> DataFrame:
    """The report as ordered text parts: the head first, then the rooms with their topics."""
    head = report_head(date, title, rows.isEmpty())
    first = rows.sparkSession.range(1).select(
        F.lit("").alias("chatroom"), F.lit(-1).alias("rank"), F.lit(head).alias("markdown")
    )
    return first.unionByName(report_text(rows)).orderBy("chatroom", "rank")


def write_report(rows: DataFrame, path: str, date: str, title: str | None = None) -> None:
    """Write the parts in order, as one or more text files."""
    report_document(rows, date, title).select(F.col("markdown").alias("value")).write.text(path)


# -- trace --------------------------------------------------------------------------------


def trace_messages(
    batched: DataFrame, images: DataFrame, options: line.LineFormat = line.LineFormat()
) -> DataFrame:
    """Every message with its display line, class, quote link, image facts and share link."""
    quoted = resolve_quotes(batched)
    facts = with_images(quoted, images)
    kind = message_class(facts)
    is_image = kind == "image"

    def image_only(name: str) -> Column:
        return F.when(is_image, F.col(name)).alias(name)

    return facts.select(
        "chatroom", "msg_id", "seq_id",
        F.coalesce(F.unix_timestamp("create_time"), F.lit(0)).alias("create_epoch"),
        line.time_text(options.tz).alias("time_str"),
        line.sender().alias("sender"),
        F.coalesce("content", F.lit("")).alias("content"),
        line.display_line(options).alias("display_content"),
        kind.alias("message_type"),
        "batch_index", "refers_to_seq_id",
        image_only("ocr_content"), image_only("has_text"), image_only("image_url"),
        image_only("image_status"),
        F.col("appmsg_url").alias("share_url"),
        line.summary_line(options).alias("summary_line"),
    )


def trace_topic_messages(
    members: DataFrame, trace: DataFrame, chunk_budget: int | None = 60_000
) -> DataFrame:
    """Messages of each topic in sequence; with a budget the batch becomes the summary chunk."""
    joined = members.select(*top.TOPIC, "msg_id").join(trace, ["chatroom", "msg_id"])
    if not chunk_budget:
        return joined
    placed = number_rows(joined, top.TOPIC, ["seq_id"], "place")
    costed = placed.withColumn("_cost", line.estimate_tokens(F.col("summary_line")) + 1)
    chunked = greedy_batches(costed, top.TOPIC, "place", "_cost", chunk_budget, "chunk_index")
    return chunked.drop("_cost", "place", "batch_index").withColumnRenamed("chunk_index", "batch_index")


def trace_rooms(trace: DataFrame, topics: DataFrame) -> DataFrame:
    """Totals per room: messages, batches and topics."""
    messages = trace.groupBy("chatroom").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.max("batch_index").alias("batch_count"),
        F.min("create_epoch").alias("first_epoch"),
        F.max("create_epoch").alias("last_epoch"),
    )
    counts = topics.groupBy("chatroom").agg(F.count(F.lit(1)).alias("topics"))
    return messages.join(counts, "chatroom", "left").fillna(0, ["topics"])


def trace_export(topic_rows: DataFrame, topics: DataFrame, rows_per_part: int = EXPORT_ROWS) -> DataFrame:
    """JSON per topic, keyed ``room_topic``, in parts of at most ``rows_per_part`` messages.

    The parts of a topic hold its messages in sequence, so a topic of any size is exported
    whole without one row having to hold all of it.
    """
    placed = number_rows(topic_rows, top.TOPIC, ["seq_id"], "place")
    fields = [
        "seq_id", "time_str", "sender", "display_content", "message_type", "batch_index",
        "refers_to_seq_id", "ocr_content", "has_text", "image_url", "image_status", "share_url",
    ]
    part = F.floor((F.col("place") - 1) / rows_per_part) + 1
    packed = placed.groupBy(*top.TOPIC, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("messages")
    )
    titled = packed.join(topics.select(*top.TOPIC, "title"), top.TOPIC)
    key = F.concat_ws("_", "chatroom", "topic_no").alias("topic_key")
    body = F.to_json(
        F.struct("title", F.col("chatroom").alias("chatroom_id"), "messages"),
        {"ignoreNullFields": "false"},
    )
    return titled.select(key, "part", body.alias("json"))


# -- debug text ---------------------------------------------------------------------------


def topic_debug(topics: DataFrame) -> DataFrame:
    """Text block of each topic in the response protocol."""

    def items(name: str) -> Column:
        lines = F.transform(name, lambda item: F.concat(F.lit("- "), item))
        return F.concat(F.array(F.lit(f"{name}:")), lines)

    lines = F.concat(
        F.array(F.lit(top.TOPIC_MARK)),
        items("keywords"), items("participants"), items("message_ids"),
        F.array(
            F.concat(F.lit("message_count: "), F.col("message_count").cast("string")),
            F.concat(F.lit("confidence: "), F.col("confidence").cast("string")),
            F.concat(F.lit("notes: "), F.coalesce("notes", F.lit(""))),
        ),
    )
    return topics.select(*top.TOPIC, F.array_join(lines, "\n").alias("block"))


def chunk_debug(summaries: DataFrame) -> DataFrame:
    """Text of each chunk summary."""
    notes = F.when(F.col("notes") != "", F.concat(F.lit("notes: "), F.col("notes")))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("topic_index: "), F.col("topic_no").cast("string")),
        F.concat_ws("/", F.concat(F.lit("chunk_index: "), F.col("chunk_index").cast("string")),
                    F.col("chunk_total").cast("string")),
        F.concat(F.lit("keywords: "), F.array_join("keywords", ", ")),
        F.concat(F.lit("summary: "), F.col("summary")),
        notes,
    )
    return summaries.select(*top.TOPIC, "chunk_index", line.strip(text).alias("block"))


def merged_debug(topics: DataFrame) -> DataFrame:
    """Text of each merged summary."""
    notes = F.when(F.col("notes") != "", F.concat(F.lit("notes: "), F.col("notes")))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("topic_index: "), F.col("topic_no").cast("string")),
        F.concat(F.lit("keywords: "), F.array_join("keywords", ", ")),
        *[F.concat(F.lit(f"{n}: "), F.col(n)) for n in ("title", "category", "summary")],
        notes,
    )
    return topics.select(*top.TOPIC, line.strip(text).alias("block"))


def merge_report(assigned: DataFrame) -> DataFrame:
    """The log line of every merge."""
    return assigned.filter(F.col("log").isNotNull()).select("chatroom", "topic_no", "kept_no", "log")
