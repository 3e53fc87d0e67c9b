"""The analysis of all chatrooms: messages to prompts, and responses to topics and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions import text as line
from chatlake.functions import topics as fn
from chatlake.operators import enrichment, sequence
from chatlake.operators import topics as top
from chatlake.operators.selection import group_messages, in_days
from chatlake.operators.skew import keep_last, number_rows
from chatlake.plans import prompts, report
from chatlake.session import cut_lineage

BATCH = ["chatroom", "batch_index"]


@dataclass(frozen=True)
class Settings:
    """Options of an analysis run."""

    lines: line.LineFormat = field(default_factory=line.LineFormat)
    max_messages_per_batch: int | None = None
    max_input_tokens: int = sequence.DEFAULT_TOKEN_BUDGET
    merge_threshold: float = fn.MERGE_THRESHOLD
    popularity_threshold: float = fn.POPULARITY_THRESHOLD
    summary_max_tokens: int | None = 60_000
    summary_max_messages: int | None = None
    tokens: Callable[[Column], Column] = line.estimate_tokens


def select_messages(
    lake: DataFrame, start: str, end: str, rooms: list[str] | None = None
) -> DataFrame:
    """Group messages of a date range, optionally of given rooms."""
    return group_messages(in_days(lake, start, end), rooms)


def prepare_rooms(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Enriched messages with ids, sequence numbers, lines and batches, for all rooms at once.

    The result is materialised, since prompts, id resolution and trace all start from it.
    """
    # numbering samples its input, so the row-wise parsing comes after it
    ordered = enrichment.enrich(sequence.ensure_ids(sequence.assign_sequence(messages)))
    batched = prompts.with_batches(
        ordered, settings.lines, settings.max_input_tokens, settings.max_messages_per_batch,
        settings.tokens,
    )
    return cut_lineage(batched)


def batch_prompts(batched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return prompts.batch_prompts(batched, settings.lines)


LOOKUP = [
    "chatroom", "msg_id", "seq_id", "create_time", "chatroom_sender", "from_username", "content",
    "appmsg_title",
]


def message_lookup(batched: DataFrame) -> DataFrame:
    """One message per room and id, the last where several share an id.

    It is written once, since facts, terms, dates and summaries all join it.
    """
    return cut_lineage(keep_last(batched.select(*LOOKUP), ["chatroom", "msg_id"], ["seq_id"]))


def topics_from_responses(
    responses: DataFrame, batched: DataFrame, settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame]:
    """Merged, popular topics of each room, from ``chatroom, batch_index, response`` rows.

    Returns the topics and their members.
    """
    key = [*BATCH, "block_no"]
    parsed = cut_lineage(top.parse_responses(responses))
    resolved = cut_lineage(top.resolve_members(parsed, batched, key))
    valid = top.valid_topics(parsed, resolved, key)
    topics = number_rows(valid, ["chatroom"], ["batch_index", "block_no"], "topic_no")
    members = resolved.join(topics.select(*key, "topic_no"), key).select(*top.TOPIC, "pos", "msg_id")
    merged, members = top.merge_topics_and_members(
        topics.drop("message_ids"), members, settings.merge_threshold
    )
    popular = cut_lineage(top.popular(merged, settings.popularity_threshold).drop("popularity"))
    return popular, members.join(popular.select(*top.TOPIC), top.TOPIC, "left_semi")


Model = Callable[[], Callable[[str], str]]

_TEXTS = ["title", "category", "summary", "notes"]


def _first_topic(responses: DataFrame, key: list[str]) -> DataFrame:
    """Texts of the first topic in each response; the parser's stand-ins count as empty."""
    parsed = top.parse_responses(responses)
    first = parsed.groupBy(*key).agg(F.min_by(F.struct(*_TEXTS), "block_no").alias("_t"))
    texts = first.select(*key, "_t.*")
    return texts.withColumns(
        {
            "title": F.when(F.col("title") != top.UNTITLED, F.col("title")).otherwise(""),
            "category": F.when(F.col("category") != top.OTHER, F.col("category")).otherwise(""),
        }
    )


def summarize(
    topics: DataFrame, members: DataFrame, lookup: DataFrame, make_model: Model, settings: Settings = Settings()
) -> DataFrame:
    """Texts of each topic from two rounds of prompts: its chunks, then their summaries."""
    time = line.local_time(F.col("create_time"), settings.lines.tz)
    ranges = lookup.groupBy("chatroom").agg(line.date_range(F.min(time), F.max(time)).alias("date_range"))
    chunks = prompts.summary_chunks(
        members, lookup, settings.lines, settings.summary_max_messages,
        settings.summary_max_tokens, settings.tokens,
    )
    asked = prompts.summary_prompts(chunks, topics, ranges)
    key = [*top.TOPIC, "chunk_index"]
    answers = cut_lineage(_first_topic(prompts.invoke(asked, make_model, key), key))
    combined = prompts.with_merge_prompt(prompts.merged_summary_prompts(answers), topics, ranges)
    merged = _first_topic(prompts.invoke(combined, make_model, top.TOPIC), top.TOPIC)

    def ordered(name: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col(name) != "", F.struct("chunk_index", name))))
        return F.transform(items, lambda e: e[name])

    lists = answers.groupBy(*top.TOPIC).agg(
        ordered("summary").alias("chunk_summaries"), ordered("notes").alias("chunk_notes")
    )
    return lists.join(merged, top.TOPIC, "left")


def finish_topics(
    topics: DataFrame, members: DataFrame, batched: DataFrame, make_model: Model | None = None,
    settings: Settings = Settings(),
) -> tuple[DataFrame, DataFrame]:
    """Collapse the watched subject, take facts from the messages, write texts, settle categories.

    Without a model, or where it gives nothing, texts fall back to the topic's keywords.
    Returns the topics and their members.
    """
    lookup = message_lookup(batched)
    collapsed, members = top.collapse_watch_topics(topics, members, lookup, settings.lines.tz)
    collapsed, members = cut_lineage(collapsed), cut_lineage(members)
    facts = top.topic_facts(members, lookup, settings.lines.tz).select(
        *top.TOPIC, F.col("participants").alias("_people"), F.col("time_range").alias("_times"), "found"
    )
    empty = F.array().cast("array<string>")
    joined = collapsed.join(facts, top.TOPIC, "left").withColumns(
        {
            "participants": F.coalesce("_people", empty),
            "time_range": F.coalesce("_times", F.lit("")),
            "message_count": F.coalesce("found", "message_count"),
        }
    )
    bare = joined.drop("_people", "_times", "found", "title", "category", "summary").withColumnRenamed(
        "notes", "_notes"
    )
    if make_model is None:
        written = bare.withColumns(
            {name: F.lit("") for name in _TEXTS} | {"chunk_summaries": empty, "chunk_notes": empty}
        )
    else:
        texts = summarize(collapsed, members, lookup, make_model, settings)
        written = bare.join(texts, top.TOPIC, "left").withColumns(
            {name: F.coalesce(name, F.lit("")) for name in _TEXTS}
            | {name: F.coalesce(name, empty) for name in ("chunk_summaries", "chunk_notes")}
        )
    filled = report.with_fallbacks(written.withColumn("topic_index", F.col("topic_no")))
    noted = filled.withColumn("notes", F.coalesce(F.nullif("notes", F.lit("")), "_notes"))
    bare = noted.drop("chunk_summaries", "chunk_notes", "topic_index", "_notes")
    return top.with_categories(bare, members, lookup), members


def analyze(
    messages: DataFrame,
    make_model: Model,
    images: DataFrame | None = None,
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """The whole run for all rooms: prompts, responses, topics, members, report and trace."""
    spark: SparkSession = messages.sparkSession
    batched = prepare_rooms(messages, settings)
    asked = batch_prompts(batched, settings)
    responses = cut_lineage(prompts.invoke(asked, make_model, BATCH))
    found, members = topics_from_responses(responses, batched, settings)
    topics, members = finish_topics(found, members, batched, make_model, settings)
    topics = cut_lineage(topics)
    known = images if images is not None else spark.createDataFrame(
        [], "image_id string, ocr_content string, has_text boolean, status string, download_url string"
    )
    trace = report.trace_messages(batched, known, settings.lines)
    return {
        "prompts": asked,
        "responses": responses,
        "topics": topics,
        "members": members,
        "report": report.report_rows(topics, batched),
        "trace": trace,
    }
