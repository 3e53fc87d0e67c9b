"""Prompt rows for the model: batches, summary chunks and merged summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as line
from chatlake.operators.enrichment import topic_messages
from chatlake.operators.sequence import batches_by_count, greedy_batches, stride_sample
from chatlake.operators.skew import number_rows

NO_CONTENT = "（无有效内容）"

# Head of a batch prompt, and what its lines look like per version.
BATCH_HEAD = "群聊 ID: {chatroom}\n群聊名称: {chatroom_name}\n分析日期范围: {date_range}\n消息总数: {total_messages}\n"
LINE_HINT = {
    "v1": "消息列表(格式: 时间 发送者: 内容):\n",
    "v2": "\n消息列表(格式: [序号] 时间 发送者: 内容):\n",
}
CHUNK_HEAD = (
    "群聊 ID: {chatroom}\n群聊名称: {chatroom_name}\n分析日期范围: {date_range}\n关键词: {keyword_text}\n"
    "分段: {chunk_index}/{chunk_total}\n片段消息数: {total_messages}\n\n消息列表(格式: 时间 发送者: 内容):\n"
)
MERGE_HEAD = (
    "群聊 ID: {chatroom}\n群聊名称: {chatroom_name}\n分析日期范围: {date_range}\n关键词: {keyword_text}\n"
    "分段摘要数量: {chunk_total}\n\n分段摘要:\n"
)
NOTES_TITLE = "补充说明:"


def render(template: str, columns: Mapping[str, Column] | None = None) -> Column:
    """A template whose ``{name}`` places are filled from columns."""
    import re

    given = columns or {}
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            name = piece[1:-1]
            parts.append(given.get(name, F.col(name)).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _joined_lines(order: str, value: str) -> Column:
    """Non-empty lines of a bounded group, in order, with newlines between."""
    kept = F.collect_list(F.when(F.col(value) != "", F.struct(order, value)))
    return F.array_join(F.transform(F.array_sort(kept), lambda e: e[value]), "\n")


def with_batches(
    sequenced: DataFrame, options: line.LineFormat, budget: int, max_messages: int | None = None,
    tokens: Callable[[Column], Column] = line.estimate_tokens, chunk_rows: int | None = None,
) -> DataFrame:
    """Add the message line and ``batch_index``: by count if given, else by tokens."""
    lined = sequenced.withColumn("line", line.message_line(options))
    if max_messages:
        return batches_by_count(lined, max_messages)
    costed = lined.withColumn("_cost", tokens(F.col("line")) + 1)
    extra = {"chunk_rows": chunk_rows} if chunk_rows else {}
    return greedy_batches(costed, ["chatroom"], "seq_id", "_cost", budget, **extra).drop("_cost")


def batch_prompts(
    batched: DataFrame, options: line.LineFormat = line.LineFormat(), name: Column | None = None,
    instructions: str = "",
) -> DataFrame:
    """One prompt per batch. A batch is bounded by its budget, so its lines fit one row."""
    time = line.local_time(F.col("create_time"), options.tz)
    grouped = batched.groupBy("chatroom", "batch_index").agg(
        F.count(F.lit(1)).alias("total_messages"),
        line.date_range(F.min(time), F.max(time)).alias("date_range"),
        _joined_lines("seq_id", "line").alias("_lines"),
    )
    named = grouped.withColumn("chatroom_name", F.lit("") if name is None else name)
    lines = line.strip(F.col("_lines"))
    body = F.coalesce(F.nullif(lines, F.lit("")), F.lit(NO_CONTENT))
    head = BATCH_HEAD + LINE_HINT[options.prompt_version.lower()]
    prompt = F.concat(render(head), body, F.lit(f"\n\n{instructions}" if instructions else ""))
    return named.select(
        "chatroom", "chatroom_name", "batch_index", "date_range", "total_messages",
        debug_header().alias("header"), prompt.alias("prompt"),
    )


def debug_header() -> Column:
    """Head of a batch's debug file."""
    return render(
        "chatroom_id: {chatroom}\nchatroom_name: {chatroom_name}\n"
        "date_range: {date_range}\ntotal_messages: {total_messages}"
    )


def summary_chunks(
    members: DataFrame, messages: DataFrame, options: line.LineFormat = line.LineFormat(),
    max_messages: int | None = 200, budget: int | None = 60_000,
    tokens: Callable[[Column], Column] = line.estimate_tokens,
) -> DataFrame:
    """Sampled messages of each topic with their line and ``chunk_index``.

    Only ids are numbered and sampled; the messages are joined to what is left.
    """
    topic, ids = ["chatroom", "topic_no"], ["chatroom", "msg_id"]
    present = members.select(*topic, "pos", "msg_id").join(messages.select(*ids), ids, "left_semi")
    found = number_rows(present, topic, ["pos", "msg_id"], "place")
    chosen = stride_sample(found, topic, "place", max_messages) if max_messages else found
    lined = topic_messages(chosen, messages).withColumn("line", line.summary_line(options))
    if not budget:
        return lined.withColumn("chunk_index", F.lit(1).cast("long"))
    costed = lined.withColumn("_cost", tokens(F.col("line")) + 1)
    return greedy_batches(costed, topic, "place", "_cost", budget, "chunk_index").drop("_cost")


def summary_prompts(chunks: DataFrame, topics: DataFrame, date_ranges: DataFrame) -> DataFrame:
    """One prompt per summary chunk. ``date_ranges`` has one row per chatroom."""
    topic = ["chatroom", "topic_no"]
    grouped = chunks.groupBy(*topic, "chunk_index").agg(
        F.count(F.lit(1)).alias("total_messages"), _joined_lines("place", "line").alias("_lines")
    )
    totals = grouped.groupBy(*topic).agg(F.max("chunk_index").alias("chunk_total"))
    words = topics.select(*topic, F.array_join("keywords", ", ").alias("keyword_text"))
    full = (
        grouped.join(totals, topic).join(words, topic)
        .join(date_ranges.select("chatroom", "date_range"), "chatroom")
        .withColumn("chatroom_name", F.lit(""))
    )
    body = F.coalesce(F.nullif(line.strip(F.col("_lines")), F.lit("")), F.lit(NO_CONTENT))
    prompt = F.concat(render(CHUNK_HEAD), body)
    return full.select(
        *topic, "chunk_index", "chunk_total", "total_messages", "keyword_text", "date_range",
        prompt.alias("prompt"),
    )


def merged_summary_prompts(summaries: DataFrame) -> DataFrame:
    """One prompt per topic from its chunk summaries; a topic has few chunks.

    ``summaries`` has chatroom, topic_no, chunk_index, summary and notes.
    """

    def numbered(name: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col(name) != "", F.struct("chunk_index", name))))
        return F.transform(
            items, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e[name])
        )

    grouped = summaries.groupBy("chatroom", "topic_no").agg(
        numbered("summary").alias("_s"), numbered("notes").alias("_n")
    )
    empty = F.array().cast("array<string>")
    notes = F.when(
        F.size("_n") > 0, F.concat(F.array(F.lit(""), F.lit(NOTES_TITLE)), F.col("_n"))
    ).otherwise(empty)
    text = F.array_join(F.concat("_s", notes), "\n")
    return grouped.filter(F.size("_s") > 0).select(
        "chatroom", "topic_no", F.size("_s").alias("chunk_total"), text.alias("chunk_summaries")
    )


def with_merge_prompt(merged: DataFrame, topics: DataFrame, date_ranges: DataFrame) -> DataFrame:
    """The prompt that asks for one summary of a topic's chunk summaries."""
    words = topics.select("chatroom", "topic_no", F.array_join("keywords", ", ").alias("keyword_text"))
    full = (
        merged.join(words, ["chatroom", "topic_no"])
        .join(date_ranges.select("chatroom", "date_range"), "chatroom")
        .withColumn("chatroom_name", F.lit(""))
    )
    return full.withColumn("prompt", F.concat(render(MERGE_HEAD), "chunk_summaries"))


def invoke(
    prompts: DataFrame, make_model: Callable[[], Callable[[str], str]], keep: list[str]
) -> DataFrame:
    """Answer each prompt with a user's model, built once per task, called in the tasks."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            yield batch[keep].assign(response=[model(prompt) for prompt in batch["prompt"]])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema if f.name in keep)
    ordered = [f.name for f in prompts.schema if f.name in keep]
    return prompts.select(*ordered, "prompt").mapInPandas(answer, f"{typed}, response string")
