"""Times, keywords, token counts and the text form of a message."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions import xml

# Wording of formatted lines.
UNKNOWN_TIME = "unknown-time"
UNKNOWN_SENDER = "unknown"
IMAGE_MARK = "[图片]"
FILTERED_MARK = "[已过滤]"
QUOTE_PREVIEW = 30
TIME_PATTERN = r"(\d{1,2}:\d{2}(?::\d{2})?)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def shorten(text: Column, size: int) -> Column:
    """At most ``size`` characters, with ``...`` where something was cut off."""
    cut = F.concat(rstrip(F.left(text, F.lit(size))), F.lit("..."))
    return F.when(F.length(text) > size, cut).otherwise(text)


# -- times --------------------------------------------------------------------------------


def local_time(value: Column, tz: str = "UTC") -> Column:
    """Wall-clock time in ``tz`` of a UTC timestamp."""
    return F.from_utc_timestamp(value, tz)


def local_time_of_epoch(seconds: Column, tz: str = "UTC") -> Column:
    """Wall-clock time in ``tz`` of Unix seconds; null for anything that is no number."""
    return local_time(F.timestamp_seconds(seconds.try_cast("bigint")), tz)


def extract_times(text: Column) -> Column:
    """All ``H:MM`` and ``H:MM:SS`` in a text."""
    found = F.regexp_extract_all(text, F.lit(TIME_PATTERN), 1)
    return F.coalesce(found, F.array().cast("array<string>"))


def seconds_of(time: Column) -> Column:
    """Seconds since midnight of ``H``, ``H:MM`` or ``H:MM:SS``."""
    parts = F.split(time, ":")
    total = F.lit(0)
    for index, weight in ((0, 3600), (1, 60), (2, 1)):
        part = F.get(parts, index).try_cast("int")
        total = total + F.coalesce(part, F.lit(0)) * weight
    return total


def format_time(time: Column, with_seconds: Column) -> Column:
    short = F.substring_index(time, ":", 2)
    full = F.when(F.size(F.split(time, ":")) == 2, F.concat(time, F.lit(":00"))).otherwise(time)
    return F.when(with_seconds, full).otherwise(short)


def merge_time_ranges(first: Column, second: Column) -> Column:
    """Earliest start to latest end of two ranges; a side without times yields the other."""
    left, right = extract_times(first), extract_times(second)
    times = F.concat(left, right)
    with_seconds = F.exists(times, lambda t: F.size(F.split(t, ":")) == 3)
    start = F.array_min(
        F.transform(times, lambda t, i: F.struct(seconds_of(t).alias("s"), i.alias("i"), t.alias("t")))
    )["t"]
    end = F.array_max(
        F.transform(times, lambda t, i: F.struct(seconds_of(t).alias("s"), (-i).alias("i"), t.alias("t")))
    )["t"]
    merged = F.concat(format_time(start, with_seconds), F.lit("-"), format_time(end, with_seconds))
    return (
        F.when(F.size(left) == 0, F.coalesce(F.nullif(second, F.lit("")), first))
        .when(F.size(right) == 0, first)
        .otherwise(merged)
    )


def report_time(time_range: Column) -> Column:
    """A range without dates; ``-`` when empty."""
    bare = strip(F.regexp_replace(time_range, r"\d{4}-\d{2}-\d{2}\s*", ""))
    return F.when(F.coalesce(time_range, F.lit("")) == "", "-").otherwise(bare)


def date_range(first: Column, last: Column) -> Column:
    """``D`` or ``D1 to D2``; empty when there is no time."""
    start, end = F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")
    text = F.when(start == end, start).otherwise(F.concat(start, F.lit(" to "), end))
    return F.coalesce(text, F.lit(""))


def time_range(first: Column, last: Column) -> Column:
    """``HH:MM-HH:MM``, with seconds when either end has them."""
    precise = (F.second(first) > 0) | (F.second(last) > 0)

    def span(pattern: str) -> Column:
        return F.concat(F.date_format(first, pattern), F.lit("-"), F.date_format(last, pattern))

    text = F.when(precise, span("HH:mm:ss")).otherwise(span("HH:mm"))
    return F.coalesce(text, F.lit(""))


# -- keywords and tokens ------------------------------------------------------------------


def normalize_keyword(keyword: Column) -> Column:
    """Lower case; letters, numbers of all kinds and underscores stay."""
    return F.regexp_replace(F.lower(keyword), r"[^\p{L}\p{N}_]+", "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def token_counter(make_encoder: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """Exact token counts with an encoder that each Python worker builds once."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            yield texts.fillna("").map(lambda text: len(encode(text)))

    return count


# -- lines --------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineFormat:
    """Options of the text form of a message."""

    tz: str = "UTC"
    max_content_length: int | None = None
    prompt_version: str = "v1"
    show_quotes: bool = True
    mark_images: bool = True


def time_text(tz: str = "UTC", column: str = "create_time") -> Column:
    local = F.date_format(local_time(F.col(column), tz), "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(local, F.lit(UNKNOWN_TIME))


def sender() -> Column:
    return F.coalesce(
        F.nullif("chatroom_sender", F.lit("")),
        F.nullif("from_username", F.lit("")),
        F.lit(UNKNOWN_SENDER),
    )


def _one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def _quote_text() -> Column:
    quoted = strip(_one_line(F.coalesce("refermsg.content", F.lit(""))))
    name = F.coalesce(F.nullif("refermsg.displayname", F.lit("")), F.lit("?"))
    mark = F.concat(F.lit("[引用 @"), name, F.lit(": "), shorten(quoted, QUOTE_PREVIEW), F.lit("]"))
    return strip(F.concat(mark, F.lit(" "), strip(F.coalesce("appmsg_title", F.lit("")))))


def message_line(options: LineFormat = LineFormat()) -> Column:
    """One line per message for a batch prompt; empty for filtered messages.

    Expects the columns of the enrichment step and, for v2 prompts, ``seq_id``.
    """
    content = strip(F.coalesce("content", F.lit("")))
    if options.mark_images:
        content = F.when(content.rlike(r"^image#[a-f0-9-]+$"), IMAGE_MARK).otherwise(content)
    content = _one_line(content)
    if options.show_quotes:
        quoting = F.col("refermsg").isNotNull() & F.col("appmsg_type").isin(xml.REFERMSG_APPMSG_TYPES)
        content = F.when(quoting, _quote_text()).otherwise(content)
    title = strip(F.coalesce("appmsg_title", F.lit("")))
    shared = F.col("appmsg_type").isin(xml.ARTICLE_APPMSG_TYPES) & (title != "")
    content = F.when(shared, F.concat(F.lit("[分享] "), title)).otherwise(content)
    if options.max_content_length:
        content = shorten(content, options.max_content_length)
    parts = [time_text(options.tz), F.lit(" "), sender(), F.lit(": "), content]
    if options.prompt_version == "v2":
        parts = [F.lit("["), F.col("seq_id").cast("string"), F.lit("] "), *parts]
    return F.when(F.coalesce("should_filter", F.lit(False)), "").otherwise(F.concat(*parts))


def summary_line(options: LineFormat = LineFormat()) -> Column:
    """One line per message for a summary prompt."""
    content = strip(_one_line(F.coalesce("content", F.lit(""))))
    if options.max_content_length:
        content = shorten(content, options.max_content_length)
    return F.concat(time_text(options.tz), F.lit(" "), sender(), F.lit(": "), content)


def display_line(options: LineFormat = LineFormat()) -> Column:
    """The line shown in a trace; filtered messages get a short stand-in."""
    stand_in = F.concat(
        F.lit("["), F.col("seq_id").cast("string"), F.lit("] "), time_text(options.tz),
        F.lit(" "), sender(), F.lit(f": {FILTERED_MARK}"),
    )
    line = message_line(options)
    return F.when(line == "", stand_in).otherwise(line)
