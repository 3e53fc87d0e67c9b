"""Date-range, chatroom and id queries over the message table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake import schemas


def parse_day(text: str) -> date:
    return datetime.strptime(text, "%Y-%m-%d").date()


def in_days(df: DataFrame, start: str, end: str, column: str = "create_time") -> DataFrame:
    """Rows from the first day to the end of the last.

    The bound on the partition columns prunes folders, the bound on the time column reaches
    the Parquet scan; both are added whenever the table has them.
    """
    first, last = parse_day(start), parse_day(end)
    after = last + timedelta(days=1)
    time = F.col(column)
    wanted = (time >= F.lit(first).cast("timestamp")) & (time < F.lit(after).cast("timestamp"))
    if set(schemas.PARTITION_COLUMNS) <= set(df.columns):
        wanted = F.make_date("year", "month", "day").between(F.lit(first), F.lit(last)) & wanted
    return df.filter(wanted)


def matches(filters: Mapping[str, object]) -> Column:
    """All of: column equals a scalar, or is one of a list."""
    tests = [
        F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value
        for name, value in filters.items()
    ]
    return reduce(lambda left, right: left & right, tests, F.lit(True))


def project(df: DataFrame, requested: Iterable[str], required: Iterable[str] = ()) -> DataFrame:
    """Requested columns in their order, then required ones not already named."""
    return df.select(*dict.fromkeys([*requested, *required]))


def query_messages(
    messages: DataFrame,
    start: str,
    end: str,
    filters: Mapping[str, object] | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    rows = in_days(messages, start, end)
    if filters:
        rows = rows.filter(matches(filters))
    return project(rows, columns) if columns else rows


def by_ids(messages: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Rows with the given ids: a short list goes to the scan, a table becomes a semi join."""
    if isinstance(ids, DataFrame):
        return messages.join(ids.select("msg_id"), "msg_id", "left_semi")
    return messages.filter(F.col("msg_id").isin(ids))


def group_messages(messages: DataFrame, rooms: list[str] | None = None) -> DataFrame:
    """Group-chat rows of a named room, optionally from an allow-list."""
    rows = messages.filter((F.col("is_chatroom_msg") == 1) & (F.trim("chatroom") != ""))
    return rows.filter(F.col("chatroom").isin(rooms)) if rooms else rows


def first_rows(df: DataFrame, count: int, order: Iterable[str] = ("create_time", "msg_id")) -> DataFrame:
    """The first ``count`` rows in time order."""
    return df.orderBy(*order).limit(count)
