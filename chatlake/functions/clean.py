"""Expressions over raw JSON messages.

A document is parsed once into a VARIANT; fields are then read from its binary form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlake import schemas

_MEMBERS = "map<string,variant>"


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def is_json(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull()


def members(document: Column) -> Column:
    """Members of a JSON object, null-valued ones included; null for anything else."""
    return F.try_variant_get(document, "$", _MEMBERS)


def member_text(object_members: Column, name: str) -> Column:
    """A member as text; a nested object or list keeps its JSON form."""
    return F.try_variant_get(F.try_element_at(object_members, F.lit(name)), "$", "string")


def body_of(top: Column) -> Column:
    """Members of the ``data`` object of an envelope, or of the document when it is flat."""
    inner = members(F.try_element_at(top, F.lit("data")))
    wrapped = ~F.map_contains_key(top, "msg_id") & inner.isNotNull()
    return F.when(wrapped, inner).otherwise(top)


def fields_of(document: Column, path: str, names: list[str], kept: list[str]) -> Column:
    """Members of these names of the JSON object at ``path`` as a struct; null for anything else.

    They are texts as ``member_text`` gives them, without a map of all members on the way; those in ``kept`` stay
    variants, which are null only where the object has no such member.
    """
    kinds = [f"`{name}` {'variant' if name in kept else 'string'}" for name in names]
    return F.try_variant_get(document, path, f"struct<{', '.join(kinds)}>")


def lacks(keys: Column, required: list[str]) -> Column:
    """Required names that are not present."""
    return F.array_except(F.array(*[F.lit(name) for name in required]), keys)


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def with_default(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(schemas.INGEST_DEFAULTS[name]))


def number(column: Column) -> Column:
    return column.try_cast("double")


def whole_number(column: Column, kind: str = "bigint") -> Column:
    """An integral value, or null where the text is no number or has a fraction."""
    value = number(column)
    return F.when(value == F.floor(value), value.try_cast(kind))


def as_json_text(column: Column) -> Column:
    return F.to_json(column)
