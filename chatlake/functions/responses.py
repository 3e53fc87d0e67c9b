"""Topics of a model response as one SQL expression, for columns and as a function of SQL.

A block of lines falls into segments: a line ``name: value`` and the lines up to the next such line. Where
segments begin is known for all lines at once, so no line waits for the one before it. The last segment of a name
gives a text field, all segments of a name together a list field.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Marks of the response protocol and its defaults.
RESULT_START = "<<<RESULT_START>>>"
RESULT_END = "<<<RESULT_END>>>"
TOPIC_MARK = "<<<TOPIC>>>"
UNTITLED = "未命名话题"
OTHER = "其他"
LIST_FIELDS = ["participants", "message_ids", "message_indices", "keywords"]
ALIASES = {"topic_title": "title", "topic_summary": "summary"}

TOPIC_TYPE = (
    "struct<block_no: int, title: string, category: string, summary: string, time_range: string, notes: string, "
    "participants: array<string>, message_ids: array<string>, message_indices: array<string>, keywords: array<string>, "
    "message_count: int, confidence: double>"
)

_BLANK = r"[\s\x1c-\x1f]"
_NAMED = r"(?U)^([A-Za-z_]+)\s*:\s*(.*)$"
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def _let(name: str, value: str, body: str) -> str:
    """The body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, r'(?U)^{_BLANK}+|{_BLANK}+$', '')"


def _full(items: str) -> str:
    """Items without blanks around them, and without those that are nothing else."""
    return f"filter(transform({items}, i -> {_strip('i')}), i -> i != '')"


def _text(name: str) -> str:
    of_name = f"filter(segments, s -> s.name = '{name}')"
    joined = _strip("array_join(concat(array(element_at(found, -1).value), element_at(found, -1).more), ' ')")
    return _let("found", of_name, f"case when size(found) > 0 then {joined} end")


def _list(name: str) -> str:
    quotes = f"regexp_replace(regexp_replace({_strip('v')}, '^\"+|\"+$', ''), r\"^'+|'+$\", '')"
    given = f"transform(split(s.value, '[,，]'), v -> {quotes})"
    listed = f"transform(s.more, m -> case when startswith(m, '- ') then substring(m, 3) else m end)"
    of_name = f"filter(segments, s -> s.name = '{name}')"
    return _full(f"flatten(transform({of_name}, s -> concat({given}, {listed})))")


def _number(name: str) -> str:
    """The last value as a double, null if it is none; digits may be grouped by underscores."""
    digits = r"regexp_replace(t, r'(?<=\d)_(?=\d)', '')"
    return _let("t", _text(name), f"case when {digits} rlike r'{_NUMBER}' then try_cast({digits} as double) end")


def _segments(block: str) -> str:
    """name, value and following lines of each named line; a META line ends what stands before it."""
    lines = _full(rf"split({block}, r'\R|[\x1c-\x1e]')")
    starts = f"filter(sequence(1, size(lines)), k -> startswith(lines[k - 1], 'META') or lines[k - 1] rlike r'{_NAMED}')"
    bounds = f"case when size(lines) > 0 then {starts} else array() end"
    name = rf"lower(regexp_extract(lines[k - 1], r'{_NAMED}', 1))"
    plain = f"case {name} " + " ".join(f"when '{a}' then '{b}'" for a, b in ALIASES.items()) + f" else {name} end"
    following = "slice(lines, k + 1, coalesce(get(bounds, j + 1), size(lines) + 1) - k - 1)"
    segment = f"named_struct('name', {plain}, 'value', regexp_extract(lines[k - 1], r'{_NAMED}', 2), 'more', {following})"
    # positions are paired with their number first, as a filter after it would number anew
    every = f"transform(bounds, (k, j) -> case when not startswith(lines[k - 1], 'META') then {segment} end)"
    return _let("lines", lines, _let("bounds", bounds, f"filter({every}, s -> s is not null)"))


def _topic(block: str, number: str) -> str:
    usable = "count is not null and not isnan(count) and abs(count) < 2147483648D"
    whole = _let("count", _number("message_count"), f"case when {usable} then greatest(0, cast(count as int)) else size(ids) end")
    fields = [
        ("block_no", number),
        ("title", f"coalesce(nullif({_text('title')}, ''), '{UNTITLED}')"),
        ("category", f"coalesce(nullif({_text('category')}, ''), '{OTHER}')"),
        *[(name, f"coalesce({_text(name)}, '')") for name in ("summary", "time_range", "notes")],
        *[(name, "ids" if name == "message_ids" else _list(name)) for name in LIST_FIELDS],
        ("message_count", whole),
        ("confidence", f"coalesce({_number('confidence')}, 1.0D)"),
    ]
    struct = "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields) + ")"
    row = _let("ids", _list("message_ids"), struct)
    return _let("segments", _segments(block), f"case when size(segments) > 0 then {row} end")


def envelope_sql(response: str) -> str:
    """The text between the result marks; a missing mark leaves its side open."""
    opened = f"case when contains({response}, '{RESULT_START}') then substring({response}, locate('{RESULT_START}', {response}) + {len(RESULT_START)}) else {response} end"
    return f"substring_index({opened}, '{RESULT_END}', 1)"


def topics_sql(response: str) -> str:
    """An array of the topics of a response; empty if it has no topic mark."""
    blocks = rf"split(inside, r'(?m)^[ \t]*{TOPIC_MARK}[ \t\r]*$')"
    parsed = f"filter(transform({blocks}, (b, n) -> {_topic('b', 'n')}), t -> t is not null)"
    marked = f"case when contains(inside, '{TOPIC_MARK}') then {parsed} else cast(array() as array<{TOPIC_TYPE}>) end"
    return f"cast({_let('inside', envelope_sql(response), marked)} as array<{TOPIC_TYPE}>)"


def topics_of(column: str) -> Column:
    return F.expr(topics_sql(f"`{column}`"))


def register_parse_topics(spark: SparkSession) -> None:
    """``parse_topics(response)`` as a table function of SQL: ``from answers a, lateral parse_topics(a.response) t``."""
    columns = TOPIC_TYPE.removeprefix("struct<").removesuffix(">").replace(":", "")
    spark.sql(
        f"create or replace temporary function parse_topics(response string) returns table ({columns}) "
        f"return select t.* from (select explode({topics_sql('response')}) as t)"
    )
