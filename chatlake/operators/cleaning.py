"""From raw JSON lines to clean message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake import schemas
from chatlake.functions import clean
from chatlake.operators.shaping import evaluate_once

RAW_PREVIEW = 500  # characters of a refused line that reports show; the whole line is kept beside it
INHERITED_FIELDS = ["guid", "notify_type"]  # an envelope gives them to a message that lacks them
VALID_SECONDS = (-62135596800, 253402300799)  # the years 1 to 9999


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``doc``, the parsed JSON, and ``line_kind``: ``blank``, ``bad`` or ``ok``."""
    parsed = evaluate_once(lines, {"doc": F.try_parse_json(column)})
    kind = (
        F.when(clean.is_blank(F.col(column)), "blank")
        .when(F.col("doc").isNull(), "bad")
        .otherwise("ok")
    )
    return parsed.withColumn("line_kind", kind)


def valid_lines(lines: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """Non-blank lines holding JSON; in strict mode a malformed line fails the job."""
    if strict:
        filled = lines.filter(~clean.is_blank(F.col(column)))
        return filled.withColumn("doc", F.parse_json(column))
    return parse_lines(lines, column).filter(F.col("line_kind") == "ok").drop("line_kind")


def extract_payload(parsed: DataFrame) -> DataFrame:
    """Flatten envelopes of parsed lines: one text column per message field.

    ``present`` lists the names the message carries, null-valued ones included;
    ``guid`` and ``notify_type`` come from the envelope when the message lacks them.
    """
    inherited = INHERITED_FIELDS
    tops = evaluate_once(parsed, {"_top": clean.members(F.col("doc"))})
    opened = evaluate_once(tops, {"_body": clean.body_of(F.col("_top"))})
    body, top = F.col("_body"), F.col("_top")
    fields: dict[str, Column] = {}
    for name in schemas.RAW_MESSAGE.names:
        own = clean.member_text(body, name)
        if name in inherited:
            own = F.when(F.map_contains_key(body, name), own).otherwise(
                clean.member_text(top, name)
            )
        fields[name] = own
    outer = F.array_intersect(F.map_keys(top), F.array(*[F.lit(name) for name in inherited]))
    fields["present"] = F.coalesce(
        F.array_union(F.map_keys(body), outer), F.array().cast("array<string>")
    )
    return evaluate_once(opened.drop("doc"), fields).drop("_top")


def payload_fields(parsed: DataFrame) -> DataFrame:
    """The text columns of ``extract_payload`` alone, for lines whose other members are of no interest.

    Only the members of a message are read, so a line costs less than with a map of all of them.
    """
    doc, top, inner = F.col("doc"), F.col("_top"), F.col("_inner")
    names = schemas.RAW_MESSAGE.names
    opened = evaluate_once(
        parsed,
        {
            "_top": clean.fields_of(doc, "$", names, ["msg_id"]),
            "_inner": clean.fields_of(doc, "$.data", names, INHERITED_FIELDS),
        },
    )
    fields: dict[str, Column] = {}
    for name in names:
        outer, own = top[name], inner[name]
        if name == "msg_id":
            outer = F.try_variant_get(outer, "$", "string")
        if name in INHERITED_FIELDS:
            own = F.when(own.isNull(), outer).otherwise(F.try_variant_get(own, "$", "string"))
        fields[name] = F.when(top["msg_id"].isNull() & inner.isNotNull(), own).otherwise(outer)
    return evaluate_once(opened.drop("doc"), fields).drop("_top", "_inner")


def clean_fields(df: DataFrame) -> DataFrame:
    """Text ``source`` and empty strings for the optional text fields."""
    names = ["source", *schemas.OPTIONAL_TEXT_FIELDS]
    return df.withColumns({n: clean.text_or_empty(F.col(n)) for n in names if n in df.columns})


def has_required(present: str = "present") -> Column:
    return F.size(clean.lacks(F.col(present), schemas.REQUIRED_FIELDS)) == 0


def required_only(df: DataFrame) -> DataFrame:
    """Rows whose JSON names every required field; an explicit null counts as present."""
    return df.filter(has_required())


def prepare_messages(df: DataFrame) -> DataFrame:
    """Drop rows without id or time, clean, fill defaults and stamp the ingestion time."""
    usable = (F.coalesce("msg_id", F.lit("")) != "") & (F.coalesce("create_time", F.lit("")) != "")
    filled = clean_fields(df.filter(usable)).withColumns(
        {name: clean.with_default(name) for name in schemas.INGEST_DEFAULTS}
    )
    return filled.withColumn("ingestion_time", _stamp())


def _stamp() -> Column:
    given = F.col("ingestion_time").try_cast("timestamp")
    return F.date_trunc("second", F.coalesce(given, F.current_timestamp()))


def _numbers(df: DataFrame) -> DataFrame:
    return evaluate_once(df, {n: clean.whole_number(F.col(n)) for n in schemas.NUMERIC_FIELDS})


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Keep rows whose numeric fields hold whole numbers, as numbers."""
    return _numbers(df).dropna(subset=schemas.NUMERIC_FIELDS)


def with_day(df: DataFrame, column: str = "create_time") -> DataFrame:
    """Add ``year``, ``month`` and ``day`` from Unix seconds or a timestamp, in UTC."""
    value = F.col(column)
    if not isinstance(df.schema[column].dataType, T.TimestampType):
        value = F.timestamp_seconds(value)
    return df.withColumns(
        {"year": F.year(value), "month": F.month(value), "day": F.dayofmonth(value)}
    )


def times_to_timestamp(df: DataFrame, column: str = "create_time") -> DataFrame:
    """Turn an integral time column into a timestamp; any other type is left alone."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return df.withColumn(column, F.timestamp_seconds(column))
    return df


def conform(df: DataFrame, schema: T.StructType = schemas.MESSAGES) -> DataFrame:
    """Exactly the columns of ``schema``: added as null, ordered, cast; extras dropped."""
    present = set(df.columns)
    columns = []
    for field in schema.fields:
        source = F.col(f"`{field.name}`") if field.name in present else F.lit(None)
        columns.append(source.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def keep_unknown(extracted: DataFrame) -> DataFrame:
    """Unknown payload fields of extracted rows, kept as one JSON text in ``extra``."""
    known = F.array(*[F.lit(name) for name in schemas.RAW_MESSAGE.names])
    unknown = F.map_filter("_body", lambda name, _: ~F.array_contains(known, name))
    return extracted.withColumn("extra", F.when(F.size(unknown) > 0, F.to_json(unknown)))


def messages_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The incremental chain, from JSON text to rows of the message table: ids and times
    must be there, other missing fields take their defaults."""
    typed = coerce_numbers(prepare_messages(extract_payload(valid_lines(lines, column))))
    return conform(with_valid_time(typed))


def with_valid_time(df: DataFrame) -> DataFrame:
    """Rows whose Unix time lies in the years 1 to 9999, with the time as a timestamp."""
    return times_to_timestamp(df.filter(F.col("create_time").between(*VALID_SECONDS)))


def judge_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Every line once, with the typed fields of the incremental chain and ``error_type``.

    ``error_type`` is null for a line that becomes a row, ``blank``, ``parse_error`` (no JSON),
    ``schema_error`` (no id or no time) or ``validation_error`` (a number that is none, or a time
    outside the years 1 to 9999). So one parse feeds the table, the quarantine and the counts.
    """
    opened = payload_fields(parse_lines(lines, column))
    lacking = [F.when(F.coalesce(n, F.lit("")) == "", F.lit(n)) for n in ("msg_id", "create_time")]
    filled = clean_fields(opened.withColumn("missing_fields", F.concat_ws(",", *lacking))).withColumns(
        {name: clean.with_default(name) for name in schemas.INGEST_DEFAULTS}
    )
    typed = _numbers(filled.withColumn("ingestion_time", _stamp()))
    unusable = F.coalesce(~F.col("create_time").between(*VALID_SECONDS), F.lit(True))
    for name in schemas.NUMERIC_FIELDS:
        unusable = unusable | F.col(name).isNull()
    kind = (
        F.when(F.col("line_kind") == "blank", "blank")
        .when(F.col("line_kind") == "bad", "parse_error")
        .when(F.col("missing_fields") != "", "schema_error")
        .when(unusable, "validation_error")
    )
    return typed.withColumn("error_type", kind).drop("line_kind")


def complete_messages(parsed: DataFrame) -> DataFrame:
    """The full-conversion chain for parsed lines: every required field must be named.

    A named field may be null; only a row whose time is no valid time is dropped.
    """
    rows = _numbers(clean_fields(required_only(extract_payload(parsed))))
    return conform(with_valid_time(rows.withColumn("ingestion_time", _stamp())))


def quarantine(lines: DataFrame, column: str = "value") -> DataFrame:
    """Dead-letter rows of one pass: bad JSON, missing fields, unusable values."""
    tagged = parse_lines(lines, column).filter(F.col("line_kind") != "blank")
    opened = extract_payload(tagged)
    missing = clean.lacks(F.col("present"), schemas.REQUIRED_FIELDS)
    unusable = F.coalesce("msg_id", F.lit("")) == ""
    for name in schemas.NUMERIC_FIELDS:
        unusable = unusable | clean.whole_number(F.col(name)).isNull()
    unusable = unusable | ~clean.whole_number(F.col("create_time")).between(*VALID_SECONDS)
    judged = evaluate_once(opened, {"_missing": missing, "_unusable": unusable})
    kind = (
        F.when(F.col("line_kind") == "bad", "parse_error")
        .when(F.size("_missing") > 0, "schema_error")
        .when(F.col("_unusable"), "validation_error")
    )
    names = F.when(F.col("error_type") == "schema_error", F.array_join("_missing", ","))
    return (
        judged.withColumn("error_type", kind)
        .filter(F.col("error_type").isNotNull())
        .withColumn("missing_fields", F.coalesce(names, F.lit("")))
        .withColumns({"line": F.col(column), "raw": F.left(column, F.lit(RAW_PREVIEW))})
        .drop("_missing", "_unusable", "_body", "present", "line_kind", *({column} - {"line", "raw"}))
    )


def route_events(lines: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """Split envelopes by notification kind; each branch holds the ``data`` JSON."""
    head = F.from_json(F.col(column), "guid string, notify_type int, data string")
    opened = lines.withColumn("_e", head).select("_e.*")
    codes = {"messages": 1010, "contact_updates": 1200, "contact_deletes": 1201,
             "contact_details": 1202}
    return {name: opened.filter(F.col("notify_type") == code) for name, code in codes.items()}


def contacts_from_events(events: DataFrame) -> DataFrame:
    """Contact table rows from ``guid, notify_type, data`` rows of any contact branch."""

    def first_of(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object("data", f"$.{path}") for path in paths])

    def text(*paths: str) -> Column:
        return F.coalesce(first_of(*paths), F.lit(""))

    def whole(path: str) -> Column:
        return F.coalesce(first_of(path).try_cast("int"), F.lit(0))

    def document(*paths: str) -> Column:
        return F.coalesce(first_of(*paths), F.lit("{}"))

    named = events.select(
        text("userName.string", "userName", "username", "tpUsername").alias("username"),
        text("alias").alias("alias"),
        text("encryptUserName").alias("encryptUserName"),
        whole("contactType").alias("contactType"),
        whole("deleteFlag").alias("deleteFlag"),
        whole("verifyFlag").alias("verifyFlag"),
        whole("sex").alias("sex"),
        *[text(name).alias(name) for name in ("country", "province", "city", "mobile")],
        document("nickName", "nickname").alias("nickName"),
        *[document(name).alias(name) for name in ("remark", "snsUserInfo", "customInfo")],
        F.col("guid"),
        F.col("notify_type"),
        F.date_trunc("second", F.current_timestamp()).alias("ingestion_time"),
    )
    return conform(named, schemas.CONTACTS)


def message_violations() -> Column:
    """Names of the message value rules a row breaks."""
    rules = {
        "msg_type": F.col("msg_type") >= 0,
        "create_time": F.unix_timestamp("create_time") > 0,
        "is_chatroom_msg": F.col("is_chatroom_msg").isin(0, 1),
        "notify_type": F.col("notify_type") >= 0,
    }
    return _broken(rules)


def contact_violations() -> Column:
    """Names of the contact value rules a row breaks."""
    rules = {
        "contactType": F.col("contactType") >= 0,
        "deleteFlag": F.col("deleteFlag").isin(0, 1),
        "verifyFlag": F.col("verifyFlag") >= 0,
        "sex": F.col("sex").isin(0, 1, 2),
        "notify_type": F.col("notify_type") >= 0,
    }
    return _broken(rules)


def _broken(rules: dict[str, Column]) -> Column:
    marks = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*marks))
