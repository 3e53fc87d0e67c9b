"""Structured columns from XML message content, and joins that follow references."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import xml
from chatlake.operators.shaping import evaluate_once
from chatlake.operators.skew import look_up

# Fixed value: how content refers to a stored image.
IMAGE_REFERENCE = r"^image#([a-f0-9-]+)$"
APP_MESSAGE = 49

Enricher = Callable[[DataFrame], DataFrame]


def enrich(messages: DataFrame) -> DataFrame:
    """Filter flag and reason, or link and quote fields, for app messages.

    Other message kinds are never parsed and keep null in the added columns.
    """
    document = xml.parse(F.when(F.col("msg_type") == APP_MESSAGE, F.col("content")))
    parsed = evaluate_once(messages, {"_doc": document})
    doc, content = F.col("_doc"), F.col("content")
    judged = evaluate_once(
        parsed,
        {
            "_kind": F.when(doc.isNotNull(), xml.classify(doc, content)),
            "_app": xml.appmsg_content(doc, content),
        },
    )
    skip = F.coalesce("_kind.should_filter", F.lit(False))
    app = F.when(~skip, F.col("_app"))
    return judged.select(
        *messages.columns,
        skip.alias("should_filter"),
        F.when(skip, F.col("_kind.filter_reason")).alias("filter_reason"),
        app["appmsg_type"].alias("appmsg_type"),
        app["title"].alias("appmsg_title"),
        app["refermsg"].alias("refermsg"),
        app["des"].alias("appmsg_des"),
        app["url"].alias("appmsg_url"),
    )


def apply_enrichers(messages: DataFrame, enrichers: Iterable[Enricher]) -> DataFrame:
    """Run a chain of enrichers, each a function from DataFrame to DataFrame."""
    return reduce(DataFrame.transform, enrichers, messages)


def image_id_of(content: Column) -> Column:
    """The image a message refers to, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(content, F.lit("")), IMAGE_REFERENCE, 1), F.lit(""))


def message_class(enriched: DataFrame) -> Column:
    """filtered, share, quote, image or text, in this order of precedence."""
    kind = F.col("appmsg_type") if "appmsg_type" in enriched.columns else F.lit(None).cast("int")
    return (
        F.when(F.col("should_filter"), "filtered")
        .when(kind.isin(xml.ARTICLE_APPMSG_TYPES), "share")
        .when(kind.isin(xml.REFERMSG_APPMSG_TYPES) & F.col("refermsg").isNotNull(), "quote")
        .when(image_id_of(F.col("content")).isNotNull(), "image")
        .otherwise("text")
    )


def with_images(messages: DataFrame, images: DataFrame) -> DataFrame:
    """OCR text, text flag, status and link of the image each message refers to.

    ``images`` is the current image table, unique by ``image_id``.
    """
    facts = images.select(
        "image_id",
        F.nullif("ocr_content", F.lit("")).alias("ocr_content"),
        F.col("has_text"),
        F.col("status").alias("image_status"),
        F.nullif("download_url", F.lit("")).alias("image_url"),
    )
    referring = messages.withColumn("image_id", image_id_of(F.col("content")))
    return look_up(referring, facts, ["image_id"], "msg_id")


def resolve_quotes(
    messages: DataFrame, earlier_only: bool = False, targets: DataFrame | None = None
) -> DataFrame:
    """Sequence number of the quoted message in the same room, null when it is not there.

    With ``earlier_only`` the quoted message must be in the same batch or an earlier one; of
    copies of an id the last one that is allowed counts.
    ``targets`` may give the messages before enrichment, so that they are not parsed twice.
    """
    numbered = messages if targets is None else targets
    if earlier_only:
        return _resolve_earlier(messages, numbered)
    # of messages that share an id the last one counts
    places_of = (
        numbered.groupBy("chatroom", F.col("msg_id").alias("_svrid"))
        .agg(F.max("seq_id").alias("refers_to_seq_id"))
    )
    quoting = messages.withColumn("_svrid", F.nullif("refermsg.svrid", F.lit("")))
    joined = look_up(quoting, places_of, ["chatroom", "_svrid"], "msg_id")
    return joined.select(*messages.columns, "refers_to_seq_id")


def _resolve_earlier(messages: DataFrame, numbered: DataFrame) -> DataFrame:
    """Quote links to the last copy in the same batch or an earlier one.

    Copies are first reduced to one per id and batch; only quoting rows meet them.
    """
    copies = numbered.groupBy("chatroom", F.col("msg_id").alias("_svrid"), F.col("batch_index").alias("_batch")).agg(
        F.max("seq_id").alias("_place")
    )
    quoting = messages.select(
        "chatroom", "seq_id", "batch_index", F.nullif("refermsg.svrid", F.lit("")).alias("_svrid")
    ).filter(F.col("_svrid").isNotNull())
    allowed = quoting.join(copies, ["chatroom", "_svrid"]).filter(F.col("_batch") <= F.col("batch_index"))
    found = allowed.groupBy("chatroom", "seq_id").agg(F.max("_place").alias("refers_to_seq_id"))
    return messages.join(found, ["chatroom", "seq_id"], "left").select(*messages.columns, "refers_to_seq_id")


def topic_members(topics: DataFrame) -> DataFrame:
    """One row per topic and message id, with the place of the id in the list.

    This long form is what the topic operators work on, so a topic may have any size.
    Members are in the order of ``pos`` and ``msg_id``.
    """
    return topics.select("chatroom", "topic_no", F.posexplode("message_ids").alias("pos", "msg_id"))


def topic_messages(members: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of each topic; ids without a message are dropped.

    ``messages`` is unique by chatroom and id.
    """
    return members.join(messages, ["chatroom", "msg_id"])
