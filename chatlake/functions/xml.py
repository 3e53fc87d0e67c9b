"""XML message content: classification, shared links, quotes and encrypted images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of app messages.
FILTERED_APPMSG_TYPES = [3, 47, 51, 124]
REFERMSG_APPMSG_TYPES = [57, 49, 1]
ARTICLE_APPMSG_TYPES = [4, 5]

_REFER = "svrid string, type string, content string, displayname string, createtime string"
_MESSAGE = (
    "emoji array<string>, voicemsg array<string>, op array<struct<name: string>>, "
    "appmsg array<struct<title: string, type: string, des: string, url: string, "
    f"refermsg: array<struct<{_REFER}>>>>, "
    "img array<struct<_aeskey: string, _cdnmidimgurl: string, _encryver: string, "
    "_md5: string, _length: string>>, _corrupt_record string"
)
_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    "ignoreSurroundingSpaces": "false",
}
_ROOT = r"^\s*(?:<\?xml[^>]*\?>)?\s*(?:<!--(?s:.*?)-->\s*)*<([A-Za-z_][A-Za-z0-9_.-]*)"


def parse(content: Column) -> Column:
    """The parts of a message document the other functions look at."""
    return F.from_xml(content, _MESSAGE, _OPTIONS)


def root_name(content: Column) -> Column:
    return F.regexp_extract(content, _ROOT, 1)


def well_formed(document: Column, content: Column) -> Column:
    """False for blank and malformed text, and for text behind the last element."""
    return document.isNotNull() & document["_corrupt_record"].isNull() & content.rlike(r">\s*$")


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _integer(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("0"))).try_cast("int")


def classify(document: Column, content: Column) -> Column:
    """Struct of category, appmsg_type, should_filter and filter_reason."""
    appmsg = _first(document["appmsg"])
    kind = _integer(appmsg["type"])
    name = F.coalesce(_first(document["op"])["name"], F.lit(""))
    quoting = F.coalesce(F.size(appmsg["refermsg"]) > 0, F.lit(False))
    text = F.concat(F.lit("appmsg:type="), kind)

    def found(part: str) -> Column:
        return F.coalesce(F.size(document[part]) > 0, F.lit(False))

    def verdict(category: str, reason: Column | None = None, number: Column | None = None) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            (F.lit(None).cast("int") if number is None else number).alias("appmsg_type"),
            F.lit(reason is not None).alias("should_filter"),
            (F.lit(None).cast("string") if reason is None else reason).alias("filter_reason"),
        )

    return (
        F.when(~F.coalesce(well_formed(document, content), F.lit(False)), verdict("unknown"))
        .when(found("emoji"), verdict("emoji", F.lit("emoji")))
        .when(found("voicemsg"), verdict("voicemsg", F.lit("voicemsg")))
        .when(root_name(content) == "sysmsg", verdict("sysmsg", F.lit("sysmsg")))
        .when(found("op") & (name == "lastMessage"), verdict("op", F.lit("op:lastMessage")))
        .when(found("op"), verdict("op"))
        .when(found("appmsg") & kind.isNull(), verdict("unknown"))
        .when(found("appmsg") & kind.isin(FILTERED_APPMSG_TYPES), verdict("appmsg", text, kind))
        .when(
            found("appmsg") & (kind == 1) & quoting,
            verdict("appmsg", F.lit("appmsg:type=1+refermsg"), kind),
        )
        .when(found("appmsg"), verdict("appmsg", None, kind))
        .when(found("img"), verdict("img"))
        .otherwise(verdict("unknown"))
    )


def refermsg(appmsg: Column) -> Column:
    """The quoted message of an app message; null when absent or its numbers do not parse."""
    quoted = _first(appmsg["refermsg"])
    kind, created = _integer(quoted["type"]), F.trim(
        F.coalesce(quoted["createtime"], F.lit("0"))
    ).try_cast("bigint")
    fields = F.struct(
        F.coalesce(quoted["svrid"], F.lit("")).alias("svrid"),
        kind.alias("type"),
        F.coalesce(quoted["content"], F.lit("")).alias("content"),
        F.coalesce(quoted["displayname"], F.lit("")).alias("displayname"),
        created.alias("createtime"),
    )
    return F.when(quoted.isNotNull() & kind.isNotNull() & created.isNotNull(), fields)


def appmsg_content(document: Column, content: Column) -> Column:
    """Struct of appmsg_type, title, refermsg, des and url; null when not an app message."""
    appmsg = _first(document["appmsg"])
    kind = _integer(appmsg["type"])
    article = kind.isin(ARTICLE_APPMSG_TYPES)

    def article_text(name: str) -> Column:
        return F.when(article, F.nullif(appmsg[name], F.lit("")))

    fields = F.struct(
        kind.alias("appmsg_type"),
        F.coalesce(appmsg["title"], F.lit("")).alias("title"),
        F.when(kind.isin(REFERMSG_APPMSG_TYPES), refermsg(appmsg)).alias("refermsg"),
        article_text("des").alias("des"),
        article_text("url").alias("url"),
    )
    usable = well_formed(document, content) & appmsg.isNotNull() & kind.isNotNull()
    return F.when(usable, fields)


def is_encrypted_image(document: Column, content: Column) -> Column:
    """A ``msg`` document whose ``img`` says ``encryver="1"``."""
    image = _first(document["img"])
    test = (
        well_formed(document, content)
        & (root_name(content) == "msg")
        & (F.coalesce(image["_encryver"], F.lit("")) == "1")
    )
    return F.coalesce(test, F.lit(False))


def image_info(document: Column, content: Column) -> Column:
    """Struct of aes_key, cdn_mid_img_url, md5 and length of an encrypted image, or null."""
    image = _first(document["img"])
    size = F.trim(F.nullif(image["_length"], F.lit(""))).try_cast("bigint")
    readable = F.coalesce(image["_length"], F.lit("")) == ""
    usable = (
        is_encrypted_image(document, content)
        & (F.coalesce(image["_aeskey"], F.lit("")) != "")
        & (F.coalesce(image["_cdnmidimgurl"], F.lit("")) != "")
        & (readable | size.isNotNull())
    )
    fields = F.struct(
        image["_aeskey"].alias("aes_key"),
        image["_cdnmidimgurl"].alias("cdn_mid_img_url"),
        image["_md5"].alias("md5"),
        size.alias("length"),
    )
    return F.when(usable, fields)
