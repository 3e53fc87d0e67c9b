"""Table layouts and the fixed value lists that go with them."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {
    "string": T.StringType(),
    "tinyint": T.ByteType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def table_of(columns: str) -> T.StructType:
    """A schema from ``name type`` pairs of simple types; needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _SIMPLE[kind]) for name, kind in pairs])


MESSAGES = table_of(
    "msg_id string, from_username string, to_username string, chatroom string, "
    "chatroom_sender string, msg_type int, create_time timestamp, is_chatroom_msg tinyint, "
    "content string, desc string, source string, guid string, notify_type int, "
    "ingestion_time timestamp"
)

# Every scalar as text: ids, numbers and flags arrive with unstable types, and a nested
# object read as string keeps its JSON text.
RAW_MESSAGE = table_of(
    "msg_id string, from_username string, to_username string, chatroom string, "
    "chatroom_sender string, msg_type string, create_time string, is_chatroom_msg string, "
    "content string, desc string, source string, guid string, notify_type string, "
    "ingestion_time string"
)

CONTACTS = table_of(
    "username string, alias string, encryptUserName string, contactType int, "
    "deleteFlag tinyint, verifyFlag int, sex tinyint, country string, province string, "
    "city string, mobile string, nickName string, remark string, snsUserInfo string, "
    "customInfo string, guid string, notify_type int, ingestion_time timestamp"
)

IMAGES = table_of(
    "image_id string, msg_id string, from_username string, create_time timestamp, "
    "aes_key string, cdn_mid_img_url string, status string, download_url string, "
    "error_message string, extracted_at timestamp, downloaded_at timestamp, "
    "has_text boolean, ocr_content string"
)

PARTITION_COLUMNS = ["year", "month", "day"]

# Fields a raw message must carry.
REQUIRED_FIELDS = [
    "msg_id",
    "from_username",
    "to_username",
    "msg_type",
    "create_time",
    "is_chatroom_msg",
    "source",
    "guid",
    "notify_type",
]

# Optional text fields that default to the empty string.
OPTIONAL_TEXT_FIELDS = ["chatroom", "chatroom_sender", "content", "desc"]

# Defaults of the incremental path.
INGEST_DEFAULTS = {
    "from_username": "",
    "to_username": "",
    "msg_type": "0",
    "is_chatroom_msg": "0",
    "source": "",
    "guid": "",
    "notify_type": "0",
}

NUMERIC_FIELDS = ["create_time", "msg_type", "notify_type", "is_chatroom_msg"]

# Notification kinds and their names.
NOTIFY_TYPES = {
    1010: "消息通知",
    1200: "联系人更新",
    1201: "联系人删除",
    1202: "联系人详情",
    1003: "未知类型",
}

# Message kinds and their names.
MESSAGE_TYPES = {
    1: "文本消息",
    3: "图片消息",
    34: "语音消息",
    37: "好友验证",
    42: "名片消息",
    43: "视频消息",
    47: "表情消息",
    48: "位置消息",
    49: "应用消息/链接",
    50: "语音/视频通话",
    51: "微视频/视频号",
    10000: "系统消息",
    10002: "撤回消息",
}
NULL_MESSAGE_TYPE = "空类型"
