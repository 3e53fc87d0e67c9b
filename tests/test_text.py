"""Times, lines, masking and sessions on literal cases."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from chatlake.functions import privacy
from chatlake.functions import text as line


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("first", "second", "merged"),
    [
        ("10:00-11:00", "09:30-10:15", "09:30-11:00"),
        ("10:00-11:00", "09:30:05", "09:30:05-11:00:00"),
        ("", "9:05", "9:05"),
        ("soon", "", "soon"),
        ("9:05-9:10", "09:05", "9:05-9:10"),
        ("2024-01-01 23:59", "0:01", "0:01-23:59"),
    ],
)
def test_merged_ranges(spark, first: str, second: str, merged: str) -> None:
    assert _one(spark, m=line.merge_time_ranges(F.lit(first), F.lit(second))).m == merged


def test_ranges_with_and_without_seconds(spark) -> None:
    at = [F.timestamp_seconds(F.lit(s)) for s in (1704067200, 1704070800, 1704153605)]
    row = _one(
        spark, short=line.time_range(at[0], at[1]), long=line.time_range(at[0], at[2]),
        day=line.date_range(at[0], at[1]), days=line.date_range(at[0], at[2]), none=line.date_range(F.lit(None), F.lit(None)),
    )
    assert (row.short, row.long) == ("00:00-01:00", "00:00:00-00:00:05")
    assert (row.day, row.days, row.none) == ("2024-01-01", "2024-01-01 to 2024-01-02", "")


COLUMNS = (
    "create_time timestamp, chatroom_sender string, from_username string, content string, seq_id long, should_filter boolean, "
    "appmsg_type int, appmsg_title string, refermsg struct<content:string,displayname:string>"
)


def _line(spark, options=line.LineFormat(), **values) -> str:
    fields = {
        "create_time": None, "chatroom_sender": "", "from_username": "u", "content": " a\nb ", "seq_id": 7, "should_filter": False,
        "appmsg_type": None, "appmsg_title": None, "refermsg": None, **values,
    }
    return spark.createDataFrame([tuple(fields.values())], COLUMNS).select(line.message_line(options).alias("t")).first().t


def test_lines(spark) -> None:
    assert _line(spark) == "unknown-time u: a b"
    assert _line(spark, from_username=None, content=None) == "unknown-time unknown: "
    assert _line(spark, should_filter=True) == ""
    assert _line(spark, line.LineFormat(prompt_version="v2", max_content_length=2)) == "[7] unknown-time u: a..."
    assert _line(spark, content="image#ab-1") == "unknown-time u: [图片]"
    assert _line(spark, line.LineFormat(mark_images=False), content="image#ab-1") == "unknown-time u: image#ab-1"
    quote = {"appmsg_type": 57, "appmsg_title": " yes ", "refermsg": ("x" * 29 + " yz", "")}
    assert _line(spark, **quote) == f"unknown-time u: [引用 @?: {'x' * 29}...] yes"
    assert _line(spark, line.LineFormat(show_quotes=False), **quote) == "unknown-time u: a b"
    assert _line(spark, appmsg_type=5, appmsg_title=" T ") == "unknown-time u: [分享] T"
    assert _line(spark, appmsg_type=5, appmsg_title=" ") == "unknown-time u: a b"


def test_token_counts(spark) -> None:
    count = line.token_counter(lambda: str.split)
    row = _one(spark, exact=count(F.lit("a b c")), rough=line.estimate_tokens(F.lit("abcdefghi")), least=line.estimate_tokens(F.lit("")))
    assert (row.exact, row.rough, row.least) == (3, 2, 1)


def test_masking(spark) -> None:
    row = _one(spark, a=privacy.mask_secret(F.lit("test_secret")), b=privacy.mask_secret(F.lit("abcd")), c=privacy.hash_pii(F.lit("x")))
    assert (row.a, row.b, len(row.c)) == ("test***", "***", 8)


def test_report_file_and_scratch(spark, tmp_path) -> None:
    from chatlake.catalog import registry
    from chatlake.plans import report
    from chatlake.session import cut_lineage, drop_scratch, shared_dir

    rows = spark.createDataFrame([("r", 1, "## t", "l", "w", "b")], "chatroom string, rank int, heading string, label string, times string, body string")
    report.write_report(cut_lineage(rows), str(tmp_path / "report"), "2024-01-01")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "# 群聊消息分析报告" in text and "## t\nl\nw\nb" in text
    mine = os.path.join(shared_dir(spark), "chatlake", spark.sparkContext.applicationId)
    assert os.path.isdir(mine)
    assert drop_scratch(spark) and not os.path.isdir(mine)
    registry._LAKES.clear()


def test_keywords_alike_in_both_forms(spark) -> None:
    from chatlake.functions import text as line
    from chatlake.functions import topics as fn

    words = ["x²", "नि", "a‿b", "a_b", "Ⅷ-ⅸ", "Ünïc ôde!", "消息，通知", "١٢٣", "½ cup"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", line.normalize_keyword(F.col("w")).alias("k"))
    found = {r.w: r.k for r in rows.collect()}
    assert [found[w] for w in words] == fn.plain_keywords(words)
    assert found["x²"] == "x²" and found["नि"] == "न" and found["a‿b"] == "ab"
