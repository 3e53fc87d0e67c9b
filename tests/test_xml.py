"""XML kinds on literal documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions import xml
from chatlake.operators.enrichment import enrich

KINDS = [
    ("<msg><emoji md5='a'/></msg>", "emoji", None, "emoji"),
    ("<msg><voicemsg length='1'/></msg>", "voicemsg", None, "voicemsg"),
    ("<sysmsg type='x'><a/></sysmsg>", "sysmsg", None, "sysmsg"),
    ("<msg><op><name>lastMessage</name></op></msg>", "op", None, "op:lastMessage"),
    ("<msg><op><name>other</name></op></msg>", "op", None, None),
    ("<msg><op/></msg>", "op", None, None),
    ("<msg><appmsg><type>51</type></appmsg></msg>", "appmsg", 51, "appmsg:type=51"),
    ("<msg><appmsg><type>1</type><refermsg/></appmsg></msg>", "appmsg", 1, "appmsg:type=1+refermsg"),
    ("<msg><appmsg><type>1</type></appmsg></msg>", "appmsg", 1, None),
    ("<msg><appmsg/></msg>", "appmsg", 0, None),
    ("<msg><appmsg><type>x</type></appmsg></msg>", "unknown", None, None),
    ("<msg><img/></msg>", "img", None, None),
    ("<msg><x><emoji/></x></msg>", "unknown", None, None),
    ("<msg><emoji/></msg>tail", "unknown", None, None),
    ("<msg><a></msg>", "unknown", None, None),
    ("plain", "unknown", None, None),
    ("  ", "unknown", None, None),
]


def test_kinds(spark) -> None:
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(KINDS)], "i int, content string")
    parsed = df.withColumn("d", xml.parse(F.col("content")))
    rows = parsed.select("i", xml.classify(F.col("d"), F.col("content")).alias("k")).orderBy("i").collect()
    found = [(r.k.category, r.k.appmsg_type, r.k.filter_reason) for r in rows]
    assert found == [row[1:] for row in KINDS]


APP = "<msg><appmsg><title><![CDATA[a <b>]]></title><type> 57 </type><refermsg><svrid>9</svrid><type>{}</type><content>&lt;q&gt;</content></refermsg></appmsg></msg>"


def test_app_content(spark) -> None:
    rows = [
        (1, APP.format(1), 49), (2, APP.format("x"), 49), (3, APP.format(1), 1),
        (4, "<msg><appmsg><title>t</title><type>5</type><des></des><url>u</url></appmsg></msg>", 49),
    ]
    df = spark.createDataFrame(rows, "i int, content string, msg_type int")
    found = {r.i: r for r in enrich(df).collect()}
    assert found[1].appmsg_title == "a <b>"
    assert found[1].refermsg.asDict() == {"svrid": "9", "type": 1, "content": "<q>", "displayname": "", "createtime": 0}
    assert found[2].appmsg_type == 57 and found[2].refermsg is None
    assert found[3].appmsg_type is None and found[3].should_filter is False
    assert (found[4].appmsg_des, found[4].appmsg_url) == (None, "u")


IMAGES = [
    ('<msg><img aeskey="k" cdnmidimgurl="u" encryver="1" length="12"/></msg>', ("k", "u", 12)),
    ('  <?xml version="1.0"?><msg><img aeskey="k" cdnmidimgurl="u" encryver="1"/></msg> ', ("k", "u", None)),
    ('<msg><img aeskey="k" cdnmidimgurl="u" encryver="1" length="x"/></msg>', None),
    ('<msg><img aeskey="" cdnmidimgurl="u" encryver="1"/></msg>', None),
    ('<msg><img aeskey="k" cdnmidimgurl="u" encryver="2"/></msg>', None),
    ('<root><img aeskey="k" cdnmidimgurl="u" encryver="1"/></root>', None),
    ("encryver text", None),
]


def test_images(spark) -> None:
    from chatlake.operators.images import image_messages

    df = spark.createDataFrame([(str(i), row[0]) for i, row in enumerate(IMAGES)], "msg_id string, content string")
    found = {int(r.msg_id): (r.aes_key, r.cdn_mid_img_url, r.length) for r in image_messages(df).collect()}
    assert found == {i: row[1] for i, row in enumerate(IMAGES) if row[1]}
