"""Topic parsing, merging and functions on literal cases."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from chatlake.functions import responses
from chatlake.functions import topics as fn
from chatlake.operators import topics as top

TOPICS = (
    "chatroom string, topic_no long, keywords array<string>, participants array<string>, "
    "message_ids array<string>, message_count int, confidence double, title string, "
    "category string, summary string, time_range string, notes string"
)


def _similar(first: list[str], second: list[str]) -> float:
    used: set[int] = set()
    for word in first:
        for i, other in enumerate(second):
            if i not in used and (
                word in other or other in word or SequenceMatcher(None, word, other).ratio() >= 0.7
            ):
                used.add(i)
                break
    return len(used) / max(len(first), len(second)) if first and second else 0.0


def _merge_by_hand(rows: list[dict]) -> list[dict]:
    kept: list[dict] = []
    for topic in sorted(rows, key=lambda t: -t["message_count"]):
        match = next(
            (k for k in kept if _similar([w.lower() for w in k["keywords"]], [w.lower() for w in topic["keywords"]]) >= 0.4),
            None,
        )
        if match is None:
            kept.append({**topic, "all": set(topic["message_ids"])})
            continue
        big, small = (topic, match) if topic["message_count"] > match["message_count"] else (match, topic)
        weights = max(1, big["message_count"]), max(1, small["message_count"])
        union = set(match["message_ids"]) | set(topic["message_ids"])
        count = len(union) or match["message_count"] + topic["message_count"]
        notes = big["notes"] if small["notes"] in ("", big["notes"]) else f"{big['notes']}；{small['notes']}" if big["notes"] else small["notes"]
        match.update(
            confidence=(big["confidence"] * weights[0] + small["confidence"] * weights[1]) / sum(weights),
            title=big["title"] or small["title"],
            notes=notes,
            keywords=sorted({*big["keywords"], *small["keywords"]}),
            participants=sorted({*big["participants"], *small["participants"]}),
            message_ids=sorted(union),
            message_count=count,
        )
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_merge_matches_the_loop(spark, seed: int) -> None:
    rng = random.Random(seed)
    vocabulary = ["stock", "stocks", "fund", "fundings", "weather", "Rain", "rainy", "game", "gamer", "票", "股票", "zz"]
    rows = []
    for number in range(60):
        size = rng.randint(0, 6)
        rows.append(
            {
                "chatroom": rng.choice(["a", "b"]), "topic_no": number,
                "keywords": rng.sample(vocabulary, rng.randint(0, 4)),
                "participants": [f"u{rng.randrange(6)}"], "message_ids": [f"m{rng.randrange(80):02d}" for _ in range(size)],
                "message_count": size, "confidence": rng.random(), "title": rng.choice(["", f"t{number}"]),
                "category": "", "summary": "", "time_range": "", "notes": rng.choice(["", "n1", "n2"]),
            }
        )
    names = [part.split()[0] for part in TOPICS.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], TOPICS)
    found = {(r.chatroom, r.topic_no): r for r in top.merge_topics(df).collect()}
    expected = [k for room in ("a", "b") for k in _merge_by_hand([r for r in rows if r["chatroom"] == room])]
    assert len(found) == len(expected)
    for kept in expected:
        row = found[kept["chatroom"], kept["topic_no"]]
        assert row.message_count == kept["message_count"]
        assert sorted(row.message_ids) == sorted(kept["message_ids"])
        assert sorted(row.keywords) == sorted(set(kept["keywords"]))
        assert row.participants == sorted(kept["participants"])
        assert row.confidence == pytest.approx(kept["confidence"])
        assert (row.title, row.notes) == (kept["title"], kept["notes"])


def test_own_rule_sees_every_kept_topic(spark) -> None:
    df = spark.createDataFrame(
        [("a", 1, ["x"], 3), ("a", 2, ["y"], 2), ("a", 3, ["z"], 1)],
        "chatroom string, topic_no long, keywords array<string>, message_count int",
    )
    rows = top.assign_merges(df, should_merge=lambda kept, new: kept == ["y"] and new == ["z"]).collect()
    assert {r.topic_no: r.kept_no for r in rows} == {1: 1, 2: 2, 3: 2}


RESPONSE = """preface
<<<RESULT_START>>>
META: version 1
topic_title: early
<<<TOPIC>>>
keywords: a, "b"，c
- d
  <<<TOPIC>>>
Topic_Summary: first line
second line
participants:
- x, y
- z
loose item
message_ids: m1
message_count: about ten
confidence: high
time_range: 10:00-11:00
<<<TOPIC>>>
<<<RESULT_END>>>
title: late"""


def test_response_rules(spark) -> None:
    df = spark.createDataFrame([(1, RESPONSE), (2, "none"), (3, "<<<TOPIC>>>\nMETA\n")], "n int, response string")
    rows = {r.block_no: r for r in top.parse_responses(df).filter("n = 1").collect()}
    assert sorted(rows) == [0, 1, 2]
    assert rows[0].title == "early"
    assert rows[1].keywords == ["a", "b", "c", "d"]
    assert rows[2].title == top.UNTITLED
    assert rows[2].summary == "first line second line"
    assert rows[2].participants == ["x, y", "z", "loose item"]
    assert (rows[2].message_ids, rows[2].message_count, rows[2].confidence) == (["m1"], 1, 1.0)
    assert rows[2].time_range == "10:00-11:00"
    warnings = {r.n: r.warning for r in top.parse_warnings(df, ["n"]).collect()}
    assert warnings == {2: "no_topic_blocks_found", 3: "no_topics_parsed"}


def _written(rng: random.Random) -> tuple[str, dict | None]:
    """A topic as a model might write it, and what it says."""
    text, said = [], {"title": "", "category": "", "summary": "", "time_range": "", "notes": "", "count": None, "confidence": 1.0}
    lists: dict[str, list[str]] = {"participants": [], "message_ids": [], "message_indices": [], "keywords": []}
    names = list(lists) + ["title", "category", "summary", "time_range", "notes", "message_count", "confidence"]
    fields = [rng.choice(names) for _ in range(rng.randint(0, 9))]
    for name in fields:
        spelt = rng.choice([name, name.upper(), {"title": "Topic_Title", "summary": "topic_summary"}.get(name, name)])
        gap = rng.choice([": ", ":", " : ", ":\u3000"])
        if name in lists:
            inline, listed = ([f"i{rng.randrange(50)}" for _ in range(rng.randint(0, 3))] for _ in range(2))
            quote = rng.choice(["", '"', "'"])
            text.append(spelt + gap + rng.choice([",", "，", " , "]).join(f"{quote}{item}{quote}" for item in inline))
            text += [rng.choice(["- ", "  - ", "", " "]) + item for item in listed]
            lists[name] += inline + listed
        elif name == "message_count":
            value, said["count"] = rng.choice([("12", 12), ("1e2", 100), ("-3", 0), ("many", None), ("nan", None), ("5d", None), ("1_0", 10), ("2.9", 2), ("9999999999", None)])
            text.append(spelt + gap + value)
        elif name == "confidence":
            value, said["confidence"] = rng.choice([("0.25", 0.25), ("high", 1.0), (".5", 0.5), ("", 1.0)])
            text.append(spelt + gap + value)
        else:
            parts = [f"p{rng.randrange(50)} q" for _ in range(rng.randint(0, 3))]
            text.append(spelt + gap + (parts[0] if parts else ""))
            text += [rng.choice(["", "   "]) + part for part in parts[1:]]
            said[name] = " ".join(parts)
        text += rng.choice([[], [], [""], ["  \t"], ["META note: 1", "lost line", "- lost too"]])
    said["count"] = len(lists["message_ids"]) if said["count"] is None else said["count"]
    said["title"], said["category"] = said["title"] or top.UNTITLED, said["category"] or top.OTHER
    stray = rng.choice([[], ["stray line"], ["META head: x"]])
    return rng.choice(["\n", "\r\n"]).join(stray + text), {**said, **lists} if fields else None


def test_written_topics_are_read_back(spark) -> None:
    rng = random.Random(9)
    rows, wanted = [], []
    for number in range(300):
        blocks = [_written(rng) for _ in range(rng.randint(1, 4))]
        mark = rng.choice(["<<<TOPIC>>>", "  <<<TOPIC>>>\t"])
        body = "\n" + "".join(f"{mark}\n{text}\n" for text, _ in blocks)
        rows.append((number, rng.choice([body, f"title: no<<<RESULT_START>>>{body}<<<RESULT_END>>>\ntitle: no"])))
        wanted += [(number, i, tuple(said.values())) for i, (_, said) in enumerate(blocks, 1) if said]
    df = spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, "title: unmarked")], "n int, response string").repartition(3)
    parsed = top.parse_responses(df)
    names = ["title", "category", "summary", "time_range", "notes", "message_count", "confidence", "participants", "message_ids", "message_indices", "keywords"]

    def plain(frame):
        return sorted((r["n"], r["block_no"], tuple(r[name] for name in names)) for r in frame.collect())

    assert plain(parsed) == sorted(wanted)
    responses.register_parse_topics(spark)
    lateral = spark.sql("select a.n, t.* from {a} a, lateral parse_topics(a.response) t", a=df)
    assert plain(lateral) == sorted(wanted)
    plans = [frame._jdf.queryExecution().executedPlan().toString() for frame in (parsed, lateral)]
    assert not any(word in plan for plan in plans for word in ("Python", "Arrow", "Join"))


def test_resolve_members_cuts_ranges(spark) -> None:
    topics = spark.createDataFrame(
        [("r", 1, [], ["3-1", "junk", "2000000000-2", "5", "-4"]), ("r", 2, ["given"], ["1"])],
        "chatroom string, n int, message_ids array<string>, message_indices array<string>",
    )
    seq = spark.createDataFrame([("r", i, f"m{i}") for i in range(1, 5)], "chatroom string, seq_id long, msg_id string")
    rows = top.resolve_members(topics, seq, ["chatroom", "n"]).orderBy("n", "pos").collect()
    assert [r.msg_id for r in rows if r.n == 1] == ["m1", "m2", "m3", "m2", "m3", "m4"]
    assert [r.msg_id for r in rows if r.n == 2] == ["given"]


def test_wide_range_is_expanded_in_pieces(spark) -> None:
    size = 2 * top.SPAN_PIECE + 5
    topics = spark.createDataFrame(
        [("r", 1, [], ["1-2000000000"])],
        "chatroom string, n int, message_ids array<string>, message_indices array<string>",
    )
    seq = spark.range(1, size + 1).select(
        F.lit("r").alias("chatroom"), F.col("id").alias("seq_id"), F.concat(F.lit("m"), "id").alias("msg_id")
    )
    rows = top.resolve_members(topics, seq, ["chatroom", "n"])
    assert rows.agg(F.count_distinct("msg_id"), F.count("msg_id")).first()[:] == (size, size)


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_popularity_reference_point(spark) -> None:
    row = _one(spark, a=fn.popularity(F.lit(20), F.lit(60)), b=fn.popularity(F.lit(0), F.lit(60)))
    assert row.a == pytest.approx(11.786, abs=1e-3)
    assert row.b == 0.0


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("时事", "时事"), (" 国际新闻 ", "时事"), ("财经与社会", "时事"), ("数字币", "投资理财"), ("", "工作生活"), ("迪子", "迪子"), ("x", "工作生活")],
)
def test_category(spark, raw: str, expected: str) -> None:
    assert _one(spark, c=fn.normalize_category(F.lit(raw))).c == expected


def test_similarity(spark) -> None:
    def score(a, b):
        return fn.keyword_similarity(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))

    row = _one(spark, same=score(["Stock!", "fund"], ["stocks", "Fund"]), none=score(["!"], ["a"]), half=score(["ab", "cd"], ["ab", "xy"]))
    assert (row.same, row.none, row.half) == (1.0, 0.0, 0.5)


def test_lists_and_numbers(spark) -> None:
    row = _one(
        spark, items=fn.split_list(F.lit(' a,"b"，\'c\' ,, ')), idx=fn.parse_indices(F.array(*map(F.lit, ["5-3", "7", "x", "-2"]))),
        whole=fn.parse_int(F.lit("-2.9")), name=fn.safe_name(F.lit("__a b/c__")), empty=fn.safe_name(F.lit("??")),
    )
    assert (row["items"], row.idx, row.whole) == (["a", "b", "c"], [3, 4, 5, 7], -2)
    assert (row.name, row.empty) == ("a_b_c", "chatroom")
