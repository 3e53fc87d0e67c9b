"""The whole room analysis on a small conversation, followed step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions.text import LineFormat
from chatlake.plans import analysis, report

PEOPLE = [f"u{i}" for i in range(12)]


def _messages(spark):
    rows = []
    for number in range(60):
        rows.append((f"m{number:03d}", "busy", PEOPLE[number % 12], 1704067200 + number * 60, f"hello {number}", 1))
    rows.append(("m900", "quiet", "u1", 1704067200, "alone", 1))
    rows.append(("m901", "busy", "u1", 1704067200 + 9999, "<msg><emoji/></msg>", 49))
    df = spark.createDataFrame(
        rows, "msg_id string, chatroom string, chatroom_sender string, epoch long, content string, msg_type int"
    )
    return df.withColumns(
        {"create_time": F.timestamp_seconds("epoch"), "from_username": F.lit(""), "is_chatroom_msg": F.lit(1)}
    )


def _model():
    def answer(prompt: str) -> str:
        if "分段摘要数量" in prompt:
            return "<<<TOPIC>>>\ntitle: Greetings\ncategory: 娱乐\nsummary: people say hello\nnotes: merged"
        if "分段:" in prompt:
            return "<<<TOPIC>>>\nsummary: part\nnotes: "
        if "quiet" in prompt:
            return "<<<RESULT_START>>>\n<<<RESULT_END>>>"
        listed = "".join(f"- {name}\n" for name in PEOPLE)
        return (
            f"<<<TOPIC>>>\nkeywords:\n- hello\n- greeting\nparticipants:\n{listed}message_indices:\n- 1-30\nmessage_count: 30\n"
            f"<<<TOPIC>>>\nkeywords: hellos, greet\nparticipants: u0\nmessage_indices: 31-99\nmessage_count: 30\n"
        )

    return answer


def test_analysis(spark) -> None:
    settings = analysis.Settings(lines=LineFormat(prompt_version="v2"), max_messages_per_batch=100)
    result = analysis.analyze(_messages(spark), _model, settings=settings)
    prompt = result["prompts"].filter("chatroom = 'busy'").first()
    assert prompt.total_messages == 61
    assert "[1] 2024-01-01 00:00:00 u0: hello 0" in prompt.prompt
    assert "emoji" not in prompt.prompt
    topics = result["topics"].collect()
    assert len(topics) == 1
    topic = topics[0]
    assert (topic.chatroom, topic.title, topic.category, topic.summary) == ("busy", "Greetings", "工作生活", "people say hello")
    assert topic.message_count == 61 and topic.participants == sorted(PEOPLE)
    assert topic.keywords == ["greet", "greeting", "hello", "hellos"]
    assert result["members"].count() == 61
    rows = {r.chatroom: r for r in result["report"].collect()}
    assert rows["quiet"].heading == report.NO_TOPICS
    assert rows["busy"].heading == "## Greetings" and rows["busy"].times.startswith("🕒 00:00")
    kinds = {r.message_type: r["count"] for r in result["trace"].groupBy("message_type").count().collect()}
    assert kinds == {"text": 61, "filtered": 1}
    text = [r.markdown for r in report.report_document(result["report"], "2024-01-01").collect()]
    assert text[0].startswith("# 群聊消息分析报告\n\n- 日期: 2024-01-01")


def test_same_prompts_however_rooms_are_cut(spark) -> None:
    whole = analysis.prepare_rooms(_messages(spark), analysis.Settings(max_input_tokens=100))
    found = {(r.chatroom, r.seq_id): r.batch_index for r in whole.collect()}
    costs = [(r.seq_id, max(1, len(r.line) // 4) + 1) for r in whole.filter("chatroom = 'busy'").orderBy("seq_id").collect()]
    batch, total = 1, 0
    for seq, cost in costs:
        if total and total + cost > 100:
            batch, total = batch + 1, 0
        total += cost
        assert found["busy", seq] == batch


def test_empty_report_head() -> None:
    assert report.report_head("d", "a\nb", True) == "# a b\n\n- 日期: d\n\n未找到可分析的群聊消息。"
